"""Registry of implementations: discovery, default configuration and construction from JSON-like envelopes."""

from __future__ import annotations

import importlib
import importlib.metadata
import inspect
import os
from collections.abc import Callable
from copy import deepcopy


def merge(base: dict, new: dict, deep_copy: bool = False) -> dict:
    """``base`` with ``new`` merged into it, dictionaries within dictionaries too."""
    for key, value in new.items():
        if isinstance(value, dict) and isinstance(base.get(key), dict):
            merge(base[key], value, deep_copy)
        else:
            base[key] = deepcopy(value) if deep_copy else value
    return base


class Registry:
    """Implementations of one kind, by name."""

    def __init__(self, kind: str):
        self.kind = kind
        self.known: dict[str, Callable] = {}

    def add(self, make: Callable | None = None, name: str | None = None):
        def put(f: Callable) -> Callable:
            self.known[name or f.__name__] = f
            return f

        return put(make) if make else put

    def discover(self, variable: str | None = None, group: str | None = None) -> dict[str, Callable]:
        """Also imports the modules named in an environment variable and in an entry point group; unusable ones are left out."""
        for module in filter(None, os.environ.get(variable or "", "").split(os.pathsep)):
            importlib.import_module(module)
        for point in importlib.metadata.entry_points(group=group) if group else ():
            self.known.setdefault(point.name, point.load())
        return {n: f for n, f in self.known.items() if getattr(f, "is_usable", lambda: True)()}

    def defaults(self) -> dict:
        """Envelope with every implementation's default configuration, none chosen."""
        return {"type": None} | {n: default_config(f) for n, f in sorted(self.known.items())}

    def make(self, config: dict):
        """The object that ``{"type": name, name: {...}}`` describes."""
        name = config.get("type")
        if name not in self.known:
            raise ValueError(f"{self.kind}: type must be one of {sorted(self.known)}, not {name!r}")
        if name not in config:
            raise ValueError(f"{self.kind}: no configuration of {name!r}")
        return self.known[name](**config[name])


    def factory(self, config: dict) -> Callable:
        """A function that makes an object of ``config`` anew, with keywords that replace some of its parameters."""
        name = config.get("type")
        self.make(config)
        return lambda **given: self.known[name](**(config[name] | given))


def default_config(make: Callable) -> dict:
    """Parameters of a constructor and their defaults, null where there is none."""
    found = inspect.signature(make).parameters.values()
    return {p.name: None if p.default is p.empty else p.default for p in found if p.kind in (p.POSITIONAL_OR_KEYWORD, p.KEYWORD_ONLY) and p.name != "self"}


def envelope(name: str, make: Callable, **given) -> dict:
    return {"type": name, name: default_config(make) | given}
