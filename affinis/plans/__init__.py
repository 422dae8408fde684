"""Operators by name and configuration, and the jobs composed of them."""
