"""Incremental indexes, sessions with expiry, and caches with a time to live."""
