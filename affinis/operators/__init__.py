"""Operators over descriptor tables ``(uid, vector[, label])``."""
