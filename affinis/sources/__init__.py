"""Readers and writers of contents, vectors and key-value tables."""
