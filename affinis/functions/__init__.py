"""Column expressions: vectors, bits, strings, boxes and small number theory."""
