"""Column functions: pure expressions, usable in batch and streaming plans."""
