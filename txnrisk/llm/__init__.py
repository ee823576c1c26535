"""Operators for preparing training text: counting, searching, scoring, de-duplicating, packing, mixing, classifying."""
