"""Stored records: one JSON document per transaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# A quoted text, a run without quotes, or a stray quote.
_PIECES = r"""'[^']*+'|"[^"]*+"|[^'"]++|['"]"""
# Escaped characters and what stands for them meanwhile: control characters, which neither notation has unescaped.
_ESCAPES = {"\\\\": "\u0001", "\\'": "\u0002", '\\"': "\u0003"}
# Python-literal keywords and the JSON words for them.
_KEYWORDS = {"None": "null", "True": "true", "False": "false"}


def _json_words(col: Column) -> Column:
    """Write Python's keywords outside quoted text, and its two-digit character codes, as JSON does."""
    def plain(piece: Column) -> Column:
        for word, json_word in _KEYWORDS.items():
            piece = F.regexp_replace(piece, rf"\b{word}\b", json_word)
        return piece

    for escaped, mark in _ESCAPES.items():
        col = F.replace(col, F.lit(escaped), F.lit(mark))
    col = F.regexp_replace(col, r"\\x([0-9a-fA-F]{2})", r"\\u00$1")
    pieces = F.regexp_extract_all(col, F.lit(_PIECES), F.lit(0))
    col = F.array_join(F.transform(pieces, lambda p: F.when(p.rlike("^['\"]"), p).otherwise(plain(p))), "")
    for escaped, mark in _ESCAPES.items():
        col = F.replace(col, F.lit(mark), F.lit(escaped))
    return col


def parse_record(col: Column) -> Column:
    """A record as map<string,string>: JSON, else a Python-literal dict, else
    ``{raw_data: text, parse_error: true}``."""
    as_map = "map<string,string>"
    literal = F.when(F.trim(col).startswith("{"), F.from_json(_json_words(col), as_map))
    failed = F.create_map(F.lit("raw_data"), F.coalesce(col, F.lit("None")), F.lit("parse_error"), F.lit("true"))
    return F.coalesce(F.from_json(col, as_map), literal, failed)


def to_record(df: DataFrame, *columns: str) -> Column:
    """The JSON text stored for a row: all columns, or the named ones."""
    return F.to_json(F.struct(*(columns or df.columns)))
