"""Shared patterns, sizes and written stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut as written
from ..session import shared_dir

__all__ = ["WORD", "bytes_of", "let", "pieces_for", "shared_dir", "written"]

WORD = r"[^\x20\x09-\x0D]+"


def let(value: Column, body) -> Column:
    """body(value) with the value computed once; written out, expressions would repeat it."""
    return F.get(F.transform(F.array(value), body), 0)


def bytes_of(df: DataFrame, text: str = "text") -> int:
    """How many bytes of text df holds, by one pass without a shuffle; whatever the files' compression."""
    return int(df.agg(F.sum(F.octet_length(F.col(f"`{text}`")))).first()[0] or 0) + 1


def pieces_for(df: DataFrame, piece_bytes: int, text: str = "text") -> int:
    """How many pieces of about ``piece_bytes`` the texts make; grows with the input."""
    return max(1, -(-bytes_of(df, text) // piece_bytes))
