"""Masking and pseudonyms."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# An address starts where a run of its characters starts, or right behind the address before;
# without that anchor every position of a long word would be tried.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+[.][A-Za-z]{2,}"
_LONG_NUMBER = r"[0-9]{6,}"


def mask_text(value: Column) -> Column:
    """Upper case to ``X``, lower case to ``x``, digits to ``n``."""
    return F.mask(value)


def pseudonym(value: Column, salt: str = "") -> Column:
    """Stable SHA-256 stand-in for a value."""
    return F.sha2(F.concat(F.lit(salt), value.cast("string")), 256)


def redact(value: Column) -> Column:
    """E-mail addresses and long digit runs replaced over the whole text."""
    no_mail = F.when(value.contains("@"), F.regexp_replace(value, _EMAIL, "<email>")).otherwise(value)
    return F.regexp_replace(no_mail, _LONG_NUMBER, "<number>")
