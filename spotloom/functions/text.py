"""Text expressions on the ASCII white space ``[\\x20\\x09-\\x0D]``, all inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The six white-space characters, space first.
WHITE = " \t\n\x0b\x0c\r"


def text_of(name: str) -> Column:
    """The column as a string in which null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def without_white(text: Column) -> Column:
    """``text`` with every white-space character deleted (byte searches; no regular expression)."""
    for ch in WHITE:
        text = F.replace(text, F.lit(ch), F.lit(""))
    return text


def words_of(text: Column) -> Column:
    """Array of the maximal runs of characters that are not white space."""
    for ch in WHITE[1:]:
        text = F.replace(text, F.lit(ch), F.lit(" "))
    return F.array_remove(F.split(text, " ", -1), "")


def count_chars(text: Column, chars: str) -> Column:
    """Number of characters of ``text`` that are among ``chars``."""
    rest = text
    for ch in chars:
        rest = F.replace(rest, F.lit(ch), F.lit(""))
    return (F.char_length(text) - F.char_length(rest)).cast("long")


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, also where lambdas inside ``body`` read it repeatedly."""
    return F.element_at(F.transform(F.array(value), body), 1)
