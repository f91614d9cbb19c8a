"""String expressions for file names and header text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .expr import col


def image_object_id(file_name: str | Column) -> Column:
    """Object id out of ``image_<id>.jpeg``."""
    stem = F.split_part(col(file_name), F.lit("_"), F.lit(2))
    return F.split_part(stem, F.lit("."), F.lit(1)).try_cast("bigint")


def visit_rank(file_name: str | Column) -> Column:
    """Sort key of a visit file: the last ``-`` piece of its fifth ``_`` token.

    A digit in third place means a plain number after the first character.
    Otherwise the visit number has run out and a letter continues it.
    """
    token = F.try_element_at(F.split(col(file_name), "_"), F.lit(5))
    piece = F.element_at(F.split(token, "-"), -1)
    digit = F.substring(piece, 2, 1).try_cast("int")
    letter = F.ascii(F.substring(piece, -1, 1)) - F.lit(ord("A"))
    return (F.when(F.substring(piece, 3, 1).rlike("^[0-9]$"),
                   F.substring(piece, 2, 64).try_cast("int"))
            .otherwise(digit * 27 + letter + 101))


def header_number(header: str | Column, key: str) -> Column:
    """First whitespace-delimited token after ``key`` in a header, as a number."""
    token = F.regexp_extract(col(header), _quote(key) + r"\s*(\S+)", 1)
    return F.nullif(token, F.lit("")).try_cast("double")


def _quote(text: str) -> str:
    return "".join("\\" + ch if not ch.isalnum() and ch != " " else ch for ch in text)


def last_token(c: str | Column, separator: str) -> Column:
    return F.element_at(F.split(col(c), separator), -1)
