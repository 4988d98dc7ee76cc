"""Text ids, labels, groups and a deterministic embedding of words."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fields that can label a record, in order.
LABEL_FIELDS = ("title", "name", "label", "heading", "headline", "text", "summary", "description")


def text_id(text: Column) -> Column:
    """The id of a record loaded from text alone."""
    return F.substring(F.sha1(text), 1, 24)


def label(fields: Sequence[Column]) -> Column:
    """First field that is not blank, cut to 90 characters."""
    first = F.coalesce(*[F.when(F.trim(f) != "", F.trim(f)) for f in fields])
    return F.when(F.length(first) > 90, F.concat(F.left(first, F.lit(89)), F.lit("…"))).otherwise(first)


def group_value(col: Column, kind: str) -> Column:
    """A value to colour by: booleans and whole numbers as text, strings up to 40 characters that are not blank, else null."""
    if kind == "bool":
        return col.cast("string")
    if kind == "number":
        d = col.cast("double")
        return F.when(d == F.floor(d), F.floor(d).cast("string"))
    if kind == "string":
        return F.when((F.length(col) <= 40) & (F.trim(col) != ""), col)
    return F.lit(None).cast("string")


def word_slots(text: Column, dimension: int = 512) -> Column:
    """The slot of each word of a text: the last digits of its SHA-1 below ``dimension``, a power of two up to 4096."""
    w = F.filter(F.split(F.lower(text), r"\s+"), lambda x: x != "")
    return F.transform(w, lambda x: F.conv(F.substring(F.sha1(x), 38, 3), 16, 10).cast("int") % dimension)


def bag_of_words(text: Column, dimension: int = 512) -> Column:
    """Counts of words by slot, as a vector: a deterministic embedder built from functions alone."""
    slots = word_slots(text, dimension)
    return F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: F.size(F.filter(slots, lambda s: s == i)).cast("float"))
