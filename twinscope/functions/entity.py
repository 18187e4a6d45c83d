"""Columns derived from an entity's attributes.

In sizes, zero counts as missing; in names only null does, except where a matcher says
otherwise. ``prefix`` is for tables joined under an alias.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from twinscope import schema


def size(img: int, prefix: str = "") -> Column:
    """The size in one image."""
    return F.col(f"{prefix}orig_size" if img == schema.ORIG else f"{prefix}recomp_size")


def max_size(img: int, prefix: str = "") -> Column:
    return F.col(f"{prefix}orig_max_size" if img == schema.ORIG else f"{prefix}recomp_max_size")


def any_size(img: int = schema.RECOMP, prefix: str = "") -> Column:
    """A size that is not null: the image's own, or else the other image's, or 0."""
    own, other = (size(i, prefix) for i in (img, 1 - img))
    return F.coalesce(F.nullif(own, F.lit(0)), F.nullif(other, F.lit(0)), F.lit(0))


def best_name(prefix: str = "") -> Column:
    return F.coalesce(F.col(f"{prefix}computed_name"), F.col(f"{prefix}name"))


def type_name(type_: Column | str) -> Column:
    names = F.create_map(*[F.lit(x) for pair in schema.TYPE_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, F.col(type_) if isinstance(type_, str) else type_), F.lit("UNK"))


def match_name(suffix: Column | None = None, prefix: str = "") -> Column:
    """The name with its type, or with a suffix as an offset, as diffs show it; null
    without a name."""
    name = best_name(prefix)
    plain = F.concat(name, F.lit(" ("), type_name(f"{prefix}type"), F.lit(")"))
    if suffix is None:
        return plain
    return F.when(F.coalesce(suffix, F.lit("")) != "", F.concat(name, suffix, F.lit(" (OFFSET)"))).otherwise(plain)


def has_text(c: Column) -> Column:
    """Neither null nor empty."""
    return F.coalesce(c != "", F.lit(False))


def likely_latin1(c: Column) -> Column:
    """Whether text begins with an ASCII character or white space and goes on in Latin-1."""
    return F.coalesce(c.rlike(r"\A[\t\r\n\x20-\x7f][\t\r\n\x20-\x7f\xa0-\xff]*\z"), F.lit(False))
