"""Masking of personal data and keys, one kind after the other."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fixed import MASKS


# Characters shown at the start, stars, characters shown at the end; other kinds are hidden whole.
SHOWN = {"phone": (3, 4, 4), "id_card": (6, 8, 1), "credit_card": (0, 12, 4), "api_key": (0, 8, 0)}
HIDDEN = (0, 8, 0)


def _stars(n: Column) -> Column:
    return F.repeat(F.lit("*"), n.cast("int"))


def _masked_email(m: Column) -> Column:
    """First character, stars for the local part, ``@``, stars for the first label, the last label."""
    local, domain = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    first, last = F.substring_index(domain, ".", 1), F.substring_index(domain, ".", -1)
    return F.concat(F.substring(m, 1, 1), _stars(F.length(local)), F.lit("@"), _stars(F.length(first)), F.lit("."), last)


def _mask(text: Column, kind: str, pattern: str) -> Column:
    if kind == "email":
        return _replaced(text, pattern, _masked_email)
    head, stars, tail = SHOWN.get(kind, HIDDEN)
    covered = lambda m: F.concat(F.substring(m, 1, head), F.lit("*" * stars), F.right(m, F.lit(tail)) if tail else F.lit(""))
    return _replaced(text, pattern, covered)


def _replaced(text: Column, pattern: str, cover: Callable[[Column], Column]) -> Column:
    """Every match of the pattern covered."""
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    masked = F.concat(F.transform(found, cover), F.array(F.lit("")))
    return F.array_join(F.zip_with(between, masked, lambda a, b: F.concat(a, b)), "")


def masked(df: DataFrame, text_col: str, masks: dict[str, str] | None = None) -> DataFrame:
    """``text_col`` masked, with ``masked_fields`` (the kinds found, each looked for after the ones before it)."""
    kinds = masks or MASKS
    names = [f"_found_{k}" for k in kinds]
    for kind, pattern in kinds.items():
        df = df.withColumn(f"_found_{kind}", F.when(F.col(text_col).rlike(pattern), F.lit(kind)))
        df = df.withColumn(text_col, F.when(F.col(f"_found_{kind}").isNotNull(), _mask(F.col(text_col), kind, pattern)).otherwise(F.col(text_col)))
    return df.withColumn("masked_fields", F.array_compact(F.array(*names))).drop(*names)
