"""Text functions.  All are Column expressions, but for the exact slow paths, which are Arrow UDFs on gated rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from .fixed import COMMAND_WORDS, COUNTED_MARKS, SQL_WORDS, XSS_WORDS


def stripped(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def sanitized(text: Column) -> Column:
    """Without control characters (tab and line ends stay) and outer white space."""
    return stripped(F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""))


@pandas_udf(StringType())
def _decode_legacy(raw: pd.Series) -> pd.Series:
    def one(b: bytes) -> str:
        try:
            return b.decode("gbk")
        except UnicodeDecodeError:
            return b.decode("utf-8", "replace")

    return raw.map(one, na_action="ignore")


def decoded(raw: Column) -> Column:
    """Bytes as UTF-8, else GBK, else UTF-8 with replacement; without a byte order mark.

    Only rows that are no valid UTF-8 go through Python.
    """
    fine = F.is_valid_utf8(raw.cast("string"))
    text = F.when(fine, raw.cast("string")).otherwise(_decode_legacy(F.when(~fine, raw)))
    return F.regexp_replace(text, "^﻿", "")


@pandas_udf(StringType())
def _deobfuscate(text: pd.Series) -> pd.Series:
    import base64
    import re
    from urllib.parse import unquote_plus

    b64, hexa = re.compile(r"[A-Za-z0-9+/=]+\Z"), re.compile(r"[0-9a-fA-F]+\Z")

    def one(s: str) -> str:
        for _ in range(5):
            before = s
            if "%" in s:
                s = unquote_plus(s)
            for shape, step, decode in ((b64, 4, base64.b64decode), (hexa, 2, bytes.fromhex)):
                if shape.match(s) and len(s) % step == 0:
                    try:
                        s = decode(s).decode("utf-8", "ignore") or s
                    except ValueError:
                        pass
            if s == before:
                break
        return s

    return text.map(one, na_action="ignore")


def deobfuscated(text: Column) -> Column:
    """Up to five rounds of URL, base64 and hex decoding.

    Texts that no round can change (no ``%``, not all of the base64 alphabet) skip Python.
    """
    may = text.contains("%") | text.rlike(r"^[A-Za-z0-9+/=]+$")
    return F.when(may, _deobfuscate(F.when(may, text))).otherwise(text)


def url_decoded(text: Column) -> Column:
    """One round of URL decoding, JVM side; malformed texts stay."""
    return F.coalesce(F.try_url_decode(text), text)


def without_evasion(text: Column) -> Column:
    """Lower case, without SQL comments and hex entities, white space collapsed."""
    t = F.regexp_replace(F.lower(text), r"(?s)/\*.*?\*/", "")
    t = F.regexp_replace(t, r"(?m)--.*$", "")
    t = F.regexp_replace(t, r"&#x0*3c;", "<")
    t = F.regexp_replace(t, r"&#x0*3e;", ">")
    t = F.regexp_replace(t, r"&#x0*27;", "'")
    t = F.regexp_replace(t, r"&#x0*22;", '"')
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def occurrences(text: Column, part: str) -> Column:
    """How often ``part`` occurs without overlaps; most texts lack it, and a look for it costs much less than a replacement."""
    found = ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")
    return F.when(text.contains(part), found).when(text.isNotNull(), 0)


def excerpt(text: Column, most: int = 200) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def feature_names() -> list[str]:
    marks = ["slash", "question", "equals", "ampersand", "semicolon", "quote", "double_quote", "blank"]
    return ["length", "words", *(f"n_{m}" for m in marks), "special_ratio", "upper_ratio", *(f"kw_{i}_{w}" for i, w in enumerate((*SQL_WORDS, *XSS_WORDS, *COMMAND_WORDS)))]


def text_features(text: Column, raw: bool = False) -> list[Column]:
    """The 33 counts and ratios of a text; ``raw`` counts before case and punctuation are removed."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))
    t = text if raw else plain
    n = F.length(t)
    words = F.when(F.trim(t) == "", 0).otherwise(F.size(F.split(F.trim(t), r"\s+")))
    ratio = lambda x: F.coalesce(F.try_divide(x, n), F.lit(0.0))
    special = n - F.length(F.regexp_replace(t, r"[^\p{L}\p{N}\s]", ""))
    upper = n - F.length(F.regexp_replace(t, r"\p{Lu}", ""))
    values = [n, words, *(occurrences(t, m) for m in COUNTED_MARKS), ratio(special), ratio(upper), *(occurrences(F.lower(t), w) for w in (*SQL_WORDS, *XSS_WORDS, *COMMAND_WORDS))]
    return [v.cast("double").alias(name) for v, name in zip(values, feature_names(), strict=True)]
