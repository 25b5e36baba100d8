"""Texts cleaned by Unicode rules, in Arrow batches."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(text: str | None, limit: int | None = None, one_line: bool = False) -> str | None:
    """NFC without characters of category C but line feeds and tabs, stripped, cut at ``limit``; ``one_line`` makes runs of white space a space."""
    if text is None:
        return None
    kept = "".join(c for c in unicodedata.normalize("NFC", text) if c in "\n\t" or unicodedata.category(c)[0] != "C").strip()
    return (re.sub(r"\s+", " ", kept) if one_line else kept)[:limit]


def cleaned(text: Column, limit: int | None = None, one_line: bool = False) -> Column:
    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda t: clean(t, limit, one_line), na_action="ignore")

    return run(text)
