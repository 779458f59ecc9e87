"""Company-name similarity for register matches."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

#: Fixed value: legal words that the register key leaves out.
REGISTER_LEGAL_WORDS = r"(?i)\b(private|pvt|limited|ltd|llc|l\.l\.c|inc|incorporated|corp|corporation|co|company|plc|gmbh|ag|sa|s\.a|bv|b\.v|nv|pty|pte|llp|lp|smc|fze|fzco|fz-llc)\b\.?"


def register_key(name: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), REGISTER_LEGAL_WORDS, " "), r"(?U)[^\w\s]", " ")
    return F.trim(F.regexp_replace(bare, r"(?U)\s+", " "))


@pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([0.0 if x is None or y is None else round(difflib.SequenceMatcher(None, x, y).ratio(), 3) for x, y in zip(a, b, strict=True)], dtype="float64")


def name_similarity(a: Column, b: Column, least: float = 0.0) -> Column:
    """1 for equal register keys, 0 for an empty one, else the Ratcliff-Obershelp ratio of both keys.

    Names whose lengths rule out ``least`` count as 0 and are not compared.
    """
    x, y = register_key(a), register_key(b)
    reach = 2 * F.least(F.length(x), F.length(y)) / (F.length(x) + F.length(y)) >= least
    return F.when((x == "") | (y == ""), 0.0).when(x == y, 1.0).otherwise(_ratio(F.when(reach & (x != y), x), y))
