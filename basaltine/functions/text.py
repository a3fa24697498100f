"""Text functions as columns: tokens, codes, trade item numbers, confidence bands."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf


def tokens(value: Column) -> Column:
    """Runs of letters and digits, lower case, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(value, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


@pandas_udf(T.StringType())
def normal_text(value: pd.Series) -> pd.Series:
    """Compatibility-composed, case folded, non-word characters as single spaces.

    Spark has neither NFKC nor full case folding, so this runs in Arrow batches.
    """
    folded = value.fillna("").map(lambda s: unicodedata.normalize("NFKC", s).casefold())
    return folded.str.replace(r"[\W_]+", " ", regex=True).str.strip()


def normal_code(value: Column) -> Column:
    """Upper-case ASCII letters and digits of a model or part number."""
    return F.regexp_replace(F.upper(F.coalesce(value, F.lit(""))), "[^0-9A-Z]", "")


def gtin(value: Column) -> Column:
    """The digits of a trade item number with a right check digit, else ''."""
    digits = F.regexp_replace(F.coalesce(value, F.lit("")), "[^0-9]", "")
    body = F.reverse(F.substring(digits, F.lit(1), F.length(digits) - 1))
    digit = lambda i: F.substring(body, i, F.lit(1)).cast("int")
    weighted = F.aggregate(F.sequence(F.lit(1), F.length(body)), F.lit(0), lambda acc, i: acc + digit(i) * F.when(i % 2 == 1, 3).otherwise(1))
    right = (F.lit(10) - weighted % 10) % 10 == F.right(digits, F.lit(1)).cast("int")
    return F.when(F.length(digits).isin(8, 12, 13, 14), F.when(right, digits).otherwise("")).otherwise("")


def band(confidence: Column) -> Column:
    """high from 0.90, medium from 0.70, else low."""
    return F.when(confidence >= 0.90, "high").when(confidence >= 0.70, "medium").otherwise("low")


def price(value: Column) -> Column:
    """First price of a text: up to nine digits, groups of three after a space, one or two decimals after '.' or ','."""
    plain = F.left(F.trim(F.regexp_replace(value, "[\\s\u00a0]+", " ")), F.lit(100))
    found = F.regexp_extract(plain, r"([0-9]{1,9}(?: [0-9]{3})*(?:[.,][0-9]{1,2})?)", 1)
    return F.when(found != "", F.replace(F.replace(found, F.lit(" "), F.lit("")), F.lit(","), F.lit(".")).cast("double"))
