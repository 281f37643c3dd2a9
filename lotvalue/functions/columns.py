"""Column expressions shared by the operators. Everything stays inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The characters stripped from text keys and the spellings that mean "missing".
WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
              "\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
MISSING_TEXT = ("nan", "none", "")

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
INFINITE = r"(?i)^[+-]?inf(inity)?$"


def nan_to_null(c: Column) -> Column:
    """Spark sorts NaN above every number; missing values are NULL everywhere in this package."""
    return F.nanvl(c, F.lit(None).cast("double"))


def coerce_number(c: Column, dtype: str) -> Column:
    """Number or NULL. Text must be a plain number: '12d' and '1,234' are NULL, ' 12 ' is 12."""
    if dtype != "string":
        return nan_to_null(c.cast("double"))
    text = F.btrim(c, F.lit(WHITESPACE))
    return F.when(text.rlike(NUMBER) | text.rlike(INFINITE), text.try_cast("double"))


def coerce_timestamp(c: Column, dtype: str) -> Column:
    if dtype == "string":
        return F.btrim(c, F.lit(WHITESPACE)).try_cast("timestamp_ntz")
    return c.cast("timestamp_ntz")


def within(c: Column, low, high) -> Column:
    """The value where it lies in [low, high], NULL elsewhere."""
    return F.when(c.between(low, high), c)


def clip(c: Column, low=None, high=None) -> Column:
    """Limit a value; a missing value stays missing (greatest and least would skip the NULL)."""
    limited = c
    if low is not None:
        limited = F.greatest(limited, F.lit(low))
    if high is not None:
        limited = F.least(limited, F.lit(high))
    return F.when(c.isNotNull(), limited)


def strip_lower(c: Column) -> Column:
    return F.lower(F.btrim(c, F.lit(WHITESPACE)))


def text_key(c: Column, upper: bool = False, also_missing: tuple[str, ...] = ()) -> Column:
    """Trimmed, case-folded key with the missing-value spellings nulled."""
    folded = strip_lower(c)
    kept = F.upper(folded) if upper else folded
    return F.when(~folded.isin(*MISSING_TEXT, *also_missing), kept)


def month_key(c: Column) -> Column:
    return F.trunc(c.cast("date"), "MM")


def contains_any(c: Column, terms) -> Column:
    """True where the lower-cased text holds one of the terms; missing text is False."""
    return F.coalesce(F.lower(c).rlike("|".join(terms)), F.lit(False))


def share(condition: Column) -> Column:
    """Aggregate: percentage of rows for which the condition holds."""
    return F.avg(F.coalesce(condition, F.lit(False)).cast("double")) * 100


def title_case(c: Column) -> Column:
    return F.initcap(F.translate(c, "-_", "  "))
