"""Column functions that the operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AMOUNT = "decimal(38,4)"


def ratio(above: Column, below: Column) -> Column:
    """A quotient in double precision; null where the divisor is zero or null."""
    return F.try_divide(above.cast("double"), below.cast("double"))


def amount(text: Column) -> Column:
    """An amount from recognised text: full-width signs, blanks and thousands
    separators are read over, brackets make it negative; null if it is no number."""
    plain = F.regexp_replace(F.translate(text, "０１２３４５６７８９，．（）－", "0123456789,.()-"), "[ ,　]", "")
    signed = F.regexp_replace(plain, r"^\((.*)\)$", "-$1")
    return signed.try_cast(AMOUNT)


def clamp(x: Column, low: float, high: float) -> Column:
    """x within bounds; null stays null, which greatest and least alone would hide."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def middle(values: Column) -> Column:
    """Median of a short array of doubles, by order; null for an empty one."""
    s, n = F.array_sort(values), F.size(values)
    low, high = F.get(s, F.floor((n - 1) / 2).cast("int")), F.get(s, F.floor(n / 2).cast("int"))
    return F.when(n > 0, (low + high) / 2)


def summed_up(values: Column) -> Column:
    """Struct of median and mad (median absolute deviation, without a scale factor) of a
    short array of doubles; each is computed once, however often its fields are read."""
    once = lambda x, f: F.get(F.transform(F.array(x), f), 0)  # noqa: E731 - binds x for f

    def of(sorted_: Column) -> Column:
        n = F.size(sorted_)
        mid = (F.get(sorted_, F.floor((n - 1) / 2).cast("int")) + F.get(sorted_, F.floor(n / 2).cast("int"))) / 2
        return F.when(n > 0, mid)

    def around(sorted_: Column) -> Column:
        return once(of(sorted_), lambda m: once(F.array_sort(F.transform(sorted_, lambda v: F.abs(v - m))), lambda gaps: F.struct(m.alias("median"), of(gaps).alias("mad"))))

    return once(F.array_sort(values), around)


def spread(values: Column) -> Column:
    """Median absolute deviation of a short array, without a scale factor."""
    return summed_up(values)["mad"]


def fenced(raw: Column) -> Column:
    """JSON text out of a Markdown fence, or the text itself."""
    return F.when(raw.rlike(r"(?s)^\s*```"), F.regexp_extract(raw, r"(?s)^\s*```(?:json)?\s*(.*?)\s*```\s*$", 1)).otherwise(F.trim(raw))
