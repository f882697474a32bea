"""Ranks and cumulative counts within groups of any size, without putting a group into one task.

Values are cut into slices by a bucket that never falls as the value rises (sign and power of 2**(1/16)), rows are
counted by slice, the counts are added up over the few slices of a group, and only rows of one slice are sorted
together. A slice of one value only is counted, not sorted: rows are first aggregated by value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def slice_of(x: Column) -> Column:
    """Slices of the real line in ascending order."""
    step = F.floor(F.log2(F.abs(x)) * 16).cast("int")
    return F.when(x == 0, F.lit(0)).otherwise(F.signum(x).cast("int") * (step + F.lit(20000)))


def same(keys: list[str]) -> Column:
    """Whether a row's keys are those of the other side, named __k0 and on; null is equal to null."""
    out = F.lit(True)
    for i, k in enumerate(keys):
        out = out & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return out


def quantiles(rows: DataFrame, keys: list[str], x: str, qs: tuple[float, ...]) -> DataFrame:
    """keys + (n, q ARRAY<DOUBLE>): exact quantiles of finite values by linear interpolation at (n - 1) q, from the values at
    the two ranks beside each. Null keys are a group; no group is gathered or sorted in one task."""
    c = cumulative(rows, keys, x, {"__c": F.lit(1)})
    n = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), "n")
    c = c.join(n, same(keys)).withColumn("__f", F.col("upto___c") - F.col("__c"))
    held = lambda r: F.max(F.when((F.col("__f") <= r) & (r < F.col("upto___c")), F.col(x)))
    place = lambda q: (F.col("n") - 1) * F.lit(float(q))
    g = c.groupBy(*keys, "n").agg(*(held(f(place(q))).alias(f"__{s}{i}") for i, q in enumerate(qs) for s, f in (("a", F.floor), ("b", F.ceil))))
    value = lambda i, q: F.col(f"__a{i}") + (F.col(f"__b{i}") - F.col(f"__a{i}")) * (place(q) - F.floor(place(q)))
    return g.select(*keys, "n", F.array(*(value(i, q) for i, q in enumerate(qs))).alias("q"))


def cumulative(rows: DataFrame, keys: list[str], x: str, counts: dict[str, Column]) -> DataFrame:
    """keys + (x, next, and for each count its sum at x and "upto" sum over values <= x) for each distinct finite value.

    next is the next larger value of the group (null at the last). counts: name to the expression that is summed.
    """
    v = rows.groupBy(*keys, x).agg(*(F.sum(e).alias(n) for n, e in counts.items())).withColumn("__s", slice_of(F.col(x)))
    s = v.groupBy(*keys, "__s").agg(F.min(x).alias("__lo"), *(F.sum(n).alias(f"__t_{n}") for n in counts))
    over = Window.partitionBy(*keys).orderBy("__s")
    s = s.select(*keys, "__s", F.lead("__lo").over(over).alias("__nextlo"), *((F.sum(f"__t_{n}").over(over) - F.col(f"__t_{n}")).alias(f"__b_{n}") for n in counts))
    inner = Window.partitionBy(*keys, "__s").orderBy(x)
    j = v.join(s.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.col("__s").alias("__at"), *(c for c in s.columns if c not in (*keys, "__s"))), same(keys) & (F.col("__s") == F.col("__at")))
    return j.select(
        *keys, x, F.coalesce(F.lead(x).over(inner), F.col("__nextlo")).alias("next"), *counts, *((F.sum(n).over(inner) + F.col(f"__b_{n}")).alias(f"upto_{n}") for n in counts)
    )
