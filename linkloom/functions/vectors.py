"""Column functions over numbers and vectors (ARRAY<DOUBLE>)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def unit(v: Column, length: Column | None = None) -> Column:
    """The vector at length 1; a zero vector stays zero, so that the cosine with it is 0."""
    n = norm(v) if length is None else length
    return F.when(n == 0, v).otherwise(F.transform(v, lambda x: x / n))


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def min_max(v: Column, lo: Column | float, hi: Column | float) -> Column:
    lo, hi = (x if isinstance(x, Column) else F.lit(float(x)) for x in (lo, hi))
    return F.when(hi == lo, v).otherwise((v - lo) / (hi - lo))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def top_percent(n: Column, share: float) -> Column:
    """Half-even rounding: a tenth of 25 is 2."""
    return F.bround(n * F.lit(share), 0).cast("long")


def complement(p: Column) -> Column:
    return F.bround(1 - p, 2)


def threshold_range(spark, first: float, last: float, step: float, name: str = "t") -> DataFrame:
    """first, first + step, ..., last, rounded to two decimals."""
    n = int(round((last - first) / step))
    return spark.range(n + 1).select(F.round(F.lit(first) + F.col("id") * F.lit(step), 2).alias(name))


def reduce_by(name: str):
    """The aggregate by which several similarities become one: max, min or mean."""
    return {"max": F.max, "min": F.min, "mean": F.avg}[name]


def better(a: Column, b: Column, reverse: bool = False) -> Column:
    """Strictly more similar: larger, or smaller where the measure is a distance."""
    return a < b if reverse else a > b


def mean_vector(df: DataFrame, keys: list[str], vec: str, weight: str | None = None) -> DataFrame:
    """(keys, vec): the mean of the vectors of each group, weighted if a weight is named. Null vectors are left out; a group without any, or with total weight 0, has no row.

    Every position is a group of its own with partial aggregation before the shuffle.
    """
    rows = df.filter(F.col(vec).isNotNull()).select(*keys, F.col(weight).alias("_w") if weight else F.lit(1.0).alias("_w"), F.posexplode(vec).alias("_i", "_x"))
    sums = rows.groupBy(*keys, "_i").agg(F.sum(F.col("_x") * F.col("_w")).alias("_s"), F.sum("_w").alias("_n")).filter("_n <> 0")
    return sums.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", (F.col("_s") / F.col("_n")).alias("x")))), lambda p: p["x"]).alias(vec))
