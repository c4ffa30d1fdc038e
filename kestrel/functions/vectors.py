"""Vector and probability expressions (F17-F20) as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_double(v) -> Column:
    """Cast an array<float> to array<double> once, so products sum in double."""
    return F.transform(_c(v), lambda x: x.cast("double"))


def norm(v) -> Column:
    return F.sqrt(F.aggregate(_c(v), F.lit(0.0).cast("double"), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalize(v) -> Column:
    """unit-length vector in double; the zero vector stays zero.

    The sum of squares is computed once per vector (``aggregate`` finish
    step), so the cost is O(d), not O(d^2).
    """
    v = _c(v)
    return F.aggregate(
        v, F.lit(0.0).cast("double"), lambda s, x: s + x.cast("double") * x.cast("double"),
        lambda s: F.transform(v, lambda x: F.when(s > 0, x.cast("double") / F.sqrt(s)).otherwise(F.lit(0.0))))


def dot(a, b) -> Column:
    """inner product in double (= cosine for unit vectors)."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0).cast("double"), lambda s, p: s + p)


def softmax(logits) -> Column:
    """numerically stable softmax of an array<double>."""
    z = _c(logits)
    m = F.array_max(z)
    e = F.transform(z, lambda x: F.exp(x - m))
    total = F.aggregate(e, F.lit(0.0).cast("double"), lambda s, x: s + x)
    return F.transform(e, lambda x: x / total)


def argmax(arr) -> Column:
    """0-based position of the first maximum."""
    a = _c(arr)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def probs_map(labels, probs) -> Column:
    """label -> probability map from two aligned arrays."""
    return F.map_from_arrays(_c(labels), _c(probs))


def mean_vectors(df: DataFrame, key: str, vec: str = "embedding", out: str = "embedding") -> DataFrame:
    """Element-wise mean vector per key (posexplode -> avg -> ordered re-collect)."""
    parts = (df.select(key, F.posexplode(vec).alias("pos", "x"))
             .groupBy(key, "pos").agg(F.avg(F.col("x").cast("double")).alias("m")))
    return (parts.groupBy(key)
            .agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("_s"))
            .select(key, F.transform("_s", lambda s: s["m"]).alias(out)))
