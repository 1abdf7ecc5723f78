"""Vector retrieval with array functions: cosine, sparse codes, int8 quantisation, centroids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column | str, b: Column | str) -> Column:
    """0 for vectors of different size, empty ones and zero ones."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (F.size(a) <= 0) | (n == 0), 0.0).otherwise(dot(a, b) / n)


def knn(vectors: DataFrame, query_id: int, *carried: str) -> DataFrame:
    """vec_id, score and the carried columns of every vector but the query's, whose one row is broadcast."""
    q = vectors.where(F.col("vec_id") == query_id).select(F.col("embedding").alias("q")).limit(1)
    return vectors.where(F.col("vec_id") != query_id).join(F.broadcast(q)).select("vec_id", F.round(cosine("embedding", "q"), 6).alias("score"), *carried)


def sketch(v: Column | str, dims: int = 32) -> Column:
    """struct(scale, codes): successive components averaged to so many dimensions, in steps of the largest over 127."""
    v = F.col(v) if isinstance(v, str) else v
    width = F.size(v) / dims
    pooled = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.aggregate(F.slice(v, (i * width).cast("int") + 1, width.cast("int")), F.lit(0.0), lambda a, x: a + x) / width)
    scale = F.array_max(F.transform(pooled, F.abs)) / 127
    codes = F.transform(pooled, lambda x: F.when(scale == 0, 0).otherwise(F.greatest(F.lit(-127), F.least(F.lit(127), F.round(x / scale)))).cast("int"))
    return F.struct(scale.alias("scale"), codes.alias("codes"))


def hopfield(vectors: DataFrame, probe: int, beta: float, steps: int) -> DataFrame:
    """dim, value of a state that moves, step by step, to the mean of all vectors weighted by softmax of their likeness.

    The state is one row; a step is one pass over the vectors, combined before the shuffle.
    """
    state = vectors.where(F.col("vec_id") == probe).select(F.col("embedding").alias("s")).limit(1)
    for _ in range(steps):
        weighed = vectors.join(F.broadcast(state)).select("embedding", F.exp(beta * (cosine("embedding", "s") - 1)).alias("w"))
        dims = weighed.select("w", F.posexplode("embedding").alias("dim", "x")).groupBy("dim").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("v"))
        own = F.transform(F.array_sort(F.collect_list(F.struct("dim", "v"))), lambda x: x["v"])
        mean = dims.agg(own.alias("m"))
        state = mean.select(F.transform("m", lambda x: x / norm(F.col("m"))).alias("s"))
    return state.select(F.posexplode("s").alias("dim", "value")).select("dim", F.round("value", 5).alias("value"))


def resonate(vectors: DataFrame, probe: int, k: int, passes: int, keep: float = 0.7) -> DataFrame:
    """vec_id, score of the k vectors nearest to a question that each pass moves towards the mean of the k found.

    The question is one row; a pass is one scan for the k nearest and one for their mean.
    """
    first = vectors.where(F.col("vec_id") == probe).select(F.col("embedding").alias("s")).limit(1)
    others, state = vectors.where(F.col("vec_id") != probe), first

    def nearest(s: DataFrame) -> DataFrame:
        scored = others.join(F.broadcast(s)).select("vec_id", "embedding", cosine("embedding", "s").alias("score"))
        return scored.orderBy(F.desc(F.round("score", 6)), "vec_id").limit(k)

    for _ in range(passes):
        dims = nearest(state).select(F.posexplode("embedding").alias("dim", "x")).groupBy("dim").agg(F.avg("x").alias("m"))
        mean = dims.agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda x: x["m"]).alias("m"))
        moved = mean.join(F.broadcast(first)).select(F.zip_with("s", "m", lambda a, b: keep * a + (1 - keep) * b).alias("u"))
        state = moved.select(F.transform("u", lambda x: x / norm(F.col("u"))).alias("s"))
    return nearest(state).select("vec_id", F.round("score", 5).alias("score"))


def _largest(v: Column) -> Column:
    """Components by absolute value, largest first; ties go to the smaller index."""
    return F.array_sort(F.transform(v, lambda x, i: F.struct((-F.round(F.abs(x), 9)).alias("m"), i.alias("i"))))


def sparse_code(v: Column | str, share: float = 0.05) -> Column:
    """Indices (from 0, sorted) of the components of largest absolute value; ties go to the smaller index."""
    v = F.col(v) if isinstance(v, str) else v
    ranked = _largest(v)
    n = F.greatest(F.floor(F.size(v) * F.lit(share)), F.lit(1)).cast("int")
    return F.array_sort(F.transform(F.slice(ranked, 1, n), lambda s: s["i"]))


def overlap(a: Column, b: Column) -> Column:
    """Intersection over union of two index sets; 1 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def quantised(v: Column | str) -> Column:
    """struct(scale, offset, codes): range / 254 steps around the middle, codes clamped to +-127."""
    low, high = F.array_min(v), F.array_max(v)
    scale, offset = (high - low) / 254, (high + low) / 2
    codes = F.transform(v, lambda x: F.when(scale == 0, 0).otherwise(F.greatest(F.lit(-127), F.least(F.lit(127), F.round((x - offset) / scale)))).cast("int"))
    return F.struct(scale.alias("scale"), offset.alias("offset"), codes.alias("codes"))


def centroids(vectors: DataFrame, key: str = "label") -> DataFrame:
    """key, n, centroid: mean of each dimension, combined before the shuffle."""
    parts = vectors.select(key, F.posexplode("embedding").alias("i", "x")).groupBy(key, "i").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    # One row for each class and dimension.
    return parts.groupBy(key).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centroid"))
