"""Tag vectors and product similarity (V1-V4)."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import prepared, ratio_udf
from ..session import cut_lineage


def tag_counts(tags: DataFrame, key: str = "pid", col: str = "tags", max_len: int | None = None) -> DataFrame:
    """V1 (long form): (pid, tag, n) -- the sparse count vector of each product."""
    arr = F.slice(col, 1, max_len) if max_len else F.col(col)
    return tags.select(key, F.explode(arr).alias("tag")).groupBy(key, "tag").agg(F.count(F.lit(1)).alias("n"))


def cosine(counts: DataFrame, key: str = "pid") -> DataFrame:
    """V2: cosine of count vectors for every pair sharing a tag (both
    orders) plus the unit diagonal; pairs sharing nothing are 0 and omitted.
    Use on a bounded product set (the heat-map sample)."""
    norms = counts.groupBy(key).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    a = counts.select(F.col(key).alias("a"), "tag", F.col("n").alias("na"))
    b = counts.select(F.col(key).alias("b"), "tag", F.col("n").alias("nb"))
    dots = a.join(b, "tag").groupBy("a", "b").agg(F.sum(F.col("na") * F.col("nb")).alias("dot"))
    na = norms.select(F.col(key).alias("a"), F.col("norm").alias("norm_a"))
    nb = norms.select(F.col(key).alias("b"), F.col("norm").alias("norm_b"))
    out = dots.join(na, "a").join(nb, "b")
    sim = F.when(F.col("a") == F.col("b"), F.lit(1.0)).otherwise(F.col("dot") / (F.col("norm_a") * F.col("norm_b")))
    return out.select(F.col("a").alias(f"{key}_a"), F.col("b").alias(f"{key}_b"), F.round(sim, 6).alias("cosine"))


def vector_classes(counts: DataFrame, key: str = "pid") -> DataFrame:
    """(key, rep): products with the same count vector share the smallest of their keys."""
    whole = counts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("tag", "n"))).alias("v"))
    reps = whole.groupBy("v").agg(F.min(key).alias("rep"))
    return whole.join(reps, "v").select(key, "rep")


def cosine_above(counts: DataFrame, share: Fraction, key: str = "pid") -> DataFrame:
    """V2 as a similarity join: (a, b, cosine), a < b, of all pairs of different count vectors whose cosine is at least
    ``share``. Equal vectors (``vector_classes``) take part once, by their smallest key.

    Tags are ordered by rarity over all vectors. A vector's prefix are its tags, rarest first, as long as the norm of
    the rest, the tag itself included, reaches ``share`` of its whole norm: vectors that share no prefix tag have a
    smaller cosine (Cauchy-Schwarz), so only prefix tags are joined, and a frequent tag joins little. Candidates are
    verified exactly, in integers, on the whole vectors. Vectors without a tag link with nothing."""
    reps = vector_classes(counts, key)
    rows = cut_lineage(counts.join(reps.where(F.col(key) == F.col("rep")).select(key), key).select(F.col(key).alias("k"), "tag", F.col("n").cast("decimal(19,0)").alias("n")), "cosine-vectors")
    df = rows.groupBy("tag").agg(F.count(F.lit(1)).alias("df"))
    p, q = (F.lit(x).cast("decimal(9,0)") for x in (share.numerator, share.denominator))
    whole = Window.partitionBy("k")
    upto = whole.orderBy(F.desc("df"), F.desc("tag")).rowsBetween(Window.unboundedPreceding, 0)  # from the most frequent tag to this one
    ordered = rows.join(df, "tag").withColumn("rest", F.sum(F.col("n") * F.col("n")).over(upto)).withColumn("norm2", F.sum(F.col("n") * F.col("n")).over(whole))
    prefix = ordered.where(q * q * F.col("rest") >= p * p * F.col("norm2"))
    a = prefix.select(F.col("k").alias("a"), "tag")
    b = prefix.select(F.col("k").alias("b"), "tag")
    pairs = a.join(b, "tag").where("a < b").select("a", "b").distinct()
    left = rows.select(F.col("k").alias("a"), "tag", F.col("n").alias("na"))
    right = rows.select(F.col("k").alias("b"), "tag", F.col("n").alias("nb"))
    dots = pairs.join(left, "a").join(right, ["b", "tag"]).groupBy("a", "b").agg(F.sum(F.col("na") * F.col("nb")).cast("decimal(19,0)").alias("dot"))
    norms = rows.groupBy("k").agg(F.sum(F.col("n") * F.col("n")).cast("decimal(19,0)").alias("norm2"))
    out = dots.join(norms.select(F.col("k").alias("a"), F.col("norm2").alias("n2a")), "a").join(norms.select(F.col("k").alias("b"), F.col("norm2").alias("n2b")), "b")
    near = out.where((q * F.col("dot")) * (q * F.col("dot")) >= (p * F.col("n2a")) * (p * F.col("n2b")))
    cosine = F.col("dot").cast("double") / F.sqrt(F.col("n2a").cast("double") * F.col("n2b").cast("double"))
    return near.select(F.col("a").alias(f"{key}_a"), F.col("b").alias(f"{key}_b"), F.round(cosine, 6).alias("cosine"))


def fuzzy_matrix(tags: DataFrame, key: str = "pid", col: str = "tags") -> DataFrame:
    """V3: token-sort similarity / 100 of the joined tag strings for every
    pair of a BOUNDED product set (callers pass a sample), mirrored, with a
    unit diagonal. The pair set is the feature: it is quadratic in the sample
    size by definition, never in the data size."""
    s = tags.select(F.col(key).alias("k"), prepared(F.array_join(col, " "), "sort").alias("s"))
    x, y = s.alias("x"), s.alias("y")
    pairs = x.join(F.broadcast(y), F.col("x.k") < F.col("y.k")).select(
        F.col("x.k").alias("a"), F.col("y.k").alias("b"), (ratio_udf("x.s", "y.s") / 100.0).alias("sim")
    )
    mirrored = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim"))
    diag = s.select(F.col("k").alias("a"), F.col("k").alias("b"), F.lit(1.0).alias("sim"))
    return mirrored.unionByName(diag).select(F.col("a").alias(f"{key}_a"), F.col("b").alias(f"{key}_b"), "sim")


def projection_2d(tags: DataFrame, key: str = "pid", col: str = "tags", vocab_size: int = 1 << 16) -> DataFrame:
    """V4: 2-D PCA projection of the count vectors (re-aimed from t-SNE).
    The vocabulary is capped by ``vocab_size`` (most frequent terms), which
    bounds the covariance matrix PCA builds."""
    from pyspark.ml.feature import PCA, CountVectorizer
    from pyspark.ml.functions import vector_to_array

    cv = CountVectorizer(inputCol=col, outputCol="_v", vocabSize=vocab_size).fit(tags)
    vec = cv.transform(tags)
    pca = PCA(k=2, inputCol="_v", outputCol="_p").fit(vec)
    proj = pca.transform(vec).select(key, vector_to_array("_p").alias("_a"))
    return proj.select(key, F.round(F.col("_a")[0], 6).alias("x"), F.round(F.col("_a")[1], 6).alias("y"))
