"""Benchmark decontamination as a prefix-filtered set join (DataFrame functions only).

Every benchmark item is cut into windows of ``size`` words (an item of fewer
words is one window). A window occurs in a document only if all its words do,
so with the words ordered by rarity - counted over the whole corpus - the
necessary prefix is its rarest word: document words join the windows on that
word, positional and length bounds drop impossible starts, and the rest is
verified word for word. Words of a document are exploded once and dropped at
the join; only verified starts are shuffled.

The benchmark's windows are broadcast when their measured size is within
``BROADCAST_BYTES``; a larger benchmark goes through a shuffle join whose rows
carry only the words around the position.

Edge cases: null or wordless texts have no words and no hits; a null item or an
item without words gives no window; repeated items and repeated documents
(same id and text) keep one result each; a null doc_id is a document like any
other; a null item_id takes part in hits and counts in no item list; extra
columns are ignored; empty tables give no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import small_side

SIZE = 13
BROADCAST_BYTES = 64 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words of a text: A-Z lower-cased, runs of letters, digits and non-ASCII characters."""
    plain = F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))
    return F.coalesce(F.array_remove(F.split(plain, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), ""), F.array().cast("array<string>"))


def windows(items: DataFrame, size: int) -> DataFrame:
    """Distinct (window, n, item_id): the window as its words joined by a space."""
    w = items.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(size))
    start = w.select("item_id", "w", n.alias("n"), F.explode(F.sequence(F.lit(1), F.size("w") - n + 1)).alias("s"))
    return start.select("item_id", F.concat_ws(" ", F.slice("w", F.col("s"), F.col("n"))).alias("window"), "n").distinct()


def probes(docs: DataFrame, wins: DataFrame, broadcast: bool) -> DataFrame:
    """(word, at, window, n): the rarest word of each distinct window and its place."""
    distinct = wins.select("window", "n").distinct()
    places = distinct.select("window", "n", F.posexplode(F.split("window", " ")).alias("at", "word"))
    known = places.select("word").distinct()
    spread = docs.select(F.explode(words(F.col("text"))).alias("word"))
    counts = spread.join(F.broadcast(known) if broadcast else known, "word").groupBy("word").agg(F.count("*").alias("freq"))
    ranked = places.join(counts, "word", "left").select("window", "n", F.struct(F.coalesce("freq", F.lit(0).cast("long")).alias("freq"), "word", "at").alias("p"))
    return ranked.groupBy("window", "n").agg(F.min("p").alias("p")).where("p.freq > 0").select(F.col("p.word").alias("word"), F.col("p.at").alias("at"), "window", "n")


def occurrences(docs: DataFrame, items: DataFrame, size: int = SIZE, broadcast_bytes: int = BROADCAST_BYTES) -> tuple[DataFrame, DataFrame]:
    """Verified (doc_id, text_key, n_words, start, n, window) and the windows of the items."""
    wins = cut_lineage(windows(items, size), "decon-windows")
    measured = wins.agg(F.sum(F.length("window") * 2 + 64)).first()[0] or 0
    small = int(measured) * (size + 1) <= broadcast_bytes  # one place row per word in the worst case
    probe = cut_lineage(probes(docs, wins, small), "decon-probes")
    w = docs.select("doc_id", F.xxhash64("text").alias("text_key"), words(F.col("text")).alias("w")).withColumn("n_words", F.size("w"))
    if small:
        spots = w.select("doc_id", "text_key", "n_words", "w", F.posexplode("w").alias("pos", "word"))
        found = spots.join(F.broadcast(probe), "word").withColumn("start", F.col("pos") - F.col("at"))
        seen = F.slice("w", F.col("start") + 1, F.col("n"))
    else:
        spots = w.select("doc_id", "text_key", "n_words", "w", F.posexplode("w").alias("pos", "word"))
        first = F.greatest(F.col("pos") - (size - 1), F.lit(0))
        spots = spots.select("doc_id", "text_key", "n_words", "pos", "word", first.alias("first"), F.slice("w", first + 1, F.lit(2 * size - 1)).alias("near"))
        found = spots.join(probe, "word").withColumn("start", F.col("pos") - F.col("at"))
        seen = F.slice("near", F.col("start") - F.col("first") + 1, F.col("n"))
    fits = found.where((F.col("start") >= 0) & (F.col("start") + F.col("n") <= F.col("n_words")))
    return fits.where(F.concat_ws(" ", seen) == F.col("window")).select("doc_id", "text_key", "n_words", "start", "n", "window"), wins


def contamination(docs: DataFrame, items: DataFrame, size: int = SIZE, share: int = 20, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per document with a hit (doc_id, text_key): n_words, n_hit, n_items, items_sha256, contaminated."""
    found, wins = occurrences(docs, items, size, broadcast_bytes)
    found = cut_lineage(found.distinct(), "decon-hits")
    key = ["doc_id", "text_key"]
    zero = F.struct(F.lit(0).alias("hit"), F.lit(0).alias("upto"))
    step = lambda a, x: F.struct(
        (a["hit"] + F.greatest(F.lit(0), x["start"] + x["n"] - F.greatest(a["upto"], x["start"]))).alias("hit"),
        F.greatest(a["upto"], x["start"] + x["n"]).alias("upto"),
    )
    spans = found.groupBy(*key).agg(F.max("n_words").alias("n_words"), F.array_sort(F.collect_set(F.struct("start", "n"))).alias("spans"))
    hit = spans.select(*key, "n_words", F.aggregate("spans", zero, step)["hit"].alias("n_hit"))
    named = found.select(*key, "window").distinct().join(wins.select("window", "item_id"), "window").select(*key, "item_id").distinct()
    items_of = named.groupBy(*key).agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("ids")).select(*(F.col(c).alias(f"{c}_2") for c in key), "ids")
    both = hit.join(items_of, hit.doc_id.eqNullSafe(items_of.doc_id_2) & hit.text_key.eqNullSafe(items_of.text_key_2), "left")
    return both.select(
        *key, "n_words", "n_hit", F.size("ids").alias("n_items"), F.sha2(F.concat_ws(",", "ids"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.lit(share) * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def report(docs: DataFrame, items: DataFrame, size: int = SIZE, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per document, with or without hits."""
    hits = cut_lineage(contamination(docs, items, size, broadcast_bytes=broadcast_bytes), "decon-report")
    hits = hits.drop("n_words").withColumnsRenamed({"doc_id": "id", "text_key": "key"})
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    out = rows.join(hits, rows.doc_id.eqNullSafe(hits.id) & (rows.text_key == hits.key), "left")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), F.coalesce("contaminated", F.lit(False)).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, size: int = SIZE) -> DataFrame:
    """``docs`` without its contaminated rows; all columns stay."""
    hits = cut_lineage(contamination(docs, items, size).where("contaminated").select(F.col("doc_id").alias("__hit_doc"), F.col("text_key").alias("__hit_text")), "decon-drop")
    hits = small_side(hits)
    return docs.join(hits, docs["doc_id"].eqNullSafe(hits["__hit_doc"]) & (F.xxhash64(docs["text"]) == hits["__hit_text"]), "left_anti")
