"""Training-order materialisation of token ids.

Texts are tokenised with a public vocabulary file (its path is a parameter;
nothing is trained) and cut into sequences of ``stride`` ids, the last one of a
document padded. The sequences are written once to the shared folder together
with their partition and place; the partitions' counts give every sequence an
index in 0..N-1, and a keyed Feistel network over the next even power of two,
walked until it lands below N, turns the index into its slot. Slots are range
partitioned and written as shards of ``shard_slots`` sequences, each one
fixed-stride block of little-endian 16-bit ids: slot s starts at byte
(s mod shard_slots) * stride * 2 of shard s div shard_slots, so a reader can
resume at any slot.

Edge cases: null and empty texts give no sequence; very long texts give many;
repeated rows are sequences of their own; a null doc_id stays null; extra
columns are ignored; an empty table gives no shard.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import TEXT_BATCH_BYTES, small_batches

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# fixed: the split pattern of the byte-level vocabulary
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PAD = 50256  # free id of the vocabulary
STRIDE = 512
SHARD_SLOTS = 4096
ROUNDS = 6
VOCABULARY_BYTES = 32 << 20
CHUNK = 1 << 16  # characters tokenised at once; cut before a space so that ids are those of the whole text


def read_vocabulary(path: str) -> bytes:
    """The vocabulary file, read on the driver and sent to the tasks; at most ``VOCABULARY_BYTES``."""
    with open(path, "rb") as f:
        raw = f.read(VOCABULARY_BYTES + 1)
    if len(raw) > VOCABULARY_BYTES:
        raise ValueError(f"{path} has more than {VOCABULARY_BYTES} bytes")
    return raw


def encoder(vocabulary: bytes):
    """The tokenizer of a vocabulary, made once per task."""
    import tiktoken

    ranks = {base64.b64decode(t): int(i) for t, i in (line.split() for line in vocabulary.splitlines())}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_ids(text: str, enc) -> np.ndarray:
    """Ids of a whole text; long texts in pieces that end between a letter and a space."""
    out, at = [], 0
    while at < len(text):
        end = at + CHUNK
        if end < len(text):
            while end < len(text) and not (text[end] == " " and text[end - 1].isalpha()):
                end += 1
        out += enc.encode_ordinary(text[at:end])
        at = end
    return np.array(out, dtype=np.uint16)


def sequences(docs: DataFrame, stride: int, vocabulary: str) -> DataFrame:
    """(part, place, doc_id, seq, n_ids, ids): one row per sequence of a document."""
    small_batches(docs.sparkSession, TEXT_BATCH_BYTES)
    raw = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def cut(batches):
        part, place = TaskContext.get().partitionId(), 0
        enc = encoder(raw.value)
        for pdf in batches:
            rows, size = [], 0
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                if not isinstance(text, str) or not text:
                    continue
                ids = token_ids(text, enc)
                for seq, at in enumerate(range(0, len(ids), stride)):
                    piece = ids[at : at + stride]
                    rows.append((part, place, None if pd.isna(doc) else int(doc), seq, len(piece), piece.astype("<u2").tobytes()))
                    place += 1
                    size += len(piece)
                if size > 1 << 20:
                    yield frame(rows)
                    rows, size = [], 0
            yield frame(rows)

    def frame(rows):
        out = pd.DataFrame(rows, columns=["part", "place", "doc_id", "seq", "n_ids", "ids"])
        return out.astype({"doc_id": "Int64"})

    return docs.select("doc_id", "text").mapInPandas(cut, "part int, place long, doc_id long, seq int, n_ids int, ids binary")


def feistel_slots(index: np.ndarray, n: int, key: str) -> np.ndarray:
    """Slot of each index under the keyed permutation of 0..n-1."""
    if n <= 1:
        return index.astype(np.int64)
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [np.uint64(int.from_bytes(hashlib.blake2b(f"{key}:{r}".encode(), digest_size=8).digest(), "little")) for r in range(ROUNDS)]

    def once(x):
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            h = (right ^ k) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            left, right = right, left ^ ((h >> np.uint64(29)) & mask)
        return (left << np.uint64(half)) | right

    x = once(index.astype(np.uint64))
    out = np.flatnonzero(x >= np.uint64(n))
    while len(out):  # walk the cycle until the value is a slot; under four steps are expected
        x[out] = once(x[out])
        out = out[x[out] >= np.uint64(n)]
    return x.astype(np.int64)


def ordered(docs: DataFrame, key: str = "epoch-0", stride: int = STRIDE, vocabulary: str = VOCABULARY) -> tuple[DataFrame, int]:
    """All sequences with their global slot, and their number."""
    seqs = cut_lineage(sequences(docs, stride, vocabulary), "shard-sequences")
    parts = seqs.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect()  # one small row per partition
    starts, n = {}, 0
    for p in parts:
        starts[p.part] = n
        n += p.n
    spark = docs.sparkSession
    # from a list, Spark would send the rows through Python workers of another kind, with a daemon of their own in each executor
    first = spark.createDataFrame(pa.table({"part": pa.array(list(starts), pa.int32()), "first": pa.array(list(starts.values()), pa.int64())}))

    @F.pandas_udf("long")
    def slot(index: pd.Series) -> pd.Series:
        return pd.Series(feistel_slots(index.to_numpy(np.int64), n, key))

    placed = seqs.join(F.broadcast(first), "part")
    return placed.withColumn("slot", slot(F.col("first") + F.col("place"))).drop("part", "place", "first"), n


def shards(placed: DataFrame, n: int, stride: int = STRIDE, shard_slots: int = SHARD_SLOTS, pad: int = PAD) -> DataFrame:
    """One row per shard, in slot order: shard, first_slot, n_slots, stride (bytes),
    doc_ids, seqs, n_ids (per slot) and data. A task holds one shard at a time."""
    n_shards = -(-n // shard_slots) if n else 1

    def write(batches):
        now, rows = None, []

        def block():
            rows.sort(key=lambda r: r[0])
            fill = np.uint16(pad).astype("<u2").tobytes()
            data = b"".join(r[4] + fill * (stride - r[3]) for r in rows)
            return pd.DataFrame({
                "shard": [now], "first_slot": [now * shard_slots], "n_slots": [len(rows)], "stride": [stride * 2],
                "doc_ids": [[r[1] for r in rows]], "seqs": [[r[2] for r in rows]], "n_ids": [[r[3] for r in rows]], "data": [data],
            })

        for pdf in batches:
            doc = [None if pd.isna(x) else int(x) for x in pdf["doc_id"]]
            for slot, d, seq, k, ids in zip(pdf["slot"].tolist(), doc, pdf["seq"].tolist(), pdf["n_ids"].tolist(), pdf["ids"]):
                if slot // shard_slots != now and rows:
                    yield block()
                    rows = []
                now = slot // shard_slots
                rows.append((slot, d, seq, k, bytes(ids)))
        if rows:
            yield block()

    ranged = placed.withColumn("shard", F.expr(f"slot div {shard_slots}")).repartitionByRange(max(1, min(n_shards, 10_000)), "shard")
    ranged = ranged.sortWithinPartitions("slot").select("slot", "doc_id", "seq", "n_ids", "ids")
    return ranged.mapInPandas(write, "shard long, first_slot long, n_slots int, stride int, doc_ids array<long>, seqs array<int>, n_ids array<int>, data binary")


def materialise(docs: DataFrame, key: str = "epoch-0", stride: int = STRIDE, shard_slots: int = SHARD_SLOTS, vocabulary: str = VOCABULARY) -> DataFrame:
    """The shards of ``docs``."""
    placed, n = ordered(docs, key, stride, vocabulary)
    return shards(placed, n, stride, shard_slots)


def write_shards(docs: DataFrame, path: str, **options) -> DataFrame:
    """Write the shards of ``docs`` as a table at ``path`` (any store Spark writes to); returns it reread."""
    materialise(docs, **options).write.mode("overwrite").parquet(path)
    return docs.sparkSession.read.parquet(path)


def read_slots(spark: SparkSession, path: str, start: int, stop: int, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """(slot, ids binary) of slots start..stop-1: only the shards that hold them are read."""
    table = spark.read.parquet(path).where(F.col("shard").between(start // shard_slots, max(start, stop - 1) // shard_slots))
    rows = table.select("first_slot", "stride", "data", F.explode(F.sequence(F.lit(0), F.col("n_slots") - 1)).alias("i"))
    ids = F.substring(F.col("data"), F.col("i") * F.col("stride") + 1, F.col("stride"))
    return rows.select((F.col("first_slot") + F.col("i")).alias("slot"), ids.alias("ids")).where(F.col("slot").between(start, stop - 1))
