"""URL filter on a sorted digest array.

Rules are (verdict, host, path). A rule fits the urls of its host and of all
subdomains whose path starts with the rule's path; of the rules that fit, the
longest (host and path together, then the longer host) gives the verdict.

1. ``compile_rules`` lays a rule list out as one flat file: 64-bit xxhash keys
   of host + path in ascending order, the full strings they stand for, and a
   second sorted array with the keys of the hosts and the path lengths that
   occur under each. The file lies in ``spark.checkpoint.dir`` and goes to the
   executors as a Spark file; every worker memory-maps it, so the workers of a
   machine share its pages.
2. Urls are cut into host and path by built-in functions. Per Arrow batch all
   label suffixes of the distinct hosts are hashed and probed by a vectorised
   binary search; only hosts that hit build path prefixes, of the lengths known
   for the host, and probe the key array. Every hit is confirmed against the
   stored string, so colliding digests never decide.

A list whose counted strings pass ``MAX_INDEX_BYTES`` is not compiled: its rules
stay a table and meet the urls in equality joins (host, then host + path).

Edge cases: a null url, or one without ``://``, has an empty host and path and
fits no rule; an empty path starts with no rule's path but the empty one; a rule
whose verdict or host is null or whose host is empty fits nothing; a null rule
path is empty; of equal rules with different verdicts ``block`` wins; repeated
urls repeat their row; an empty rule list gives every url the default verdict;
an empty table gives an empty result. Only own columns are returned.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

MAX_INDEX_BYTES = 256 << 20
VERDICTS = ("allow", "block")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULE_SCHEMA = "verdict string, host string, path string"


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """(page_id, host, path) of every row."""
    cut = lambda group: F.coalesce(F.regexp_extract(F.col(url), r"^[\s\S]*?://([^/?#]*)([^?#]*)", group), F.lit(""))
    return pages.select("page_id", F.translate(cut(1), UPPER, LOWER).alias("host"), cut(2).alias("path"))


def plain_rules(rules: DataFrame) -> DataFrame:
    """One row per (host, path): verdict, host, path."""
    known = rules.where(F.col("verdict").isin(*VERDICTS) & (F.col("host") != "")).select("verdict", F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"))
    return known.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # "block" sorts after "allow"


def digests(strings: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass")) for s in strings), np.uint64, len(strings))


def layout(hosts: list[str], paths: list[str], verdicts: list[str]) -> bytes:
    """The index as bytes: five counts, then the arrays, then the strings."""
    full = [h + p for h, p in zip(hosts, paths)]
    keys = digests(full)
    order = np.argsort(keys, kind="stable")
    raw = [full[i].encode("utf-8", "surrogatepass") for i in order]
    ends = np.cumsum([0, *map(len, raw)], dtype=np.int64)
    host_chars = np.array([len(hosts[i]) for i in order], dtype=np.int64)
    codes = np.array([VERDICTS.index(verdicts[i]) for i in order], dtype=np.int64)
    lengths = sorted({(h, len(p)) for h, p in zip(hosts, paths)})
    host_keys = digests([h for h, _ in lengths])
    by_host = np.argsort(host_keys, kind="stable")
    path_chars = np.array([n for _, n in lengths], dtype=np.int64)
    head = np.array([len(keys), len(lengths), ends[-1]], dtype=np.int64)
    arrays = (head, keys[order], ends, host_chars, codes, host_keys[by_host], path_chars[by_host])
    return b"".join([*(a.tobytes() for a in arrays), *raw])


class Index:
    """A memory-mapped index; arrays are views of the map."""

    def __init__(self, path: str):
        self.map = np.memmap(path, np.uint8, "r")
        n, hosts, _ = self.map[:24].view(np.int64).tolist()
        at = 24
        parts = []
        for count, kind in ((n, np.uint64), (n + 1, np.int64), (n, np.int64), (n, np.int64), (hosts, np.uint64), (hosts, np.int64)):
            parts.append(self.map[at : at + 8 * count].view(kind))
            at += 8 * count
        self.keys, self.ends, self.host_chars, self.codes, self.host_keys, self.path_chars = parts
        self.strings = self.map[at:]

    def full(self, i: int) -> bytes:
        return self.strings[self.ends[i] : self.ends[i + 1]].tobytes()

    def best(self, hosts: list[str], paths: list[str]) -> list[tuple[int, int] | None]:
        """Per url the rule that wins, as (rule number, where its host starts in the url's host), or None."""
        out: list[tuple[int, int] | None] = [None] * len(hosts)
        names = list(dict.fromkeys(hosts))
        suffixes, owner, start = [], [], []
        for k, name in enumerate(names):
            at = 0
            while at < len(name):
                suffixes.append(name[at:])
                owner.append(k)
                start.append(at)
                dot = name.find(".", at)
                at = len(name) if dot < 0 else dot + 1
        probe = digests(suffixes)
        low, high = np.searchsorted(self.host_keys, probe, "left"), np.searchsorted(self.host_keys, probe, "right")
        wanted: dict[str, list[tuple[str, int, int]]] = {}
        for j in np.flatnonzero(high > low):
            wanted.setdefault(names[owner[j]], []).extend((suffixes[j], start[j], int(n)) for n in np.unique(self.path_chars[low[j] : high[j]]))
        rows, texts, starts, host_len = [], [], [], []
        for i, (h, p) in enumerate(zip(hosts, paths)):
            for suffix, at, n in wanted.get(h, ()):
                if n <= len(p):
                    rows.append(i)
                    texts.append(suffix + p[:n])
                    starts.append(at)
                    host_len.append(len(suffix))
        probe = digests(texts)
        low, high = np.searchsorted(self.keys, probe, "left"), np.searchsorted(self.keys, probe, "right")
        longest: dict[int, tuple[int, int]] = {}
        for j in np.flatnonzero(high > low):
            raw, size = texts[j].encode("utf-8", "surrogatepass"), (len(texts[j]), host_len[j])
            for k in range(low[j], high[j]):
                if self.host_chars[k] == host_len[j] and self.full(k) == raw and size > longest.get(rows[j], (-1, -1)):
                    longest[rows[j]] = size
                    out[rows[j]] = (k, starts[j])
        return out


def compile_rules(rules: DataFrame) -> str | None:
    """Name of the Spark file that holds the index, or None where the list is too long to compile."""
    spark = rules.sparkSession
    size = rules.agg(F.sum(F.octet_length("host") * 2 + F.octet_length("path") + 64)).first()[0] or 0
    if size > MAX_INDEX_BYTES:
        return None
    rows = rules.collect()  # at most MAX_INDEX_BYTES, counted above
    raw = layout([r.host for r in rows], [r.path for r in rows], [r.verdict for r in rows])
    name = f"url-rules-{uuid.uuid4().hex[:12]}"
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tagtrail"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    out = target.getFileSystem(conf).create(target)
    try:
        for at in range(0, len(raw), 1 << 22):
            out.write(bytearray(raw[at : at + (1 << 22)]))
    finally:
        out.close()
    spark.sparkContext.addFile(target.getFileSystem(conf).makeQualified(target).toString())
    return name


def _probe(parts: DataFrame, name: str, default: str) -> DataFrame:
    @F.pandas_udf("rule string, verdict string")
    def judge(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        index = Index(SparkFiles.get(name))
        for host, path in batches:
            found = index.best(host.tolist(), path.tolist())
            rule = [None if f is None else index.full(f[0]).decode("utf-8", "surrogatepass") for f in found]
            verdict = [default if f is None else VERDICTS[index.codes[f[0]]] for f in found]
            yield pd.DataFrame({"rule": pd.Series(rule, dtype=object), "verdict": pd.Series(verdict, dtype=object)})

    return parts.withColumn("judged", judge("host", "path")).select("page_id", "host", "path", "judged.rule", "judged.verdict")


def _joined(parts: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same answer by equality joins, for a rule list beyond the index's bound."""
    labels = F.split("host", r"\.")
    names = parts.where("host <> ''").select("host").distinct()
    suffixes = names.select("host", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))).alias("suffix")).where("suffix <> ''")
    lengths = rules.select(F.col("host").alias("suffix"), F.length("path").alias("n")).distinct()
    wanted = suffixes.join(lengths, "suffix")
    urls = parts.select("host", "path").distinct()
    tries = urls.join(wanted, "host").where(F.length("path") >= F.col("n")).select("host", "path", "suffix", F.expr("left(path, n)").alias("prefix"))
    rule = rules.select(F.col("host").alias("suffix"), F.col("path").alias("prefix"), "verdict")
    hit = tries.join(rule, ["suffix", "prefix"]).select("host", "path", F.struct((F.length("suffix") + F.length("prefix")).alias("size"), F.length("suffix").alias("host_size"), F.concat("suffix", "prefix").alias("rule"), "verdict").alias("r"))
    best = hit.groupBy("host", "path").agg(F.max("r").alias("r"))
    return parts.join(best, ["host", "path"], "left").select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", F.lit(default)).alias("verdict"))


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page; ``rule`` is the winning rule's host + path."""
    parts, known = with_parts(pages, url), plain_rules(rules)
    name = compile_rules(known)
    return _joined(parts, known, default) if name is None else _probe(parts, name, default)


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, RULE_SCHEMA)
