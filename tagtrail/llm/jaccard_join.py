"""N-gram Jaccard join with signature trees.

1. Every document becomes the set of 64-bit hashes of its word shingles;
   equal sets share a node id (a digest of the set), so copies are one node.
2. Candidate blocks: hashed shingle counts over all documents give one global
   order (rare first); two sets of Jaccard >= t share a shingle among their
   first |x| - ceil(t |x|) + 1 shingles. Shingles with the same nodes count
   once. Among the nodes of a shingle a bitmap per node bounds every overlap
   from above (bits of x that y lacks are shingles that y lacks); nodes that
   pass hang together as one candidate. Above ``GROUP_MAX`` nodes of a shingle
   all hang on its smallest node, unfiltered. Connected candidates form a
   cluster; no pairs leave a task.
3. Inside a cluster a signature tree holds, per tree node, the OR of its
   members' shingle bitmaps (counts where shingles share a bit) and the range
   of their sizes. A dual traversal drops a pair of tree nodes whose largest
   possible overlap or size ratio cannot reach t, and leaves are verified
   exactly. A cluster above ``BLOCK_SHINGLES`` is cut into size classes and
   hash blocks, and pairs of blocks are tasks of their own.
4. Verified links leave a task as (node, local root) and a count, not as
   pairs; components are closed with star rounds.

Edge cases: null or blank texts have the empty set (0 shingles), link with
nothing and are their own component; texts of fewer words than a shingle have
one shingle, the whole sequence; rows that repeat a doc_id are documents of
their own and count as copies or not by their text; a null doc_id takes part
but never names a component unless nothing else is there (then null); extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import TEXT_BATCH_BYTES, connected_components, small_batches, small_side

COUNT_BITS = 20  # the table of hashed shingle counts has 2**COUNT_BITS cells, whatever the input
COUNT_CHUNKS = 64
BLOCK_SHINGLES = 200_000
LEAF, FANOUT, BITS = 32, 8, 8192
STRETCH = 1 << 16  # bytes hashed at once
PAIR_CELLS = 1 << 22  # bitmap cells multiplied at once
PAIR_ROWS = 512  # bitmaps multiplied at once, by as many
GROUP_MAX = 1000
PACK_ROWS = 5_000
PRIME = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
BYTE_CODE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)
SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers 0..n-1 of the prime and its inverse; tables of up to STRETCH + 1 entries are kept."""
    if len(_powers[0]) >= n:
        return [t[:n] for t in _powers]
    size = max(n, min(STRETCH + 1, 1 << n.bit_length()))
    tables = []
    for base in (PRIME, INVERSE):
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        tables.append(np.cumprod(steps))
    if size <= STRETCH + 1:
        _powers[:] = tables
    return [t[:n] for t in tables]


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hash of each word; A-Z lower-cased, words end at ASCII white space."""
    if not text:
        return np.empty(0, np.uint64)
    b = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), dtype=np.uint8)  # bytes.lower() knows A-Z only
    gap = SPACE[b]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):  # a stretch of words at a time
        base = start[i]
        j = max(i + 1, int(np.searchsorted(end, base + STRETCH, "right")))
        part = BYTE_CODE[b[base : end[j - 1]]]
        up, down = _power_tables(len(part) + 1)
        run = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up[1:], out=run[1:])
        out[i:j] = (run[end[i:j] - base] - run[start[i:j] - base]) * down[start[i:j] - base]
        i = j
    return _mix(out)


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    w = word_hashes(text)
    if not len(w):
        return w
    n = min(k, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for j in range(n):
        h = _mix(h * PRIME + w[j : j + len(h)])
    return np.unique(h)


def node_id(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def bitmap(s: np.ndarray) -> bytes:
    """Hashed shingles in a power of two of bits, at least as many as shingles and 64."""
    width = max(64, 1 << (len(s) - 1).bit_length())
    out = np.zeros(width, np.uint8)
    out[((s * PRIME) >> np.uint64(16)).astype(np.int64) & (width - 1)] = 1
    return np.packbits(out).tobytes()


def bounded_pairs(sizes: np.ndarray, bits: list[bytes], share: Fraction):
    """Yield (i, j) index arrays of the pairs whose bitmaps and sizes allow the share."""
    p, q = share.numerator, share.denominator
    widths = np.array([len(b) for b in bits])
    def dense(members, width, fold):
        x = np.unpackbits(np.frombuffer(b"".join(bits[i] for i in members), np.uint8).reshape(len(members), width), axis=1)
        return x if fold == 1 else x.reshape(len(members), fold, -1).max(axis=1)

    for w in np.unique(widths):
        a = np.flatnonzero(widths == w)
        step = max(1, min(PAIR_ROWS, PAIR_CELLS // (8 * int(w))))
        for wide in np.unique(widths[(widths >= w) & (p * widths < 2 * q * w)]):  # sizes differ by q / p at most, widths by less than twice that
            b, same = np.flatnonzero(widths == wide), wide == w
            for low in range(0, len(a), step):
                i0 = a[low : low + step]
                x = dense(i0, w, 1).astype(np.float32)
                for at in range(low if same else 0, len(b), step):
                    j0 = b[at : at + step]
                    y = dense(j0, wide, int(wide // w)).astype(np.float32)
                    both = x @ y.T
                    best = np.minimum(sizes[i0][:, None] - (x.sum(axis=1)[:, None] - both), sizes[j0][None, :] - (y.sum(axis=1)[None, :] - both))
                    i, j = np.nonzero((p + q) * best >= p * (sizes[i0][:, None] + sizes[j0][None, :]))
                    i, j = i0[i], j0[j]
                    keep = i < j if same else slice(None)
                    yield i[keep], j[keep]


def shingle_counts(docs: DataFrame, k: int) -> np.ndarray:
    """Counts of all documents' shingles in 2**COUNT_BITS hashed cells (a fixed size)."""
    small_batches(docs.sparkSession, TEXT_BATCH_BYTES)
    cells, width = 1 << COUNT_BITS, (1 << COUNT_BITS) // COUNT_CHUNKS

    def count(batches):
        total = np.zeros(cells, np.int64)
        for pdf in batches:
            for t in pdf["text"]:
                np.add.at(total, (shingle_set(t, k) >> np.uint64(64 - COUNT_BITS)).astype(np.int64), 1)
        for c in range(COUNT_CHUNKS):
            yield pd.DataFrame({"chunk": [c], "counts": [total[c * width : (c + 1) * width].tobytes()]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(width, np.int64)
        for raw in pdf["counts"]:
            total += np.frombuffer(raw, np.int64)
        return pd.DataFrame({"chunk": pdf["chunk"][:1], "counts": [total.tobytes()]})

    parts = docs.select("text").mapInPandas(count, "chunk int, counts binary")
    out = np.zeros(cells, np.int64)
    for row in parts.groupBy("chunk").applyInPandas(add, "chunk int, counts binary").collect():  # COUNT_CHUNKS rows
        out[row.chunk * width : (row.chunk + 1) * width] = np.frombuffer(row.counts, np.int64)
    return out


def sketches(docs: DataFrame, k: int, share: Fraction) -> DataFrame:
    """(doc_id, n_shingles, node, prefix, bits, row_key): node, prefix and bits are null for an empty set."""
    counts = docs.sparkSession.sparkContext.broadcast(shingle_counts(docs, k))

    def sketch(batches):
        for pdf in batches:
            n, node, prefix, bits = [], [], [], []
            for t in pdf["text"]:
                s = shingle_set(t, k)
                n.append(len(s))
                if not len(s):
                    node.append(None)
                    prefix.append(None)
                    bits.append(None)
                    continue
                need = -(-share.numerator * len(s) // share.denominator)
                rare = np.lexsort((s, counts.value[(s >> np.uint64(64 - COUNT_BITS)).astype(np.int64)]))
                node.append(node_id(s))
                prefix.append(s[rare[: len(s) - need + 1]].view(np.int64))
                bits.append(bitmap(s))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_shingles": n, "node": pd.array(node, dtype="Int64"), "prefix": prefix, "bits": bits, "row_key": pdf["row_key"]})

    return docs.select("doc_id", "text", F.xxhash64("text").alias("row_key")).mapInPandas(sketch, "doc_id long, n_shingles long, node long, prefix array<long>, bits binary, row_key long")


class _Roots:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.root = list(range(n))

    def find(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def join(self, i: int, j: int) -> None:
        if self.root[i] != self.root[j]:
            self.root[self.find(i)] = self.find(j)


class _Tree:
    """Signature tree over sets given as arrays of local shingle numbers."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray, width: int):
        order = sorted(range(len(sets)), key=lambda i: (sizes[i], tuple(sets[i][:4])))
        self.leaves = [order[i : i + LEAF] for i in range(0, len(order), LEAF)]
        level = []
        for members in self.leaves:
            sig = np.zeros(width, np.uint16)
            for i in members:
                bit, c = np.unique(sets[i] % width, return_counts=True)
                sig[bit] = np.maximum(sig[bit], c)
            level.append((sig, int(sizes[members].min()), int(sizes[members].max()), members, None))
        while len(level) > 1:
            up = []
            for i in range(0, len(level), FANOUT):
                kids = level[i : i + FANOUT]
                up.append((np.maximum.reduce([x[0] for x in kids]), min(x[1] for x in kids), max(x[2] for x in kids), None, kids))
            level = up
        self.root = level[0]


def tree_links(sets: list[np.ndarray], sizes: np.ndarray, share: Fraction, sides: np.ndarray | None = None):
    """Yield (i, j) of all linked pairs; with ``sides`` only pairs of different sides."""
    p, q = share.numerator, share.denominator
    flat = np.concatenate(sets)
    tokens, local, df = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.cumsum(df > 1) - 1  # shingles of one set alone cannot overlap
    cuts = np.cumsum([len(s) for s in sets])[:-1]
    mine = [rank[x[df[x] > 1]] for x in np.split(local, cuts)]
    width = int(min(BITS, max(1, rank[-1] + 1)))
    dense: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def rows(members, vocab):
        m = np.zeros((len(members), len(vocab)), np.float32)
        for r, i in enumerate(members):
            at = np.searchsorted(vocab, mine[i])
            at = at[at < len(vocab)][vocab[at[at < len(vocab)]] == mine[i][at < len(vocab)]]
            m[r, at] = 1
        return m

    def verify(a, b, same):
        ka, kb = a[0], b[0]
        if id(b) not in dense:
            vocab = np.unique(np.concatenate([mine[i] for i in kb]))
            dense[id(b)] = (vocab, rows(kb, vocab))
        vocab, mb = dense[id(b)]
        both = ((mb if same else rows(ka, vocab)) @ mb.T).astype(np.int64)
        na, nb = sizes[ka][:, None], sizes[kb][None, :]
        hit = q * both >= p * (na + nb - both)
        for r, c in zip(*np.nonzero(hit)):
            if (not same or r < c) and (sides is None or sides[ka[r]] != sides[kb[c]]):
                yield ka[r], kb[c]

    def apart(a, b):
        if q * a[2] < p * b[1] or q * b[2] < p * a[1]:
            return True
        best = int(np.minimum(a[0], b[0]).sum())
        return (p + q) * best < p * (a[1] + b[1])

    root = _Tree(mine, sizes, width).root
    stack = [(root, root)]
    wrapped: dict[int, tuple] = {}
    while stack:
        a, b = stack.pop()
        if a is not b and apart(a, b):
            continue
        if a[4] is None and b[4] is None:
            wa, wb = (wrapped.setdefault(id(x), (x[3],)) for x in (a, b))
            yield from verify(wa, wb, a is b)
        elif a is b:
            kids = a[4]
            stack += [(kids[i], kids[j]) for i in range(len(kids)) for j in range(i, len(kids))]
        elif a[4] is not None:
            stack += [(x, b) for x in a[4]]
        else:
            stack += [(a, x) for x in b[4]]


def cluster_links(nodes, sets, sizes, copies, share, sides=None) -> pd.DataFrame:
    """(u, v, links): each linked node, its local root and the copies of the nodes it links with."""
    roots = _Roots(len(nodes))
    links = np.zeros(len(nodes), np.int64)
    for i, j in tree_links(sets, sizes, share, sides):
        links[i] += copies[j]
        links[j] += copies[i]
        roots.join(i, j)
    at = np.flatnonzero(links)
    return pd.DataFrame({"u": nodes[at], "v": nodes[[roots.find(i) for i in at]] if len(at) else nodes[at], "links": links[at]})


def clusters_of(classes: DataFrame, share: Fraction) -> DataFrame:
    """(node, cluster) of the nodes that may link over a prefix shingle."""
    tokens = classes.select(F.explode("prefix").alias("token"), "node")
    groups = tokens.groupBy("token").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("n"), F.expr("bit_xor(xxhash64(node))").alias("who")).where("low < high")
    groups = groups.groupBy("low", "high", "n", "who").agg(F.min("token").alias("token")).select("token", "low", "n")
    members = cut_lineage(tokens.join(groups, "token"), "jaccard-shared")
    hot = members.where((F.col("n") > GROUP_MAX) & (F.col("node") != F.col("low"))).select(F.col("node").alias("u"), F.col("low").alias("v")).distinct()
    packs = max(1, -(-members.count() // PACK_ROWS))
    rows = members.where(F.col("n") <= GROUP_MAX).join(classes.select("node", "n_shingles", "bits"), "node").withColumn("pack", F.pmod(F.xxhash64("token"), F.lit(packs)))

    def filtered(pdf: pd.DataFrame) -> pd.DataFrame:
        u, v = [], []
        for _, g in pdf.groupby("token", sort=False):
            ids = g["node"].to_numpy()
            root = _Roots(len(ids))
            for a, b in bounded_pairs(g["n_shingles"].to_numpy(np.int64), g["bits"].tolist(), share):
                for i, j in zip(a.tolist(), b.tolist()):
                    root.join(i, j)
            top = ids[[root.find(i) for i in range(len(ids))]]
            u.append(ids[top != ids])
            v.append(top[top != ids])
        return pd.DataFrame({"u": np.concatenate(u), "v": np.concatenate(v)}).drop_duplicates()

    near = rows.select("pack", "token", "node", "n_shingles", "bits").groupBy("pack").applyInPandas(filtered, "u long, v long")
    edges = cut_lineage(near.union(hot).distinct(), "jaccard-edges")
    return connected_components(edges).select("node", F.col("component").alias("cluster"))


def link_rows(docs: DataFrame, classes: DataFrame, k: int, share: Fraction) -> DataFrame:
    """Verified links of all clusters as (u, v, links)."""
    spark = docs.sparkSession
    members = cut_lineage(classes.drop("prefix", "bits").join(clusters_of(classes, share), "node"), "jaccard-members")
    weights = members.groupBy("cluster").agg(F.sum("n_shingles").alias("weight"))
    # size classes whose neighbours alone can hold a partner: sizes differ by the factor t at most
    size_class = F.floor(F.log(F.col("n_shingles").cast("double")) / F.lit(float(-np.log(share.numerator / share.denominator)) * 1.0001))
    placed = members.join(weights, "cluster").withColumn("size_class", size_class)
    total = members.agg(F.sum("n_shingles")).first()[0] or 0
    packs = max(1, -(-int(total) // BLOCK_SHINGLES))
    small = placed.where(F.col("weight") <= BLOCK_SHINGLES).select("node", "cluster", F.pmod(F.xxhash64("cluster"), F.lit(packs)).alias("task"), F.lit(0).alias("sub"), F.lit(0).alias("side"), F.lit(0).alias("pair"))
    large = placed.where(F.col("weight") > BLOCK_SHINGLES)
    cells = large.groupBy("cluster", "size_class").agg(F.ceil(F.sum("n_shingles") / F.lit(BLOCK_SHINGLES // 2)).alias("blocks"))
    blocks = cut_lineage(cells.select("cluster", "size_class", "blocks", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")), "jaccard-blocks")
    a, b = blocks.alias("a"), blocks.alias("b")
    near = (F.col("b.size_class") == F.col("a.size_class") + 1) | ((F.col("b.size_class") == F.col("a.size_class")) & (F.col("b.block") >= F.col("a.block")))
    pairs = a.join(b, F.col("a.cluster") == F.col("b.cluster")).where(near)
    side = lambda x, s: pairs.select(F.col("a.cluster").alias("cluster"), F.col(f"{x}.size_class").alias("size_class"), F.col(f"{x}.block").alias("block"), F.xxhash64("a.cluster", "a.size_class", "a.block").alias("task"), F.xxhash64("b.size_class", "b.block").alias("sub"), F.lit(s).alias("side"), F.when((F.col("a.size_class") == F.col("b.size_class")) & (F.col("a.block") == F.col("b.block")), 0).otherwise(1).alias("pair"))
    sides = side("a", 0).union(side("b", 1).where("pair = 1"))
    cut = large.join(cells, ["cluster", "size_class"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    large = cut.join(sides, ["cluster", "size_class", "block"]).select("node", "cluster", "task", "sub", "side", "pair")
    tasks = small.union(large)

    # one text per node; the sets are made again from the text rather than kept for all documents
    wanted = small_side(members.select("doc_id", "node", "copies"))

    def remake(batches):
        for pdf in batches:
            sets = [shingle_set(t, k) for t in pdf["text"]]
            ok = [i for i, s in enumerate(sets) if len(s) and node_id(s) == pdf["node"].iat[i]]
            yield pd.DataFrame({"node": pdf["node"].iloc[ok], "copies": pdf["copies"].iloc[ok], "shingles": [sets[i].tobytes() for i in ok]})

    texts = docs.select(F.col("doc_id").alias("id"), "text").join(wanted, F.col("id").eqNullSafe(F.col("doc_id"))).select("text", "node", "copies")
    sets = texts.mapInPandas(remake, "node long, copies long, shingles binary").dropDuplicates(["node"])
    work = sets.join(tasks, "node")

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, g in pdf.groupby("cluster", sort=False):
            arrays = [np.frombuffer(x, np.uint64) for x in g["shingles"]]
            sides = g["side"].to_numpy() if g["pair"].iat[0] else None
            out.append(cluster_links(g["node"].to_numpy(), arrays, np.array([len(x) for x in arrays]), g["copies"].to_numpy(), share, sides))
        return pd.concat(out)

    return work.groupBy("task", "sub").applyInPandas(verify, "u long, v long, links long")


def jaccard_components(docs: DataFrame, k: int = 5, share: Fraction = Fraction(4, 5)) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, n_links,
    component (null for an empty set) and row_key (a hash of the text).

    ``component_id`` is the smallest doc_id reachable over links of Jaccard
    >= ``share`` (itself included), ``n_links`` the number of other documents
    linked directly.
    """
    thin = cut_lineage(sketches(docs, k, share), "jaccard-sketch")
    sizes = thin.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.min("n_shingles").alias("n_shingles"))
    prefixes = thin.where("node IS NOT NULL").select("node", "prefix", "bits").dropDuplicates(["node"])
    classes = cut_lineage(prefixes.join(sizes, "node"), "jaccard-classes")
    links = cut_lineage(link_rows(docs, classes, k, share), "jaccard-links")
    parts = connected_components(links.select("u", "v"))
    per_node = links.groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links"))
    named = classes.select("node", "doc_id", "copies").join(parts, "node", "left").join(per_node, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    final = named.join(lowest, "component").select("node", "component", "component_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    return thin.select("doc_id", "n_shingles", "node", "row_key").join(final, "node", "left").select(
        "doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), "component", "row_key"
    )


def keep_one(docs: DataFrame, k: int = 5, share: Fraction = Fraction(4, 5)) -> DataFrame:
    """``docs`` with one row of each component: the smallest doc_id (null last), then the
    smallest hash of the text. Rows with an empty set stay; all columns stay."""
    found = cut_lineage(jaccard_components(docs, k, share).where("component IS NOT NULL").select("doc_id", "row_key", "component"), "jaccard-rows")
    best = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")).alias("best"))
    rows = found.groupBy("component", "doc_id", "row_key").agg(F.count("*").alias("n")).join(best, "component")
    stays = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("row_key") == F.col("best.row_key"))
    key = [F.col("doc_id").alias("__near_doc"), F.col("row_key").alias("__near_row")]
    gone = small_side(cut_lineage(rows.where(~stays).select(*key), "jaccard-gone"))
    on = lambda side: docs["doc_id"].eqNullSafe(side["__near_doc"]) & (F.xxhash64(docs["text"]) == side["__near_row"])
    kept = docs.join(gone, on(gone), "left_anti")
    twice = cut_lineage(rows.where(stays & (F.col("n") > 1)).select(*key), "jaccard-repeats")
    if not twice.take(1):
        return kept
    # rows that repeat id and text: only those are shuffled
    once = docs.join(small_side(twice), on(twice), "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(small_side(twice), on(twice), "left_anti").unionByName(once)
