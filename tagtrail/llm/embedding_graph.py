"""Embedding near-dedup on a robust-pruned flat graph.

1. Equal labels only; identical vectors are one node with a copy count. Within
   a label, centroids are fitted on a bounded, documented sample
   (``SAMPLE`` vectors); every node goes to the shards of its ``NEAREST``
   nearest centroids (overlap), so close vectors meet in at least one shard and
   the copies of a node do not grow with the number of shards. The number of centroids follows the label's size up
   to the sample; a shard above ``SHARD_MAX`` is dealt to hash blocks.
2. Each block builds a flat graph: greedy search from the medoid collects
   candidates, robust pruning keeps a few diverse neighbours, reverse edges are
   added and pruned again, and groups out of the medoid's reach are bridged. The lists of all shards are united per node.
3. Each node is searched from the medoid of its own block, and of the other
   blocks of its shard in tasks of their own, over the united lists; within
   reach of the threshold the search expands over every neighbour inside a
   slack of it, and all that it meets are verified in double precision.
4. A pair counts in the first shard that both share. A task returns a count and
   a local root per node, never pairs; every verified pair joins its roots, star
   rounds join the roots of all tasks. Of the pairs that share several shards a
   task also returns one digest a node: where the shards' digests of a node
   differ, a search missed what another one found. The searches of these nodes
   alone run again (they are deterministic) and name the pairs among them, and
   the pairs that the first shard missed are added.
5. Recall is audited against brute force, in blocks, on the nodes that hold a
   vec_id divisible by ``EVERY`` and on about ``AUDIT`` others. It is a mean over
   nodes, so a large group weighs no more than its nodes; nodes outside the
   largest groups have a mean of their own and the lower of the two counts.
   Below ``RECALL`` the search is repeated with twice as many shards a node; if
   that does not help, all pairs of a label are compared, block by block.

Edge cases: components of float are kept as they are, all others become double;
vectors that are null, empty, zero or hold null or non-finite
components, and rows with a null label, link with nothing; vectors of
different length never link; identical vectors link (cosine 1); rows repeating
a vec_id are vectors of their own and share its id in the result; a null vec_id
stays and names no component; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import connected_components

THRESHOLD = 0.93
SAMPLE = 4000
SHARD, SHARD_MAX = 250, 1500
NEAREST = 2
DEGREE, BEAM, STEP, ALPHA = 16, 32, 8, 1.2
SLACK = 0.10  # cosine below the threshold over which a search still expands
AUDIT, RECALL = 200, 0.97
EVERY = 20  # nodes with a vec_id divisible by this are audited
ROUNDS = 3  # searches, each over twice as many shards a node, before all pairs are compared
ASKED = 2000  # audited nodes of one task
BUCKET = 5000  # nodes assigned to centroids by one task


def unit(rows) -> np.ndarray:
    """Unit vectors; scaled first, so that huge or tiny components neither overflow nor vanish."""
    a = np.array([np.asarray(v, dtype=np.float64) for v in rows])
    a = a / np.abs(a).max(axis=1, keepdims=True)
    return a / np.linalg.norm(a, axis=1, keepdims=True)


def centroids(x: np.ndarray, k: int, seed: int = 3) -> np.ndarray:
    """Spherical k-means of a bounded sample."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(6):
        near = (x @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        n = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(n > 0, total / np.where(n > 0, n, 1), c)
    return c


def greedy(q: np.ndarray, x: np.ndarray, lists: list[np.ndarray], start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(visited nodes, their cosines) of a beam search from the nodes ``start``."""
    seen = np.zeros(len(x), dtype=bool)
    seen[start] = True
    ids, sims = start, x[start] @ q
    done = np.zeros(len(ids), dtype=bool)
    while True:
        beam = np.argsort(-sims, kind="stable")[:BEAM]
        todo = beam[~done[beam]][:STEP]
        if not len(todo):
            return ids, sims
        done[todo] = True
        nxt = np.unique(np.concatenate([lists[i] for i in ids[todo]]))
        nxt = nxt[~seen[nxt]]
        seen[nxt] = True
        ids, sims, done = np.append(ids, nxt), np.append(sims, x[nxt] @ q), np.append(done, np.zeros(len(nxt), dtype=bool))


def prune(i: int, cand: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Robust pruning: the nearest candidate stays and drops all it is ``ALPHA`` times nearer to than ``i`` is."""
    cand = np.unique(cand)
    cand = cand[cand != i]
    far = 1.0 - x[cand] @ x[i]
    at = np.argsort(far, kind="stable")[:128]
    cand, far = cand[at], far[at]
    between = 1.0 - x[cand] @ x[cand].T
    alive, keep = np.ones(len(cand), dtype=bool), []
    for k in range(len(cand)):
        if alive[k]:
            keep.append(cand[k])
            if len(keep) == DEGREE:
                break
            alive &= ALPHA * between[k] > far
    return np.array(keep, dtype=np.int64)


def medoid(x: np.ndarray) -> int:
    return int((x @ x.sum(axis=0)).argmax())


def flat_graph(x: np.ndarray, seed: int = 5) -> list[np.ndarray]:
    """Neighbour lists of a block, at most ``DEGREE`` long."""
    n = len(x)
    rng = np.random.default_rng(seed)
    lists = [rng.choice(n, min(n, DEGREE), replace=False) for _ in range(n)]
    start = np.array([medoid(x)])
    for i in rng.permutation(n):
        visited, _ = greedy(x[i], x, lists, start)
        lists[i] = prune(i, np.append(visited, lists[i]), x)
        for j in lists[i]:
            if i not in lists[j]:
                more = np.append(lists[j], i)
                lists[j] = more if len(more) <= DEGREE else prune(j, more, x)
    bridge(x, lists, start)
    return lists


def bridge(x: np.ndarray, lists: list[np.ndarray], start: np.ndarray) -> None:
    """Make every node reachable: tight groups list only each other, so the nearest
    reached node gets an edge to each group that is left out."""
    reached = np.zeros(len(x), dtype=bool)
    best, near = np.full(len(x), -2.0), np.zeros(len(x), dtype=np.int64)
    front = start
    while True:
        while len(front):
            reached[front] = True
            out = np.flatnonzero(~reached)
            if not len(out):
                return
            s = x[out] @ x[front].T
            top = s.argmax(axis=1)
            s = s[np.arange(len(out)), top]
            better = s > best[out]
            best[out[better]], near[out[better]] = s[better], front[top[better]]
            front = np.unique(np.concatenate([lists[i] for i in front]))
            front = front[~reached[front]]
        out = np.flatnonzero(~reached)
        if not len(out):
            return
        i = out[best[out].argmax()]
        lists[near[i]] = np.append(lists[near[i]], i)
        front = np.array([i])


def both_ways(lists: list[np.ndarray]) -> list[np.ndarray]:
    """The lists with every edge also backwards."""
    a = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    b = np.concatenate(lists) if len(a) else a
    edges = np.unique(np.concatenate([a * len(lists) + b, b * len(lists) + a]))
    return np.split(edges % len(lists), np.searchsorted(edges // len(lists), np.arange(1, len(lists))))


def in_range(q: np.ndarray, x: np.ndarray, lists: list[np.ndarray], start: np.ndarray, threshold: float) -> np.ndarray:
    """Nodes with a cosine of at least ``threshold``: beam search, then expansion over all within the slack."""
    ids, sims = greedy(q, x, lists, start)
    seen = np.zeros(len(x), dtype=bool)
    seen[ids] = True
    reach = ids[sims >= threshold - SLACK]
    found, front = [ids[sims >= threshold]], reach
    while len(front):
        nxt = np.unique(np.concatenate([lists[i] for i in front]))
        nxt = nxt[~seen[nxt]]
        seen[nxt] = True
        s = x[nxt] @ q
        found.append(nxt[s >= threshold])
        front = nxt[s >= threshold - SLACK]
    return np.concatenate(found)


def _usable(c: str):
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return F.coalesce(F.forall(c, finite) & F.exists(c, lambda v: v != 0), F.lit(False)) & F.col("label").isNotNull()


def assign(nodes: DataFrame, nearest: int) -> DataFrame:
    """(node, copies, vec, shard, shards): one row per node and shard."""
    sizes = nodes.groupBy("family").agg(F.count("*").alias("n"))
    sized = nodes.join(sizes, "family")
    share = F.pmod(F.xxhash64(F.col("node"), F.lit("centroids")), F.lit(1 << 20)) / float(1 << 20)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        k = max(1, min(-(-int(pdf["n"].iat[0]) // SHARD), len(pdf) // 4))
        pdf = pdf.sort_values("node")
        c = centroids(unit(pdf["vec"]), k)
        return pd.DataFrame({"family": pdf["family"].iat[0], "n": pdf["n"].iat[0], "centroid": list(c)})

    fitted = sized.where(share < F.lit(float(SAMPLE)) / F.col("n")).groupBy("family").applyInPandas(fit, "family long, n long, centroid array<double>")
    buckets = F.greatest(F.lit(1), F.ceil(F.col("n") / BUCKET)).cast("long")
    left = sized.withColumn("bucket", F.pmod(F.xxhash64("node", F.lit("bucket")), buckets)).select("family", "bucket", "node", "copies", "vec")
    right = fitted.withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("long"), buckets - 1))).select("family", "bucket", "centroid")

    def place(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a):
            return pd.DataFrame({"family": [], "node": [], "copies": [], "vec": [], "shards": []})
        shards = [[0]] * len(a)  # a family without a sampled vector is one shard
        if len(b):
            c = np.vstack(b["centroid"].to_numpy())
            c = c[np.lexsort(c.T)]
            near = np.argsort(-(unit(a["vec"]) @ c.T), axis=1, kind="stable")[:, :nearest]
            shards = np.sort(near, axis=1).tolist()
        return a[["family", "node", "copies", "vec"]].assign(shards=shards)

    vec = nodes.schema["vec"].dataType.simpleString()
    placed = left.groupBy("family", "bucket").cogroup(right.groupBy("family", "bucket")).applyInPandas(place, f"family long, node long, copies long, vec {vec}, shards array<int>")
    return placed.withColumn("shard", F.explode("shards"))


LINKS = "u long, v long, links long, near long"
PAIRS = 1 << 17  # pairs looked at at once


def summed(ids: np.ndarray, copies: np.ndarray, left: np.ndarray, right: np.ndarray, counted: np.ndarray | None = None) -> pd.DataFrame:
    """(u, v, links, near) of the pairs: linked node, local root, copies and number of the nodes it links with;
    with ``counted``, the pairs outside it only join roots."""
    root = np.arange(len(ids))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    at = np.union1d(left, right)
    for i, j in zip(left, right):
        if root[i] != root[j]:
            root[find(i)] = find(j)
    if counted is not None:
        left, right = left[counted], right[counted]
    links, near = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
    np.add.at(links, left, copies[right])
    np.add.at(links, right, copies[left])
    np.add.at(near, left, 1)
    np.add.at(near, right, 1)
    return pd.DataFrame({"u": ids[at], "v": ids[[find(i) for i in at]] if len(at) else ids[at], "links": links[at], "near": near[at]})


def shared_shards(member: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each pair: the first shard that both share, and which of the left's and of the right's shards are shared, as bits."""
    bits = np.int64(1) << np.arange(member.shape[1])
    out = [(np.empty(0, np.int64),) * 3]
    for at in range(0, len(left), PAIRS):
        a, b = member[left[at : at + PAIRS]], member[right[at : at + PAIRS]]
        same = (a[:, :, None] == b[:, None, :]) & (a >= 0)[:, :, None]
        mine = same.any(axis=2)
        out.append((np.where(mine, a, np.iinfo(np.int64).max).min(axis=1), mine @ bits, same.any(axis=1) @ bits))
    return tuple(np.concatenate(c) for c in zip(*out))


def digests(ids: np.ndarray, node: np.ndarray, mask: np.ndarray, other: np.ndarray) -> pd.DataFrame:
    """(u, mask, digest): per node and set of shared shards, a digest of the nodes it was found to link with."""
    key, at = np.unique(np.stack([node, mask], axis=1), axis=0, return_inverse=True)
    mixed = (ids[other].astype(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    total = np.zeros(len(key), np.uint64)
    np.bitwise_xor.at(total, at.ravel(), mixed)
    return pd.DataFrame({"u": ids[key[:, 0]], "mask": key[:, 1], "digest": total.view(np.int64)})


def searched(pdf: pd.DataFrame, threshold: float) -> tuple[np.ndarray, ...]:
    """(nodes, copies, left, right, first shared shard, shared shards as bits of either end) of the pairs that the graph
    of one block gives to the rows that ask."""
    pdf = pdf.sort_values("node").reset_index(drop=True)
    ids, copies, x = pdf["node"].to_numpy(), pdf["copies"].to_numpy(), unit(pdf["vec"])
    of = np.flatnonzero(pdf["graph"].to_numpy(dtype=bool))
    asks = np.flatnonzero(pdf["asks"].to_numpy(dtype=bool))
    nothing = np.empty(0, np.int64)
    if not len(of) or not len(asks):
        return (ids, copies, *(nothing,) * 5)
    y, names = x[of], ids[of]
    lists = []
    for near in pdf["near"].iloc[of]:
        near = np.asarray(near, dtype=np.int64)
        at = np.minimum(np.searchsorted(names, near), len(names) - 1)
        lists.append(at[names[at] == near])
    lists = both_ways(lists)
    start = np.array([medoid(y)])
    found = [nothing]
    for i in asks:
        hit = of[in_range(x[i], y, lists, start, threshold)]
        hit = hit[hit != i]
        found.append(np.minimum(i, hit) * len(ids) + np.maximum(i, hit))
    pairs = np.unique(np.concatenate(found))  # found from either end
    left, right = pairs // len(ids), pairs % len(ids)
    member = np.full((len(ids), max(map(len, pdf["shards"]))), -1)
    for i, s in enumerate(pdf["shards"]):
        member[i, : len(s)] = s
    return (ids, copies, left, right, *shared_shards(member, left, right))


def link_rows(nodes: DataFrame, threshold: float, nearest: int) -> DataFrame:
    """Verified links as (u, v, links, near): node, local root, copies and number of the nodes it links with."""
    placed = cut_lineage(assign(nodes, nearest), "graph-shards")
    cells = placed.groupBy("family", "shard").agg(F.ceil(F.count("*") / F.lit(float(SHARD_MAX))).cast("long").alias("blocks"))
    placed = placed.join(cells, ["family", "shard"]).withColumn("block", F.pmod(F.xxhash64("node", "shard"), F.col("blocks")))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        ids = pdf["node"].to_numpy()
        return pd.DataFrame({"node": ids, "near": [ids[a] for a in flat_graph(unit(pdf["vec"]))]})

    lists = placed.select("family", "shard", "block", "node", "vec").groupBy("family", "shard", "block").applyInPandas(build, "node long, near array<long>")
    united = cut_lineage(lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "graph-lists")
    base = placed.join(united, "node")

    def tasks(base: DataFrame) -> DataFrame:
        """One group per pair of blocks: the marked nodes of one block ask, the other block is the graph."""
        one = base.withColumn("b", F.explode(F.sequence(F.col("block"), F.col("blocks") - 1))).withColumn("a", F.col("block"))
        one = one.withColumns({"asks": F.col("marked"), "graph": F.col("a") == F.col("b")}).where("asks OR graph")
        two = base.withColumn("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("block")))).where("a < block").withColumn("b", F.col("block"))
        two = two.withColumns({"asks": F.lit(False), "graph": F.lit(True)})
        columns = ["family", "shard", "a", "b", "asks", "graph", "marked", "node", "copies", "vec", "shards", "near"]
        return one.select(*columns).union(two.select(*columns)).groupBy("family", "shard", "a", "b")

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, copies, left, right, low, mask, mirror = searched(pdf, threshold)
        out = summed(ids, copies, left, right, low == int(pdf["shard"].iat[0]))
        several = np.flatnonzero(mask & (mask - 1))
        left, right = left[several], right[several]
        met = digests(ids, np.append(left, right), np.append(mask[several], mirror[several]), np.append(right, left))
        out = pd.concat([out.assign(mask=0, digest=0), met.assign(v=met["u"], links=0, near=0)], ignore_index=True)
        return out.assign(shard=int(pdf["shard"].iat[0]))

    found = cut_lineage(tasks(base.withColumn("marked", F.lit(True))).applyInPandas(search, f"{LINKS}, mask long, digest long, shard int"), "graph-found")
    links = found.where("mask = 0").select("u", "v", "links", "near")
    met = found.where("mask <> 0").groupBy("u", "mask", "shard").agg(F.bit_xor("digest").alias("digest"))
    met = met.groupBy("u", "mask").agg(F.count("*").alias("n"), F.min("digest").alias("low"), F.max("digest").alias("high"))
    disputed = cut_lineage(met.where("n < bit_count(mask) OR low <> high").select(F.col("u").alias("node")).distinct(), "graph-disputed")
    if disputed.isEmpty():
        return links

    def again(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, copies, left, right, low, mask, _ = searched(pdf, threshold)
        asked = np.isin(ids, pdf["node"].to_numpy()[pdf["marked"].to_numpy(dtype=bool)])
        at = np.flatnonzero((mask & (mask - 1) != 0) & asked[left] & asked[right])
        left, right = left[at], right[at]
        back = ids[left] > ids[right]
        left, right = np.where(back, right, left), np.where(back, left, right)
        return pd.DataFrame({"u": ids[left], "v": ids[right], "mine": copies[left], "other": copies[right], "first": low[at] == int(pdf["shard"].iat[0])})

    marked = base.join(disputed.withColumn("marked", F.lit(True)), "node", "left").withColumn("marked", F.coalesce("marked", F.lit(False)))
    named = tasks(marked).applyInPandas(again, "u long, v long, mine long, other long, first boolean")
    missed = named.groupBy("u", "v").agg(F.first("mine").alias("mine"), F.first("other").alias("other"), F.max("first").alias("first")).where("NOT first")
    ends = F.explode(F.array(F.struct("u", F.col("other").alias("links")), F.struct(F.col("v").alias("u"), F.col("mine").alias("links"))))
    more = missed.select(ends.alias("e")).select("e.u", F.col("e.u").alias("v"), "e.links", F.lit(1).cast("long").alias("near"))
    return links.union(more)


def all_links(nodes: DataFrame, threshold: float) -> DataFrame:
    """The rows of ``link_rows`` from all pairs of a label: one task per pair of blocks, each pair in one task."""
    sizes = nodes.groupBy("family").agg(F.ceil(F.count("*") / F.lit(float(SHARD_MAX))).cast("long").alias("blocks"))
    base = nodes.join(sizes, "family").withColumn("block", F.pmod(F.xxhash64("node", F.lit("all")), F.col("blocks")))
    base = base.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    sides = base.select("family", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), (F.col("block") <= F.col("other")).alias("asks"), "node", "copies", "vec")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node").reset_index(drop=True)
        ids, copies, x = pdf["node"].to_numpy(), pdf["copies"].to_numpy(), unit(pdf["vec"])
        asks = pdf["asks"].to_numpy(dtype=bool)
        if asks.all() and pdf["a"].iat[0] == pdf["b"].iat[0]:
            left, right = np.nonzero(np.triu(x @ x.T >= threshold, 1))
        else:
            mine, other = np.flatnonzero(asks), np.flatnonzero(~asks)
            left, right = np.nonzero(x[mine] @ x[other].T >= threshold)
            left, right = mine[left], other[right]
        return summed(ids, copies, left, right)

    return sides.groupBy("family", "a", "b").applyInPandas(compare, LINKS)


def truths(nodes: DataFrame, threshold: float, n: int = AUDIT) -> DataFrame:
    """(family, node, truth) of the audited nodes: the other nodes each one links with, by brute force."""
    total = nodes.count()
    share = F.pmod(F.xxhash64(F.col("node"), F.lit("audit")), F.lit(1 << 30)) / float(1 << 30)
    asked = nodes.where(F.col("asked") | (share < min(1.0, n / max(1, total)))).select("family", "node", "vec")
    blocks = asked.groupBy("family").agg(F.ceil(F.count("*") / F.lit(float(ASKED))).cast("long").alias("blocks"))
    asked = asked.join(blocks, "family").withColumn("block", F.pmod(F.xxhash64("node", F.lit("ask")), F.col("blocks"))).drop("blocks")
    parts = nodes.groupBy("family").agg(F.ceil(F.count("*") / F.lit(float(BUCKET))).cast("long").alias("parts"))
    asked = asked.join(parts, "family").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    against = nodes.select("family", "node", "vec").join(parts, "family").withColumn("part", F.pmod(F.xxhash64("node", F.lit("part")), F.col("parts"))).drop("parts")
    against = against.join(blocks, "family").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")

    def brute(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf["asks"]], pdf[~pdf["asks"]]
        truth = np.zeros(len(a), np.int64)
        if len(a) and len(b):
            hit = (unit(a["vec"]) @ unit(b["vec"]).T >= threshold) & (a["node"].to_numpy()[:, None] != b["node"].to_numpy()[None, :])
            truth = hit.sum(axis=1)
        return pd.DataFrame({"family": a["family"], "node": a["node"], "truth": truth})

    names = ["family", "block", "part", "node", "vec"]
    met = asked.select(*names, F.lit(True).alias("asks")).union(against.select(*names, F.lit(False).alias("asks")))
    met = met.groupBy("family", "block", "part").applyInPandas(brute, "family long, node long, truth long")
    return met.groupBy("family", "node").agg(F.sum("truth").alias("truth"))


def audit(truth: DataFrame, found: DataFrame) -> float:
    """Mean share of an audited node's links that was found, over nodes with links; the mean
    over the nodes outside the largest groups (at most half the links of their label's top) if that is lower."""
    got = found.groupBy(F.col("u").alias("node")).agg(F.sum("near").alias("near"))
    top = truth.groupBy("family").agg(F.max("truth").alias("top"))
    each = truth.where("truth > 0").join(got, "node", "left").join(top, "family")
    each = each.select((F.least(F.coalesce("near", F.lit(0)), "truth") / F.col("truth")).alias("share"), (2 * F.col("truth") <= F.col("top")).alias("outside"))
    r = each.agg(F.avg("share").alias("all"), F.avg(F.when(F.col("outside"), F.col("share"))).alias("outside")).first()
    return min(1.0 if v is None else float(v) for v in r)


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``vectors`` (vec_id, embedding, label): vec_id, n_links, component_id, kept, audited_recall."""
    own = vectors.schema["embedding"].dataType.simpleString()
    rows = vectors.select("vec_id", F.col("embedding").cast(own if own == "array<float>" else "array<double>").alias("vec"), "label")
    rows = rows.withColumn("node", F.when(_usable("vec"), F.xxhash64("label", "vec")))
    family = F.xxhash64("label", F.size("vec"))
    nodes = rows.where("node IS NOT NULL").withColumn("family", family).groupBy("node").agg(F.first("family").alias("family"), F.first("vec").alias("vec"), F.count("*").alias("copies"), F.min("vec_id").alias("vec_id"), F.coalesce(F.max(F.col("vec_id") % EVERY == 0), F.lit(False)).alias("asked"))
    nodes = cut_lineage(nodes, "graph-nodes")
    truth = cut_lineage(truths(nodes, threshold), "graph-truths")
    plain = nodes.drop("vec_id", "asked")
    for k in range(ROUNDS + 1):
        rows_of_links = link_rows(plain, threshold, NEAREST << k) if k < ROUNDS else all_links(plain, threshold)
        links = cut_lineage(rows_of_links, "graph-links")
        recall = audit(truth, links)
        if recall >= RECALL:
            break
    parts = connected_components(links.select("u", "v"))
    per_node = links.groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links"))
    named = nodes.select("node", "vec_id", "copies").join(parts, "node", "left").join(per_node, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = named.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    final = named.join(lowest, "component").select("node", "component_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = rows.select("vec_id", "node").join(final, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"), F.lit(recall).alias("audited_recall"))
