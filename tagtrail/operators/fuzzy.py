"""Fuzzy canonical tags (greedy leaders), lookup and report.

Reference behaviour: tags are visited in a random order; a tag becomes a
leader unless an existing leader is similar (score >= threshold); every tag
then maps to a similar leader. Here the random order is a seeded hash
priority, which makes the result the lexicographically-first maximal
independent set of the similarity graph. It is computed in parallel rounds
(a tag is decided as soon as every higher-priority neighbour is, and a round
reads the pairs of undecided tags alone): leaders
never depend on lower-priority tags, so the result equals the sequential
greedy pass. A member maps to its highest-priority similar leader.

Candidate pairs are generated losslessly (segment partitions, the
pigeonhole filter of PassJoin):
  * a score >= T after rounding needs Indel distance d <= tau = f*(|a|+|b|),
    f = (100 - T + 0.5) / 100, and | |a| - |b| | <= d;
  * split the shorter string s into tau+1 even segments; d edits can break at
    most d of them, so one segment occurs unchanged in the other string r,
    shifted by at most tau positions;
  * so s emits its segments keyed by (|s|, |r|, segment no, text) for every
    possible partner length |r|, and r emits its substrings at the allowed
    positions under the same keys. An equi-join on that key yields every
    similar pair; segments are about 1/f characters long, so the key is
    selective;
  * d has the parity of |a|+|b|, so tau is lowered by one where it has not;
  * small tau: two strings within tau leave one and the same string when s
    loses (tau - |r| + |s|) / 2 characters and r loses (tau + |r| - |s|) / 2.
    Where neither loses more than one, or two to four in strings of bounded
    length, they join on the keys of these deletion variants (``variants``)
    instead of short segments, whose candidates grow with the square of the
    strings.
Tags that share one prepared string (``Red``, ``red``, ``RED!`` in mode
``sort``) score 100 with one another and alike with all others, so each
distinct prepared string is one node: no pairs of equal strings are made, and
tau = 0 needs no candidates.

Mode ``set`` compares sets of words: the score is the best of three ratios,
between the common words, those plus the rest of one tag, and those plus the
rest of the other. Candidates come from three joins that miss no similar pair
and never pair all tags of a shared word:
  * common words against one tag: the tag may lack at most ``drop`` characters
    (words and their spaces), so one of its rarest words, taken until they
    cost more than that, is common. Those few rows join all words of the
    others; a tag inside another is the case ``drop`` = 0;
  * no common word: the plain ratio of the prepared strings, found as above;
  * common words and two rests: a tag of up to SUBSET_WORDS words is cut into
    every (common, rest) of its words, and rests with equal common words are
    partitioned into segments as above, tau being that of the whole tags. Where
    the shorter rest has no more than tau characters it needs no segment: the
    common words and both lengths are the key;
  * tags of more words, with any other: tau + 1 pieces of up to PIECE
    characters from the words beside a common one; one of them is unbroken and
    lies in a word of the other tag. Rows grow with words x characters here.
A tag without a word is similar to nothing, itself included: it leads, and a
lookup of it gives the default.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import prepared, ratio_udf, set_ratio_udf
from ..session import cut_lineage
from .indexing import dense_index
from .variants import DELETIONS, EPS, variant_pairs

SUBSET_WORDS = 5  # tags of mode 'set' of up to so many words are cut into every common part and rest
PIECE = 3  # characters of a piece of a longer tag


def _tau(f: float) -> F.Column:
    """Largest Indel distance of a pair of lengths ``ls``, ``lr``, both after ``e`` equal characters: at most f * (ls + lr + 2e), with the parity of the sum."""
    total = F.col("ls") + F.col("lr") + 2 * F.col("e")
    tau = F.floor(total * f + EPS).cast("int")
    return tau - F.pmod(total - tau, F.lit(2))


def _by_deletion() -> F.Column:
    """Lengths whose pairs are found by deletion variants; the others by segments."""
    lost = ((F.col("tau") + F.col("lr") - F.col("ls")) / 2).cast("int")  # of the longer string
    return (lost <= 1) | F.coalesce(*(F.when(lost == k, F.col("lr") <= n) for k, n in DELETIONS.items()), F.lit(False))


def _segments(df: DataFrame) -> DataFrame:
    """The tau + 1 even segments (no. ``i``, start ``p``, length ``len``) of a string of length ``ls``."""
    d = df.withColumn("m", F.col("tau") + 1).withColumn("base", F.floor(F.col("ls") / F.col("m")).cast("int")).withColumn("extra", F.col("ls") % F.col("m"))
    d = d.select("*", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("i"))
    d = d.withColumn("len", F.col("base") + F.when(F.col("i") >= F.col("m") - F.col("extra"), 1).otherwise(0))
    return d.withColumn("p", F.col("i") * F.col("base") + F.greatest(F.col("i") - (F.col("m") - F.col("extra")), F.lit(0))).where(F.col("len") > 0)


def _segment_keys(strings: DataFrame, f: float) -> tuple[DataFrame, DataFrame]:
    """(id, own, key) rows of the indexed side (the shorter or equal string) and of the probe side, of the lengths that
    deletion variants do not join; ``strings``: (id, g, e, s, own), compared where ``g``, a common part of ``e`` characters, is equal."""
    s = strings.select("id", "own", "g", "e", "s", F.length("s").alias("n")).where(F.col("n") > 0)
    others = (F.col("lr") - F.col("ls") <= F.col("tau")) & (F.col("tau") >= 1) & ~_by_deletion()
    whole_n = F.col("n") + F.col("e")
    longest = F.floor(whole_n * (1 + f) / (1 - f) + EPS).cast("int") - F.col("e")
    shortest = F.greatest(F.ceil(whole_n * (1 - f) / (1 + f) - EPS).cast("int") - F.col("e"), F.lit(1))
    idx = s.select("id", "own", "g", "e", "s", F.col("n").alias("ls"), F.explode(F.sequence("n", longest)).alias("lr")).withColumn("tau", _tau(f)).where(others)
    probe = s.select("id", "own", "g", "e", "s", F.col("n").alias("lr"), F.explode(F.sequence(shortest, F.col("n"))).alias("ls")).withColumn("tau", _tau(f)).where(others)

    def key(i, text):
        return F.struct("g", "ls", "lr", i.cast("int").alias("i"), text.alias("seg")).alias("key")

    # a string of no more than tau characters has no tau + 1 segments
    few = F.col("ls") <= F.col("tau")
    idx_few, probe_few = (d.where(few).select("id", "own", key(F.lit(-2), F.lit(""))) for d in (idx, probe))
    idx_seg = _segments(idx.where(~few)).select("id", "own", key(F.col("i"), F.substring("s", F.col("p") + 1, F.col("len"))))
    places = F.sequence(F.greatest(F.col("p") - F.col("tau"), F.lit(0)), F.least(F.col("p") + F.col("tau"), F.col("lr") - F.col("len")))
    probe_seg = _segments(probe.where(~few)).select("*", F.explode(places).alias("q")).select(
        "id", "own", key(F.col("i"), F.substring("s", F.col("q") + 1, F.col("len"))))
    return idx_few.unionByName(idx_seg), probe_few.unionByName(probe_seg)


def _common_and_rest(strings: DataFrame) -> DataFrame:
    """Every cut of a tag of 2 to SUBSET_WORDS words into common words ``g`` and a rest ``s``, neither of them empty."""
    d = strings.select("id", "own", F.split("s", " ").alias("ws")).withColumn("k", F.size("ws")).where(F.col("k").between(2, SUBSET_WORDS))
    d = d.select("id", "own", "ws", F.explode(F.expr("sequence(1, shiftleft(1, k) - 2)")).alias("m"))
    d = d.select("id", "own", F.expr("array_join(filter(ws, (w, i) -> getbit(m, i) = 1), ' ')").alias("g"), F.expr("array_join(filter(ws, (w, i) -> getbit(m, i) = 0), ' ')").alias("s"))
    return d.select("id", "g", (F.length("g") + 1).alias("e"), "s", "own")


def _rare_word_pairs(strings: DataFrame, f: float) -> DataFrame:
    """Pairs (x, y) whose common words may make up nearly all of ``x``."""
    words = strings.select("id", F.length("s").alias("n"), F.explode(F.split("s", " ")).alias("w"))
    counted = words.join(words.groupBy("w").agg(F.count(F.lit(1)).alias("df")), "w")
    cost = F.length("w") + 1
    before = F.sum(cost).over(Window.partitionBy("id").orderBy("df", "w")) - cost
    drop = F.col("n") * 2 * f / (1 + f) + EPS
    prefix = counted.withColumn("_before", before).where(F.col("_before") <= drop).select(F.col("id").alias("x"), "w")
    return prefix.join(words.select(F.col("id").alias("y"), "w"), "w").select("x", "y")


def _piece_pairs(index: DataFrame, probe: DataFrame, f: float) -> DataFrame:
    """Pairs (x, y), ``x`` no longer than ``y``, that share a word and, beside it, one of tau + 1 pieces of ``x``."""
    longest = F.floor(F.length("s") * (1 + f) / (1 - f) + EPS)

    def beside(d, *more):
        ws = F.split("s", " ")
        return d.select("id", F.length("s").alias("n"), ws.alias("ws"), *more, F.explode(ws).alias("w")).withColumn("rest", F.array_remove("ws", F.col("w")))

    x = beside(index, F.floor((F.length("s") + longest) * f + EPS).cast("int").alias("tau"))
    size = F.lit(0)  # no piece size gives enough pieces: every tag that has the word
    for p in range(1, PIECE + 1):
        enough = F.expr(f"aggregate(rest, 0, (a, r) -> a + cast(floor(length(r) / {p}) as int)) > tau")
        size = F.when(enough, p).otherwise(size)
    x = x.withColumn("p", size).withColumn("pieces", F.expr(
        "CASE WHEN p = 0 THEN array('') ELSE slice(flatten(transform(filter(rest, r -> length(r) >= p), "
        "r -> transform(sequence(0, cast(floor(length(r) / p) as int) - 1), j -> substring(r, j * p + 1, p)))), 1, tau + 1) END"))
    x = x.select(F.col("id").alias("x"), F.col("n").alias("ls"), "tau", "w", F.explode(F.array_distinct("pieces")).alias("piece"))
    grams = F.concat(F.array(F.lit("")), *(F.expr(
        f"flatten(transform(filter(rest, r -> length(r) >= {p}), r -> transform(sequence(1, length(r) - {p - 1}), j -> substring(r, j, {p}))))") for p in range(1, PIECE + 1)))
    y = beside(probe).select(F.col("id").alias("y"), F.col("n").alias("lr"), "w", F.explode(F.array_distinct(grams)).alias("piece"))
    near = (F.col("ls") <= F.col("lr")) & (F.col("lr") - F.col("ls") <= F.col("tau"))
    return x.join(y, ["w", "piece"]).where(near).select("x", "y")


def candidate_pairs(strings: DataFrame, threshold: int, mode: str = "simple") -> DataFrame:
    """Pairs (a, b), a < b, that may score >= threshold: a lossless superset
    of the similar pairs. ``strings``: (id, s), with a column ``own`` only
    pairs with a row where it is true need be among them."""
    f = (100.0 - threshold + 0.5) / 100.0
    asked = "own" in strings.columns
    strings = strings.select("id", "s", F.col("own") if asked else F.lit(False).alias("own"))
    parts = strings.select("id", F.lit("").alias("g"), F.lit(0).alias("e"), "s", "own")
    parts = parts.unionByName(_common_and_rest(strings)) if mode == "set" else parts
    idx_keys, pr_keys = _segment_keys(parts, f)
    idx_keys, pr_keys = idx_keys.select(F.col("id").alias("x"), F.col("own").alias("ox"), "key"), pr_keys.select(F.col("id").alias("y"), F.col("own").alias("oy"), "key")
    if asked:
        found = idx_keys.where("ox").join(pr_keys, "key").unionByName(idx_keys.where("NOT ox").join(pr_keys.where("oy"), "key"))
    else:
        found = idx_keys.join(pr_keys, "key")
    pairs = found.select("x", "y")
    if mode == "set":
        many = strings.where(F.size(F.split("s", " ")) > SUBSET_WORDS)
        pairs = pairs.unionByName(_rare_word_pairs(strings, f)).unionByName(_piece_pairs(strings, many, f)).unionByName(_piece_pairs(many, strings, f))
    pairs = pairs.where(F.col("x") != F.col("y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return pairs.unionByName(variant_pairs(parts, f, asked)).repartition("a").distinct()  # dealt as the join with the strings needs them


def similar_pairs(strings: DataFrame, threshold: int, mode: str = "simple") -> DataFrame:
    """Exact scores on the candidate pairs only: (a, b, score >= threshold).
    A JVM-side bounded Levenshtein check (Levenshtein <= Indel distance)
    drops most candidates before the Python scorer sees them (not in mode
    'set', whose score is no distance of the whole strings)."""
    f = (100.0 - threshold + 0.5) / 100.0
    cand = candidate_pairs(strings, threshold, mode)
    s1, s2 = strings.select(F.col("id").alias("a"), F.col("s").alias("sa")), strings.select(F.col("id").alias("b"), F.col("s").alias("sb"))
    j = cand.join(s1, "a").join(s2, "b")
    if mode == "set":
        return j.withColumn("score", set_ratio_udf("sa", "sb")).where(F.col("score") >= threshold).select("a", "b", "score")
    j = j.withColumn("_tau", F.floor((F.length("sa") + F.length("sb")) * f + EPS).cast("int"))
    j = j.where(F.expr("levenshtein(sa, sb, _tau) >= 0"))
    scored = j.withColumn("score", ratio_udf("sa", "sb"))
    return scored.where(F.col("score") >= threshold).select("a", "b", "score")


def _nodes(tags: DataFrame, mode: str, seed: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, tags): nodes (id, s, tag), one per distinct prepared string, with
    its first tag by seeded hash, ids in the order of these (0 = highest
    priority); tags (tag, h, s), each distinct tag once. Both are written. In
    mode 'set' a tag without a word has no node."""
    d = tags.select("tag").where(F.col("tag").isNotNull()).distinct().select("tag", F.xxhash64("tag", F.lit(seed)).alias("h"), prepared("tag", mode).alias("s"))
    d = cut_lineage(d, "fuzzy_tags")
    worded = d.where(F.col("s") != "") if mode == "set" else d
    first = worded.groupBy("s").agg(F.min(F.struct("h", "tag")).alias("_f")).select("s", "_f.h", "_f.tag")
    return cut_lineage(dense_index(first, ["h", "tag"], "id").select("id", "s", "tag"), "fuzzy_nodes"), d


def canonical_tags(tags: DataFrame, threshold: int = 90, mode: str = "simple", seed: int = 0, max_rounds: int = 1000) -> DataFrame:
    """(tag, leader, is_leader) for every distinct tag of ``tags(tag)``."""
    nodes, every = _nodes(tags, mode, seed)
    strings = nodes.select("id", "s")
    edges = cut_lineage(similar_pairs(strings, threshold, mode).select(F.col("a").alias("hi"), F.col("b").alias("lo")), "fuzzy_edges")
    # pairs of undecided nodes: a node without one above it leads, those below a leader are members
    left, members = edges, []
    for _ in range(max_rounds):
        led = left.join(left.select(F.col("lo").alias("hi")).distinct(), "hi", "left_anti")
        members.append(cut_lineage(led.select("lo").distinct(), "fuzzy_members"))
        left = left.join(members[-1], "lo", "left_anti").join(members[-1].select(F.col("lo").alias("hi")), "hi", "left_anti")
        left = cut_lineage(left, "fuzzy_left")
        if left.isEmpty():
            break
    else:
        raise RuntimeError(f"leaders were not decided in {max_rounds} rounds")
    # a member was led by a node above it, so its highest-priority similar leader is above it
    below = reduce(DataFrame.unionByName, members).select(F.col("lo").alias("hi"))
    best = edges.join(below, "hi", "left_anti").groupBy("lo").agg(F.min("hi").alias("lid"))
    # a leading node is led by its first tag, its other tags are members of it
    led = nodes.select("id", "s").join(best, F.col("id") == F.col("lo"), "left").select("s", F.coalesce("lid", "id").alias("lid"))
    led = led.join(nodes.select(F.col("id").alias("lid"), F.col("tag").alias("leader")), "lid")
    out = every.join(led.select("s", "leader"), "s").select("tag", "leader")
    if mode == "set":
        out = out.unionByName(every.where("s = ''").select("tag", F.col("tag").alias("leader")))
    return out.select("tag", "leader", (F.col("tag") == F.col("leader")).alias("is_leader"))


def canonicalise(tag_lists: DataFrame, mapping: DataFrame, key: str = "pid", col: str = "tags") -> DataFrame:
    """Replace every tag of a list column by its leader (order kept; a tag
    without one stays, an empty or null list is empty)."""
    ex = tag_lists.select(key, F.posexplode_outer(col).alias("_p", "tag"))
    j = ex.join(mapping.select("tag", "leader"), "tag", "left")
    entry = F.when(F.col("_p").isNotNull(), F.struct("_p", F.coalesce("leader", "tag").alias("t")))
    g = j.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("_s"))
    return g.select(key, F.col("_s.t").alias(col))


def lookup(queries: DataFrame, mapping: DataFrame, threshold: int = 90, mode: str = "simple", seed: int = 0,
           default: str | None = None) -> DataFrame:
    """Canonical leader for new strings ``queries(query)``: the
    highest-priority leader scoring >= threshold, else ``default``."""
    leaders = mapping.where("is_leader").select(F.col("tag").alias("t"), F.lit(1).alias("ld"), F.lit(0).alias("qy"))
    q = queries.select(F.col("query").alias("t"), F.lit(0).alias("ld"), F.lit(1).alias("qy")).where(F.col("t").isNotNull())
    sides = leaders.unionByName(q).groupBy("t").agg(F.max("ld").alias("ld"), F.max("qy").alias("qy")).withColumnRenamed("t", "tag")
    sides = cut_lineage(sides, "fuzzy_sides")  # the mapping is read once
    nodes, every = _nodes(sides, mode, seed)
    sides = every.join(sides, "tag").join(nodes.select("id", "s"), "s", "left").select("id", "tag", "h", "ld", "qy")
    # nodes without a query or without a leader need no partner of their kind
    has = sides.where("id IS NOT NULL").groupBy("id").agg(F.min(F.when(F.col("ld") == 1, F.struct("h", "tag"))).alias("lead"), F.max("qy").alias("qy"))
    has = cut_lineage(has, "fuzzy_has")
    asked = nodes.join(has.select("id", (F.col("qy") == 1).alias("own")), "id").select("id", "s", "own")
    pairs = cut_lineage(similar_pairs(cut_lineage(asked, "fuzzy_asked"), threshold, mode), "fuzzy_pairs")
    both = pairs.select(F.col("a").alias("id"), F.col("b").alias("lid")).unionByName(pairs.select(F.col("b").alias("id"), F.col("a").alias("lid")))
    both = both.join(has.where(F.col("qy") == 1).select("id"), "id", "left_semi")
    lead = has.where(F.col("lead").isNotNull()).select(F.col("id").alias("lid"), "lead")
    same = lead.select(F.col("lid").alias("id"), "lead")
    best = both.join(lead, "lid").select("id", "lead").unionByName(same).groupBy("id").agg(F.min("lead").alias("near"))
    out = sides.where(F.col("qy") == 1).join(best, "id", "left")
    return out.select(F.col("tag").alias("query"), F.coalesce(F.when((F.col("ld") == 1) & F.col("id").isNotNull(), F.col("tag")), F.col("near.tag"), F.lit(default)).alias("leader"))


def merge_report(mapping: DataFrame) -> DataFrame:
    """Tags merged into another leader, plus corpus / domain sizes."""
    sizes = mapping.agg(F.count(F.lit(1)).alias("n_tags"), F.count_if("is_leader").alias("n_leaders"))
    merged = mapping.where(~F.col("is_leader")).select("tag", "leader")
    return merged.crossJoin(F.broadcast(sizes))  # one-row sizes
