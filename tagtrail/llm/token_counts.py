"""Token counts with a linear longest-match automaton.

Words (runs of letters, digits and underscores, or one other visible
character) are matched greedily against a word-piece vocabulary. The
vocabulary's trie has two roots, one for word starts and one for
continuations; every node has a failure link and the number of pieces that are
popped when it is followed, so one pass over a word's bytes counts its pieces
without building them and without going back.

The vocabulary comes from a public byte-level file by rule: an entry that
begins with a space starts words (without that space), the others continue
words, and every single byte does both, so no word is unknown. The file is
read on the driver, checked against ``VOCABULARY_BYTES`` and broadcast as
arrays.

Edge cases: null, empty and blank texts have 0 words and 0 tokens; a word of
any length is counted in one pass; rows are counted one by one, so repeated
rows repeat their result; other columns pass through.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import no_clash, small_batches

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
VOCABULARY_BYTES = 32 << 20
CACHE_WORDS = 200_000  # word lengths a task remembers before it starts afresh (memory only, not results)
WORD = re.compile(r"\w+|[^\w\s]")
START, CONTINUE = 0, 1  # the two roots


def word_pieces(path: str = VOCABULARY) -> tuple[set[bytes], set[bytes]]:
    """(pieces that start a word, pieces that continue one)."""
    with open(path, "rb") as f:
        raw = f.read(VOCABULARY_BYTES + 1)
    if len(raw) > VOCABULARY_BYTES:
        raise ValueError(f"{path} has more than {VOCABULARY_BYTES} bytes")
    entries = [base64.b64decode(line.split()[0]) for line in raw.splitlines() if line]
    single = {bytes([i]) for i in range(256)}
    return single | {e[1:] for e in entries if e[:1] == b" " and len(e) > 1}, single | {e for e in entries if e[:1] != b" "}


def automaton(starts: set[bytes], continues: set[bytes]) -> dict[str, np.ndarray]:
    """Edges (node * 256 + byte -> node), failure links, popped counts and counts at a word's end."""
    edge: dict[int, int] = {}
    piece = [False, False]
    parent_edge = [(-1, 0), (-1, 0)]
    for root, vocab in ((START, starts), (CONTINUE, continues)):
        for entry in vocab:
            node = root
            for byte in entry:
                nxt = edge.get(node * 256 + byte)
                if nxt is None:
                    nxt = edge[node * 256 + byte] = len(piece)
                    piece.append(False)
                    parent_edge.append((node, byte))
                node = nxt
            piece[node] = True
    size = len(piece)
    fail, popped, at_end = [-1] * size, [0] * size, [0] * size
    depth = [0] * size
    for node in range(2, size):
        depth[node] = depth[parent_edge[node][0]] + 1
    for node in sorted(range(2, size), key=depth.__getitem__):
        if piece[node]:
            fail[node], popped[node] = CONTINUE, 1
        else:
            up, byte = parent_edge[node]
            back, n = fail[up], popped[up]
            while back >= 0 and (nxt := edge.get(back * 256 + byte)) is None:
                n += popped[back]
                back = fail[back]
            # single bytes are pieces, so only roots run out of links
            fail[node], popped[node] = nxt, n
        at_end[node] = popped[node] + at_end[fail[node]]
    keys = np.fromiter(edge, np.int64, len(edge))
    return {"keys": keys, "to": np.fromiter(edge.values(), np.int32, len(edge)), "fail": np.array(fail, np.int32), "popped": np.array(popped, np.int32), "at_end": np.array(at_end, np.int64)}


class Counter(dict):
    """word -> number of greedy pieces; unseen words run through the automaton."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        super().__init__()
        self.edge = dict(zip(arrays["keys"].tolist(), arrays["to"].tolist()))
        self.fail, self.popped, self.at_end = (arrays[k].tolist() for k in ("fail", "popped", "at_end"))

    def __missing__(self, word: str) -> int:
        edge, fail, popped = self.edge.get, self.fail, self.popped
        node, n = START, 0
        for byte in word.encode("utf-8", "surrogatepass"):
            nxt = edge(node * 256 + byte)
            while nxt is None:
                n += popped[node]
                node = fail[node]
                nxt = edge(node * 256 + byte)
            node = nxt
        n += self.at_end[node]
        if len(word) <= 64:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = n
        return n


def counter(spark: SparkSession, vocabulary: str = VOCABULARY):
    """A Column function text -> struct(n_words, n_tokens)."""
    small_batches(spark)
    arrays = spark.sparkContext.broadcast(automaton(*word_pieces(vocabulary)))
    state: dict[str, Counter] = {}

    @F.pandas_udf("n_words long, n_tokens long")
    def count(text: pd.Series) -> pd.DataFrame:
        if not state:
            state["counter"] = Counter(arrays.value)
        of = state["counter"].__getitem__
        words = [WORD.findall(t) if isinstance(t, str) else [] for t in text]
        return pd.DataFrame({"n_words": [len(w) for w in words], "n_tokens": [sum(map(of, w)) for w in words]}, dtype="int64")

    return count


def count_tokens(docs: DataFrame, text: str = "text", into: str = "tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """``docs`` with a struct column ``into`` (n_words, n_tokens); a column of that name in ``docs`` is an error."""
    no_clash(docs, into)
    return docs.withColumn(into, counter(docs.sparkSession, vocabulary)(F.col(text)))
