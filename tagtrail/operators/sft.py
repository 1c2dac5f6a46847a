"""Instruction-tuning data from browse sequences.

Sequences are rendered as numbered tag lines "i. t1, t2, ..." per product:
explode, join, regroup; the planner picks the join by bytes."""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import text as T
from . import expand
from .indexing import dense_index


def _line(i: Column, tags: Column, n_tags: int) -> Column:
    return F.concat((i + 1).cast("string"), F.lit(". "), F.array_join(F.slice(tags, 1, n_tags), ", "))


def render_lines(df: DataFrame, tags: DataFrame, seq_col: str, key: Sequence[str], n_tags: int = 5,
                 max_len: int = 20, out: str = "lines") -> DataFrame:
    """I1 + T3 + J4: the last ``max_len`` items of the sequence as numbered
    tag lines (ARRAY<STRING>). ``key`` identifies a row; every row stays. A
    sequence without items has no lines, an item without tags a null line; of
    several tag lists of a product the smallest counts."""
    key = list(key)
    seq = T.last_n(seq_col, max_len)
    one = tags.groupBy("pid").agg(F.min("tags").alias("tags"))
    ex = df.select(*key, F.posexplode(seq).alias("_i", "pid"))
    line = F.struct("_i", _line(F.col("_i"), F.col("tags"), n_tags).alias("l"))
    grouped = ex.join(one, "pid", "left").groupBy(*key).agg(F.array_sort(F.collect_list(line)).alias("_ls"))
    none = F.when(F.col(seq_col).isNotNull(), F.array().cast("array<string>"))
    return df.join(grouped, key, "left").withColumn(out, F.coalesce(F.col("_ls.l"), none)).drop("_ls")


def purchase_record(lines: str = "lines") -> list[Column]:
    """input = all lines but the last + "\\n{n}.", output = last line de-numbered."""
    n = F.size(lines)
    return [
        F.concat(F.array_join(F.slice(lines, 1, n - 1), "\n"), F.lit("\n"), n.cast("string"), F.lit(".")).alias("input"),
        T.denumber(F.element_at(lines, -1)).alias("output"),
    ]


def continuation_record(lines: str = "lines") -> list[Column]:
    """I4: input = first line + "\\n2.", output = the rest, only its first
    line de-numbered."""
    n = F.size(lines)
    second = T.denumber(F.element_at(lines, 2))
    rest = F.concat(second, F.lit("\n"), F.array_join(F.slice(lines, 3, F.greatest(n - 2, F.lit(1))), "\n"))
    return [
        F.concat(F.element_at(lines, 1), F.lit("\n2.")).alias("input"),
        F.when(n == 2, second).otherwise(rest).alias("output"),
    ]


def user_instruction(names: DataFrame | None, df: DataFrame, key: str = "uuid_ind") -> DataFrame:
    """J5: 'User: <name>' from a (uuid_ind, user_name) table, '' without one."""
    if names is None:
        return df.withColumn("instruction", F.lit(""))
    j = df.join(names.select(key, "user_name"), key, "left")
    return j.withColumn("instruction", F.concat(F.lit("User: "), F.col("user_name"))).drop("user_name")


def dataset(orders: DataFrame, tags: DataFrame, mode: str, names: DataFrame | None = None,
            n_tags: int = 5, max_len: int = 20, seed: int = 0) -> DataFrame:
    """Instruction records in a seeded random order (``shuffle_rank``). Modes:

    * ``loaded``: loads of orders with at least two, continuation records;
    * ``concatenated``: loads and then the purchases in a random order, continuation records;
    * ``expanded``: one purchase record per purchased product.

    With ``names`` (uuid_ind, user_name) a user without a name is an error."""
    key = ["order_id"]
    if mode == "loaded":
        seqs = expand.loaded_only_sequences(orders)
    elif mode == "concatenated":
        seqs = expand.concat_purchases(orders, seed)
    elif mode == "expanded":
        seqs, key = expand.expand_purchases(orders), ["order_id", "product"]
    else:
        raise ValueError(f"unknown mode {mode!r}")
    lines = user_instruction(names, render_lines(seqs, tags, "seq", key, n_tags, max_len))
    if names is not None:
        missing = F.raise_error(F.concat(F.lit("no name for user "), F.col("uuid_ind").cast("string"))).cast("string")
        lines = lines.withColumn("instruction", F.coalesce("instruction", missing))
    record = purchase_record() if mode == "expanded" else continuation_record()
    return shuffle_rank(lines.select(*key, "instruction", *record), key, seed)


def product_prompts(catalogue: DataFrame, tags: DataFrame, n_tags: int = 5) -> DataFrame:
    """One tag-generation prompt per catalogue product."""
    j = catalogue.select("pid").join(tags.select("pid", "tags"), "pid")
    return j.select(
        "pid", F.lit("").alias("instruction"),
        F.concat(F.lit("1. "), F.array_join(F.slice("tags", 1, n_tags), ", "), F.lit("\n2.")).alias("input"),
    )


def test_prompts(nxt: DataFrame, tags: DataFrame, n_tags: int = 5, max_len: int = 20) -> DataFrame:
    """Next-item prompts: the rendered prefix + "\\n{n+1}."."""
    r = render_lines(nxt, tags, "prefix", ["order_id"], n_tags, max_len)
    return r.select(
        "order_id", F.lit("").alias("instruction"),
        F.concat(F.array_join("lines", "\n"), F.lit("\n"), (F.size("lines") + 1).cast("string"), F.lit(".")).alias("input"),
    )


def fill_template(template: str, **fields: Column) -> Column:
    """A str.format template filled with Columns (concat of literal
    pieces and field values)."""
    parts: list[Column] = []
    for lit, field, _spec, _conv in string.Formatter().parse(template):
        if lit:
            parts.append(F.lit(lit))
        if field is not None:
            parts.append(fields[field])
    return F.concat(*parts)


def prompt_text(system_instruction: str, legacy: bool = False) -> Column:
    """The chat prompt of a record (columns instruction, input)."""
    tpl = C.PROMPT_LEGACY if legacy else C.PROMPT
    return fill_template(tpl, instruction=F.lit(system_instruction), user_instruction=F.col("instruction"), input=F.col("input"))


def _tokens(c: Column) -> Column:
    return F.filter(F.split(c, r"(?U)\s+"), lambda t: t != "")


PAD, BOS, EOS = 0, 1, 2


def build_vocab(texts: DataFrame, col: str = "text") -> DataFrame:
    """Whitespace vocabulary: distinct tokens, ids 3.. in byte order (0 pad,
    1 bos, 2 eos)."""
    toks = texts.select(F.explode(_tokens(F.col(col))).alias("token")).distinct()
    return dense_index(toks, ["token"], "id").select("token", (F.col("id") + 3).alias("id"))


def whitespace_tokenizer(vocab: dict[str, int], unknown_id: int | None = None) -> Callable[[], Callable[[str], list[int]]]:
    """A tokenizer for ``token_labels`` over a small fixed vocabulary; a token it lacks takes ``unknown_id`` or is an error."""
    import re

    def make():
        def encode(text: str) -> list[int]:
            out = [vocab.get(t, unknown_id) for t in re.split(r"\s+", text) if t]
            if None in out:
                raise ValueError("token not in the vocabulary")
            return out

        return encode

    return make


def _encoder(tokenizer: Callable[[], Callable[[str], list[int]]]) -> Callable[[str], Column]:
    """A Column function text -> token ids; ``tokenizer()`` is called once per task, whole Arrow batches go through it."""

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = tokenizer()
        for texts in batches:
            yield pd.Series([None if t is None else list(of(t)) for t in texts], dtype=object)

    return encode


def _ids(df: DataFrame, key: Sequence[str], text_col: str, vocab: DataFrame, out: str, unknown_id: int | None) -> DataFrame:
    ex = df.select(*key, F.posexplode(_tokens(F.col(text_col))).alias("_p", "token"))
    unknown = F.raise_error(F.concat(F.lit("token not in the vocabulary: "), F.col("token"))).cast("int") if unknown_id is None else F.lit(unknown_id)
    j = ex.join(vocab, "token", "left").withColumn("id", F.coalesce(F.col("id").cast("int"), unknown))
    return j.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_p", "id"))).alias("_s")).select(
        *key, F.col("_s.id").alias(out)
    )


def token_labels(records: DataFrame, key: Sequence[str], system_instruction: str, vocab: DataFrame | None = None,
                 cutoff: int = C.CUTOFF_LEN, true_mask: bool = False, reference_prompt_padding: bool = False,
                 unknown_id: int | None = None, tokenizer: Callable[[], Callable[[str], list[int]]] | None = None,
                 special: tuple[int, int, int] = (PAD, BOS, EOS)) -> DataFrame:
    """I8: causal-LM arrays of length ``cutoff``: input_ids = bos + prompt +
    output + eos, truncated / padded; labels = -100 on prompt positions, then
    the ids; attention_mask all ones (the reference also masks padding in;
    ``true_mask`` zeroes it). ``reference_prompt_padding`` reproduces the
    reference's padded prompt count (every label becomes -100). A token that
    ``vocab`` lacks takes ``unknown_id``; without one it is an error.

    ``tokenizer``, a function that makes an encoder (text -> ids) inside a task,
    replaces the vocabulary: any subword tokenizer, ``whitespace_tokenizer``
    among them. Prompt and output are encoded row by row, with no row per token
    and no shuffle. ``special`` are the ids of pad, bos and eos."""
    from ..session import cut_lineage

    key = list(key)
    pad_id, bos, eos = special
    if tokenizer is not None:
        encode = _encoder(tokenizer)
        j = records.select(*key, encode(prompt_text(system_instruction)).alias("_pi"), encode("output").alias("_oi"))
        return _label_arrays(j, key, cutoff, true_mask, reference_prompt_padding, pad_id, bos, eos)
    # used four times below: materialise once
    rec = cut_lineage(records.select(*key, prompt_text(system_instruction).alias("_prompt"), "output"), "sft_records")
    if vocab is None:
        vocab = build_vocab(rec.select(F.concat_ws(" ", "_prompt", "output").alias("text")))
    p = _ids(rec, key, "_prompt", vocab, "_pi", unknown_id)
    o = _ids(rec, key, "output", vocab, "_oi", unknown_id)
    j = rec.select(*key).join(p, key, "left").join(o, key, "left")
    return _label_arrays(j, key, cutoff, true_mask, reference_prompt_padding, pad_id, bos, eos)


def _label_arrays(j: DataFrame, key: list[str], cutoff: int, true_mask: bool, reference_prompt_padding: bool, pad_id: int, bos: int, eos: int) -> DataFrame:
    """The three arrays of a row with prompt ids ``_pi`` and output ids ``_oi`` (null: none)."""
    empty = F.array().cast("array<int>")
    full = F.concat(F.array(F.lit(bos)), F.coalesce("_pi", empty), F.coalesce("_oi", empty), F.array(F.lit(eos)))
    j = j.withColumn("_full", F.slice(full, 1, cutoff)).withColumn("_np", F.size(F.coalesce("_pi", empty)) + 1)
    pad = F.array_repeat(F.lit(pad_id), F.lit(cutoff) - F.size("_full"))
    ids = F.concat("_full", pad)
    n_prompt = F.lit(cutoff) if reference_prompt_padding else F.least(F.col("_np"), F.lit(cutoff))
    labels = F.concat(F.array_repeat(F.lit(C.LABEL_IGNORE), n_prompt), F.slice(ids, n_prompt + 1, cutoff))
    mask = F.concat(F.array_repeat(F.lit(1), F.size("_full")), F.array_repeat(F.lit(0), F.lit(cutoff) - F.size("_full"))) if true_mask \
        else F.array_repeat(F.lit(1), F.lit(cutoff))
    return j.select(*key, ids.alias("input_ids"), labels.alias("labels"), mask.alias("attention_mask"))


def shuffle_rank(df: DataFrame, key: Sequence[str], seed: int = 0) -> DataFrame:
    """T4: a seeded, reproducible random order of rows (``shuffle_rank``)."""
    h = F.md5(F.concat_ws(":", *[F.col(k).cast("string") for k in key], F.lit(str(seed))))
    return dense_index(df.withColumn("_h", h), ["_h", *key], "shuffle_rank").drop("_h")


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """N rows in a seeded random order: the n smallest md5(key:seed)
    (a top-n, planned as TakeOrderedAndProject -- no full sort)."""
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))), key).limit(n)


def with_configs(prompts: DataFrame, configs: list[dict]) -> DataFrame:
    """Every prompt paired with every generation config. The configs are
    a literal array exploded per row (no join)."""
    structs = [F.struct(F.lit(i).alias("config_id"), *[F.lit(v).alias(k) for k, v in cfg.items()]) for i, cfg in enumerate(configs)]
    return prompts.select("*", F.explode(F.array(*structs)).alias("config")).select("*", "config.*").drop("config")


def assign_user_names(orders: DataFrame, names: DataFrame, seed: int = 0) -> DataFrame:
    """Users with more than two orders get distinct names (without
    replacement); users with two orders a name drawn from the remaining ones
    (with replacement); one-order users 'First time buyer'. Too few names are an
    error, no user is left out. Ranks come from
    the md5 of ``key:seed``, draws from that of ``key:seed+1`` modulo the remaining count."""
    mark = lambda c, s: F.md5(F.concat(F.col(c).cast("string"), F.lit(f":{s}")))
    counts = orders.groupBy("uuid_ind").agg(F.count(F.lit(1)).alias("n_orders"))
    frequent = dense_index(counts.where(F.col("n_orders") > 2).withColumn("_h", mark("uuid_ind", seed)),
                           ["_h", "uuid_ind"], "_r")
    ranked_names = dense_index(names.select("name").distinct().withColumn("_h", mark("name", seed)), ["_h", "name"], "_r")
    n_freq = frequent.agg(F.count(F.lit(1)).alias("_nf"))
    n_names = ranked_names.agg(F.count(F.lit(1)).alias("_nn"))
    too_few = F.raise_error(F.lit("fewer names than users with two or more orders need")).cast("string")
    named = ranked_names.select("_r", F.coalesce("name", F.lit("")).alias("user_name"))
    a = frequent.join(named, "_r", "left").select("uuid_ind", "n_orders", F.coalesce("user_name", too_few).alias("user_name"))
    twice = counts.where(F.col("n_orders") == 2).crossJoin(F.broadcast(n_freq.crossJoin(n_names)))  # one-row counts
    drawn = F.conv(F.substring(mark("uuid_ind", seed + 1), 1, 8), 16, 10).cast("bigint")
    twice = twice.withColumn("_r", F.col("_nf") + drawn % F.greatest(F.col("_nn") - F.col("_nf"), F.lit(1)))
    b = twice.join(named, "_r", "left").select("uuid_ind", "n_orders", F.coalesce("user_name", too_few).alias("user_name"))
    c = counts.where(F.col("n_orders") == 1).select("uuid_ind", "n_orders", F.lit(C.FIRST_TIME_BUYER).alias("user_name"))
    return a.unionByName(b).unionByName(c)
