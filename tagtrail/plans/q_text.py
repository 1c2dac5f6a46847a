"""Registered queries: generated-text parsing, JSON / CSV / text I/O,
training-log reports, enhanced tags and the evaluation grid."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from .. import sinks
from ..functions import text as T
from ..operators import expand, metrics as M, reports, tagquery, bm25
from ..session import cut_lineage, scratch_path
from ..sources import fixtures as fx, json_maps as J
from . import tag_eval as TE
from .prepare import prepare
from .registry import register

LOG_SCHEMA = StructType([
    StructField("epoch", IntegerType()), StructField("split", StringType()),
    StructField("hr@20", DoubleType()), StructField("ndcg@20", DoubleType()),
])


def _j(c, sep="|"):
    return F.array_join(F.col(c) if isinstance(c, str) else c, sep)


@register("parse_tags")
def q_parse_tags(spark: SparkSession, sf: str) -> DataFrame:
    p = fx.predictions(spark, sf)
    return p.select("pid", _j(T.parse_tags("raw_predict")).alias("tags"),
                    _j(T.parse_tags("raw_predict", exclude_inputs=True)).alias("tags_no_input"))


@register("parse_words")
def q_parse_words(spark: SparkSession, sf: str) -> DataFrame:
    p = fx.predictions(spark, sf)
    return p.select("pid", _j(T.parse_words("raw_predict")).alias("words"),
                    _j(T.parse_words("raw_predict", exclude_inputs=True)).alias("words_no_input"))


@register("drop_first_line")
def q_drop_first_line(spark: SparkSession, sf: str) -> DataFrame:
    return fx.predictions(spark, sf).select("pid", T.drop_first_line("raw_predict").alias("text"))


@register("enhanced_tags")
def q_enhanced_tags(spark: SparkSession, sf: str) -> DataFrame:
    e = reports.enhanced_tags(fx.predictions(spark, sf), max_len=9, add_pid_tag=3)
    return e.select("pid", _j("tags").alias("tags"))


@register("enhanced_words")
def q_enhanced_words(spark: SparkSession, sf: str) -> DataFrame:
    e = reports.enhanced_words(fx.predictions(spark, sf), max_len=None, add_pid_word=True)
    return e.select("pid", _j("tags").alias("tags"))


@register("pid_only_tags")
def q_pid_only_tags(spark: SparkSession, sf: str) -> DataFrame:
    return reports.pid_only_tags(fx.products(spark, sf)).select("pid", _j("tags").alias("tags"))


@register("clean_generation")
def q_clean_generation(spark: SparkSession, sf: str) -> DataFrame:
    return fx.generations(spark, sf).select("pid", T.clean_generation("generation").alias("text"))


@register("tags_lower")
def q_tags_lower(spark: SparkSession, sf: str) -> DataFrame:
    return fx.tags(spark, sf).select("pid", _j(J.lower_tags("tags")).alias("tags"))


# ------------------------------------------------------------------ I/O ----
@register("src_json_tag_map")
def q_src_json_tag_map(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "tag_map")
    sinks.write_json_map(fx.tags(spark, sf), "pid", "tags", path)
    return J.read_tag_map(spark, path, lower=True).select("pid", _j("tags").alias("tags"))


@register("sink_json_map")
def q_sink_json_map(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "pred_map")
    sinks.write_json_map(fx.predictions(spark, sf), "pid", "raw_predict", path, entries_per_object=50)
    return J.read_text_map(spark, path, value_name="raw_predict").withColumnRenamed("id", "pid")


@register("src_json_text_map")
def q_src_json_text_map(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "gen_map")
    sinks.write_json_map(fx.generations(spark, sf), "pid", "generation", path)
    back = J.read_text_map(spark, path, value_name="generation")
    return back.select(F.col("id").alias("pid"), T.clean_generation("generation").alias("text"))


@register("sink_json_ids")
def q_sink_json_ids(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "ids")
    sinks.write_json_ids(fx.products(spark, sf), "pid", path, entries_per_array=25)
    return spark.read.text(path).select(F.col("value").alias("json"))


@register("src_json_id_list")
def q_src_json_id_list(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "ids")
    sinks.write_json_ids(fx.products(spark, sf), "pid", path)
    return J.read_id_list(spark, path)


@register("src_csv_metrics")
def q_src_csv_metrics(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "log_csv")
    sinks.write_csv(fx.training_log(spark, sf), path)
    return J.read_metrics_csv(spark, path, LOG_SCHEMA)


@register("sink_csv_report")
def q_sink_csv_report(spark: SparkSession, sf: str) -> DataFrame:
    from .q_eval import q_metrics_report

    path = scratch_path(spark, "report_csv")
    rep = q_metrics_report(spark, sf)
    sinks.write_csv(rep, path)
    return spark.read.csv(path, header=True, schema=rep.schema)


@register("src_name_list")
def q_src_name_list(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "names")
    sinks.write_names(fx.read_table(spark, sf, "customer").select("c_name"), "c_name", path, per_line=100)
    return J.read_name_list(spark, path)


@register("run_id_hash")
def q_run_id_hash(spark: SparkSession, sf: str) -> DataFrame:
    """K5: predictions keyed by the hash of their generation config."""
    cfg = F.concat(F.lit('{"do_sample":true,"temperature":'), F.col("p_size").cast("string"), F.lit(',"top_p":0.3}'))
    part = fx.read_table(spark, sf, "part").select("p_partkey", "p_size")
    return part.select(F.col("p_partkey").alias("pid"), sinks.run_id(cfg).alias("run_id"))


# ------------------------------------------------------------ reports -----
@register("metrics_log_head")
def q_metrics_log_head(spark: SparkSession, sf: str) -> DataFrame:
    return reports.log_head(fx.training_log(spark, sf), 10)


@register("metrics_log_best")
def q_metrics_log_best(spark: SparkSession, sf: str) -> DataFrame:
    return reports.log_best(fx.training_log(spark, sf), "ndcg@20")


@register("metrics_log_last")
def q_metrics_log_last(spark: SparkSession, sf: str) -> DataFrame:
    return reports.log_last(fx.training_log(spark, sf))


@register("epoch_vs_reference_metric")
def q_epoch_vs_reference_metric(spark: SparkSession, sf: str) -> DataFrame:
    n = expand.next_item_last(prepare(spark, sf).merged)
    ref = TE.tag_metrics(n, TE.next_item_truth(n), fx.tags(spark, sf), fx.products(spark, sf), "union", alpha=1.0)
    return reports.vs_reference(fx.training_log(spark, sf), ref, "ndcg@20")


# ---------------------------------------------------------- eval grid -----
GRID_MAX_LEN = (8, 9, 10)
GRID_N_PID = (0, 1, 2, 3, 4, 5, 6)
GRID_QUERY = ("sum", "union", "last")
GRID_ROWS = 500_000  # scores (of all query functions) that a partition holds
GRID_PARTITIONS = 20_000  # more partitions than this cost more than they save


def grid_frame(spark: SparkSession) -> DataFrame:
    rows = [(f"l{m}_p{p}", m, p) for m in GRID_MAX_LEN for p in GRID_N_PID]
    return spark.createDataFrame(rows, "cell string, max_len int, n_pid int")


@register("eval_grid")
def q_eval_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Every (query function x max tag length x pid-tag count x split)
    evaluated in one job. The cells are a small literal table; one index with
    the cell as its group serves all query functions.

    A sequence is not copied to the cells: the counts of a product's terms, the
    weights of a posting and the scores of a product are arrays with an entry
    for each cell, so terms are joined and added up once. A target's rank is
    counted, not sorted for.

    The sequences are shuffled once, by order, into partitions that hold about GRID_ROWS scores each: an order's
    queries, scores, ranks and hits stay in its partition, and what leaves it
    are the sums of its hits."""
    cells = F.broadcast(grid_frame(spark))
    order = F.concat_ws("#", F.lit("o"), F.col("order_id").cast("string")).alias("order")  # null ids are one order
    n = expand.next_item_last(prepare(spark, sf).merged).select(order, "split", "prefix", "target")
    n = cut_lineage(n, "grid_sequences")  # counted, queried and read as the truth
    preds = fx.predictions(spark, sf).join(fx.products(spark, sf), "pid", "left_semi")
    parsed = preds.select("pid", T.parse_tags("raw_predict").alias("_t"))
    tags = parsed.crossJoin(cells).select(
        "cell", "pid", F.concat(F.slice("_t", 1, F.col("max_len")), F.array_repeat(F.col("pid").cast("string"), F.col("n_pid"))).alias("tags"))
    tags = cut_lineage(tags, "grid_tags")  # read by the index and by the queries
    n = n.repartition(grid_partitions(spark, n.count(), tags.count()), "order")
    names = [r.cell for r in cells.collect()]  # the literal table's
    asked = tagquery.build_queries(n, tags, GRID_QUERY, "order", cells=names)
    idx = bm25.build_index(tags, "pid", "tags", k1=0.75, alpha=1.0, group=["cell"])
    idx = bm25.in_cells(idx, names)
    idx = replace(idx, postings=cut_lineage(idx.postings, "grid_postings"))  # written, the planner sees their bytes
    found = bm25.score(idx, asked, "order", doc_alias="pid", qty=GRID_QUERY, into=GRID_QUERY, cells=len(names))
    scores = found.select("order", "pid", F.concat(*GRID_QUERY).alias("scores"))
    truth = n.select("order", "split", F.col("target").alias("pid"))
    places = [(q, c, i) for i, (q, c) in enumerate((q, c) for q in GRID_QUERY for c in names)]
    configs = spark.createDataFrame(places, "qf string, cell string, at int")
    out = M.ranking_metrics(scores, truth, (5, 10, 20), "order", ["split"], configs=configs)
    return out.select(F.concat_ws("_", "qf", "cell").alias("config_id"), *out.columns[2:])


def grid_partitions(spark: SparkSession, orders: int, documents: int) -> int:
    """Partitions in which ``orders`` sequences meet ``documents`` (over all cells) about GRID_ROWS times each."""
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return min(max(least, -(-orders * documents // GRID_ROWS)), max(least, GRID_PARTITIONS))
