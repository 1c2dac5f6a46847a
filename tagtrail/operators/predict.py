"""H3-H5: distributed batch generation with a caller-supplied predictor.

The predictor is created once per task (``factory()``), then fed
Arrow batches through ``mapInPandas``. A deterministic stub predictor is
provided for tests; a model-backed callable has the same signature:
``predict(prompts: list[str], config: dict | None) -> list[str]`` returning the
raw decoded text (chat markers included) that ``clean_generation`` cleans."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import cut_lineage

Predictor = Callable[[list[str], "dict | None"], list[str]]


class EchoTagPredictor:
    """Deterministic stand-in: 'generates' the tags of the prompt's first
    numbered line in reverse order, wrapped like a chat model's output."""

    def __call__(self, prompts: list[str], config: dict | None = None) -> list[str]:
        out = []
        for p in prompts:
            first = p.split("\n", 1)[0]
            body = first.split(". ", 1)[-1]
            tags = [t.strip() for t in body.split(",") if t.strip()]
            if config and config.get("top_p", 1.0) < 0.5:
                tags = tags[:2]
            out.append("<s>[INST] " + p + " [/INST] " + ", ".join(reversed(tags)) + "</s>")
        return out


def batch_predict(prompts: DataFrame, factory: Callable[[], Predictor], input_col: str = "input",
                  config_cols: list[str] | None = None, out: str = "predict") -> DataFrame:
    """H3: one generation per row, in Arrow batches (one call of the model for
    each config in a batch), then G15 cleaning (JVM side)."""
    from pyspark.sql.types import StringType, StructField, StructType

    schema = StructType(list(prompts.schema.fields) + [StructField(out + "_raw", StringType())])
    cfg_cols = list(config_cols or [])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for pdf in batches:
            raw = pd.Series(index=pdf.index, dtype=object)
            if cfg_cols:
                for values, part in pdf.groupby(cfg_cols, dropna=False, sort=False):
                    raw[part.index] = model(list(part[input_col]), dict(zip(cfg_cols, values)))
            elif len(pdf):
                raw[:] = model(list(pdf[input_col]), None)
            yield pdf.assign(**{out + "_raw": raw})

    return prompts.mapInPandas(run, schema).withColumn(out, T.clean_generation(out + "_raw")).drop(out + "_raw")


def batch_predict_multi(prompts: DataFrame, configs: list[dict], factory: Callable[[], Predictor], key: str = "pid") -> DataFrame:
    """H4: every prompt under every config; predictions listed in config order."""
    from .sft import with_configs

    grid = with_configs(prompts, configs)
    cols = list(configs[0].keys())
    pred = batch_predict(grid, factory, config_cols=cols)
    return pred.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("config_id", "predict"))).alias("_p")).select(
        key, F.col("_p.predict").alias("predicts")
    )


def batch_predict_iterative(prompts: DataFrame, factory: Callable[[], Predictor], n: int, input_col: str = "input") -> DataFrame:
    """H5: n rounds; round i > 0 first appends "\\n{i+2}.", every round appends
    " " + prediction. Each round is checkpointed to the shared folder."""
    if n <= 1:
        raise ValueError("iterative generation needs n > 1")
    cur = prompts
    for i in range(n):
        if i > 0:
            cur = cur.withColumn(input_col, F.concat(F.col(input_col), F.lit(f"\n{i + 2}.")))
        cur = batch_predict(cur, factory, input_col)
        cur = cut_lineage(cur.withColumn(input_col, F.concat(F.col(input_col), F.lit(" "), F.col("predict"))).drop("predict"))
    return cur
