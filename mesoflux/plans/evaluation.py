"""The report of a model's predictions: global metrics, strata, confusion and the predictions themselves, written as tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.solar import Site
from ..operators import dataset, metrics

GLOBAL = ("n", "rmse", "mae", "mbe", "nmae", "nrmse")


def write_evaluation_report(df: DataFrame, targets: Sequence[str], folder: str, site: Site, keys: Sequence[str] = (), ts: str = "ts", split: str | None = None, facts: Mapping[str, str] | None = None, predictions: bool = True) -> dict[str, str]:
    """Paths, by name, of what is written below ``folder``, which must not hold a report yet.

    ``df``: obs_<target> and pred_<target> of each target, ``day_id``, the stamp, and obs_sky and pred_sky where classes were predicted.

    * ``metrics``: one JSON text: split, rows, facts, and for each target its scores and its skill against persistence and a clear sky.
    * ``stratified``: CSV (target, kind, stratum, scores), the stratum of all rows first.
    * ``confusion``: CSV, a row a true class, a column a predicted one; only with classes.
    * ``predictions``: the evaluated rows, Parquet, by day.

    A target without a pair of values has n = 0 and null scores. The rows of ``split`` are written first and then read for every table.
    """
    spark = df.sparkSession
    paths = {"predictions": f"{folder}/predictions.parquet"}
    chosen = df if split is None else df.where(F.col("split") == split)
    chosen.write.partitionBy("day_id").parquet(paths["predictions"])
    rows = spark.read.schema(df.schema).parquet(paths["predictions"])
    found, strata, classes = [], None, None
    for t in targets:
        out = dataset.evaluate_predictions(rows, t, site, keys, ts, None, t if t in ("dhi", "kt", "kstar") else "dhi")
        whole = metrics.score(rows, f"obs_{t}", f"pred_{t}", (), GLOBAL, min_pairs=1).select(F.struct(*GLOBAL).alias("scores"))
        skills = [out[k].agg(F.first(F.struct("n", "rmse_reference", "skill")).alias(k)) for k in ("persistence", "clear_sky")]
        found.append(whole.crossJoin(skills[0]).crossJoin(skills[1]).select(F.lit(t).alias("target"), F.struct("scores", "persistence", "clear_sky").alias("m")))  # a row each
        part = out["strata"].select(F.lit(t).alias("target"), "*")
        strata = part if strata is None else strata.unionByName(part)
        classes = out if "confusion" in out else classes
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    doc = every.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("target", "m")))).alias("global")).crossJoin(rows.agg(F.count("*").alias("n_samples")))
    told = [F.lit(v).alias(k) for k, v in (facts or {}).items()]
    if classes is not None:
        doc = doc.crossJoin(classes["classes"].agg(F.first(F.struct("n", "accuracy", "balanced_accuracy", "macro_f1")).alias("classes")))
        grid = classes["confusion"].groupBy("truth").pivot("pred", list(range(4))).agg(F.first("n"))
        paths["confusion"] = f"{folder}/confusion.csv"
        grid.select(F.concat(F.lit("true_"), "truth").alias("true"), *[F.col(f"`{k}`").alias(f"pred_{k}") for k in range(4)]).orderBy("true").coalesce(1).write.option("header", True).csv(paths["confusion"])
    parts = [F.lit(split).alias("split"), "n_samples", *told, "global", *(["classes"] if classes is not None else [])]
    paths["metrics"] = f"{folder}/metrics.json"
    doc.select(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}).alias("value")).coalesce(1).write.text(paths["metrics"])
    paths["stratified"] = f"{folder}/stratified.csv"
    first = F.col("kind") != "overall"
    strata.orderBy("target", first, "kind", "stratum").coalesce(1).write.option("header", True).csv(paths["stratified"])
    if not predictions:
        del paths["predictions"]
    return paths
