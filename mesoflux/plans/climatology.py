"""Published documents of a station: climatologies by subset with their fits, and the monitoring view of the last days."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import distributions, hourly, quality, stats
from ..sources import publish


def _numbers(values) -> Column:
    return F.array(*[F.lit(float(v)) if np.isfinite(v) else F.lit(None).cast("double") for v in values])


def climatology_documents(df: DataFrame, value: str, edges: Sequence[float], subsets: Mapping[str, Column], family: str | None = None, atom: Column | None = None, points: int = 121, **options) -> DataFrame:
    """(subset, value): a JSON document for each subset: edges, counts, density, atom, statistics, fit, its quality and curve, and the
    display range. ``subsets``: name -> condition, a handful. ``atom``: where a value is a point mass, which the rest leaves out.

    The data are counted by Spark; a fit's parameters and its curve of ``points`` places are all that comes to the driver.
    """
    docs = None
    for name, condition in subsets.items():
        rows = df.where(condition & F.col(value).isNotNull() & ~F.isnan(value))
        mass = F.coalesce(atom, F.lit(False)) if atom is not None else F.lit(False)
        body = rows.where(~mass)
        atoms = rows.agg(F.count_if(mass).alias("n"), F.try_divide(F.count_if(mass), F.count("*")).alias("share"))
        bars = stats.histogram(body, value, edges)
        shape = stats.describe_shape(body, value)
        ordered = bars.agg(F.array_sort(F.collect_list(F.struct("bin", "n", "density"))).alias("bars"))  # a row an edge
        parts = [ordered, atoms.select(F.struct("n", "share").alias("atom")), shape.select(F.struct(*shape.columns).alias("stats")), stats.display_range(bars.select("low", "high", "n")).select(F.struct("first_low", "last_high").alias("display"))]
        fitted, curve = F.lit(None).cast("string"), F.array().cast("array<double>")
        if family is not None:
            fit = distributions.fit_distribution(body, value, family, **options)
            scalars = {k: v for k, v in fit.params.items() if np.isscalar(v)}
            if all(np.isfinite(v) for v in scalars.values()):
                curve = _numbers(distributions.pdf(fit, np.linspace(edges[0], edges[-1], points)))
                quality_of = distributions.goodness_of_fit(body, value, fit).select("n", "ks", "quantile_gap")
                parts.append(quality_of.select(F.struct(*quality_of.columns).alias("quality")))
            fitted = F.to_json(F.struct(F.lit(family).alias("family"), *[F.lit(float(v)).alias(k) for k, v in scalars.items()]))
        one = parts[0]
        for p in parts[1:]:
            one = one.crossJoin(p)  # a row each
        one = one if "quality" in one.columns else one.withColumn("quality", F.lit(None).cast("struct<n:bigint,ks:double,quantile_gap:double>"))
        doc = F.struct(
            _numbers(edges).alias("edges"), F.transform("bars", lambda b: b["n"]).alias("counts"), F.transform("bars", lambda b: b["density"]).alias("density"), "atom", "stats", fitted.alias("fit"), "quality",
            curve.alias("curve"), "display",
        )
        row = one.select(F.lit(name).alias("subset"), F.to_json(doc, {"ignoreNullFields": "false"}).alias("value"))
        docs = row if docs is None else docs.unionByName(row)
    return docs


def climatology_manifest(df: DataFrame, variables: Sequence[str], sources: Mapping[str, str], ts: str = "ts") -> DataFrame:
    """One JSON text: the period, the hours of each variable by year and season, and where the data come from."""
    panel = hourly.coverage_panel(df, variables, ts).agg(F.sort_array(F.collect_list(F.struct("variable", "kind", "label", "hours"))).alias("coverage"))  # years and seasons alone
    span = df.agg(F.date_format(F.min(ts), "yyyy-MM-dd HH:mm").alias("start"), F.date_format(F.max(ts), "yyyy-MM-dd HH:mm").alias("end"))
    named = F.struct(*[F.lit(v).alias(k) for k, v in sources.items()]).alias("sources")
    return span.crossJoin(panel).select(F.to_json(F.struct(F.struct("start", "end").alias("period"), "coverage", named)).alias("value"))


def monitoring_view(layers: Mapping[str, tuple[DataFrame, str]], values: Mapping[str, str], days: int, keys: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    """(keys, value): one JSON document with a payload for each layer (raw, hourly, model: frame and cadence), all cut to the last
    ``days`` before the end of the first layer."""
    first = next(iter(layers.values()))[0]
    end = first.agg(F.max(ts)).first()[0]
    out, names = None, list(layers)
    for name, (frame, freq) in layers.items():
        recent = quality.clip_last_days(frame.where(F.col(ts) <= F.lit(end)), days, ts, F.lit(end))
        present = {v: u for v, u in values.items() if v in frame.columns}
        payload = publish.monitoring_payload(recent, present, freq, keys, ts).withColumnRenamed("value", name)
        out = payload if out is None else (out.join(payload, list(keys), "full_outer") if keys else out.crossJoin(payload))
    body = F.concat_ws(",", *[F.concat(F.lit(f'"{n}":'), F.coalesce(F.col(n), F.lit("null"))) for n in names])
    return out.select(*keys, F.concat(F.lit("{"), body, F.lit("}")).alias("value"))
