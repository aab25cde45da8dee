"""Registered queries, continued: joins, grids, sequences, statistics, fits, streams and station networks."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import atmosphere, solar
from ..operators import dataset, distributions, grid, hourly, joins, metrics, networks, stats, windows
from ..sources import publish
from ..sources.scratch import scratch_path
from ..streaming import sensors
from .catalogue import SITE, r6, register, table
from .library import _GRID, feed, grid_rows, stream_to_table, sun_sql

# -- joins and sets -------------------------------------------------------------------------------------------------------------


@register("""WITH c AS (SELECT user_id, ts, value FROM events WHERE event_type = 'click'), v AS (SELECT user_id, ts, value FROM events WHERE event_type = 'view'),
    j AS (SELECT c.user_id, c.ts, c.value AS value_frame, v.value AS value, abs(epoch_us(v.ts) - epoch_us(c.ts)) AS gap, row_number() OVER (PARTITION BY c.user_id, c.ts ORDER BY abs(epoch_us(v.ts) - epoch_us(c.ts)), v.ts) AS k
          FROM c JOIN v ON c.user_id = v.user_id AND abs(epoch_us(v.ts) - epoch_us(c.ts)) <= 21600000000) SELECT user_id, ts, value_frame, value, round(gap / 6e7, 6) AS distance_minutes FROM j WHERE k = 1""")
def frames_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    pick = lambda kind: e.where(F.col("event_type") == kind).select("user_id", "ts", "value")
    return joins.pair_frames(pick("click"), pick("view"), ["user_id"], max_distance="6 hours").withColumn("distance_minutes", r6("distance_minutes"))


_DAILY = "SELECT user_id AS station, date_trunc('day', ts) AS ts, max(value) FILTER (event_type = '{a}') AS v, count(*) FILTER (event_type = '{a}') AS {n} FROM events GROUP BY ALL HAVING count(*) FILTER (event_type = '{a}') > 0"


def daily_of(spark: SparkSession, sf_dir: str, kind: str, n: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where(F.col("event_type") == kind)
    return e.groupBy(F.col("user_id").alias("station"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts")).agg(F.max("value").alias("v"), F.count("*").alias(n))


@register(f"""SELECT a.station, a.ts, a.v AS v_a, a.clicks, b.v AS v_b, b.views FROM ({_DAILY.format(a='click', n='clicks')}) a JOIN ({_DAILY.format(a='view', n='views')}) b ON a.station = b.station AND a.ts = b.ts""")
def joined_on_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.join_on_index(daily_of(spark, sf_dir, "click", "clicks"), daily_of(spark, sf_dir, "view", "views"), ["station", "ts"])


@register(f"""SELECT coalesce(a.station, b.station) AS station, coalesce(a.ts, b.ts) AS ts, a.v, a.clicks, b.views FROM ({_DAILY.format(a='click', n='clicks')}) a FULL JOIN ({_DAILY.format(a='view', n='views')}) b ON a.station = b.station AND a.ts = b.ts""")
def outer_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.outer_combine(daily_of(spark, sf_dir, "click", "clicks"), daily_of(spark, sf_dir, "view", "views"), ["station", "ts"])


@register(f"""WITH a AS ({_DAILY.format(a='click', n='clicks')}), b AS ({_DAILY.format(a='view', n='views')}), c AS ({_DAILY.format(a='error', n='errors')}),
    m AS (SELECT coalesce(a.station, b.station) AS station, coalesce(a.ts, b.ts) AS ts, coalesce(a.v, b.v) AS v, clicks, views FROM a FULL JOIN b ON a.station = b.station AND a.ts = b.ts AND a.v = b.v)
    SELECT coalesce(m.station, c.station) AS station, coalesce(m.ts, c.ts) AS ts, coalesce(m.v, c.v) AS v, clicks, views, errors FROM m FULL JOIN c ON m.station = c.station AND m.ts = c.ts AND m.v = c.v""")
def ordered_outer_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = [daily_of(spark, sf_dir, k, n) for k, n in (("click", "clicks"), ("view", "views"), ("error", "errors"))]
    return joins.ordered_outer_merge(tables, ["station", "ts"])


@register(f"""WITH g AS ({_GRID}), p AS (SELECT s_name AS name, 'D0' || (1 + s_suppkey % 2) AS domain, s_suppkey % 10 AS y, (s_suppkey * 3) % 10 AS x FROM supplier) SELECT name, valid_time, v, u FROM g JOIN p USING (domain, y, x)""")
def point_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    located = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.concat(F.lit("D0"), (1 + k % 2).cast("string")).alias("domain"), (k % 10).alias("y"), (k * 3 % 10).alias("x"))
    return joins.point_series(grid_rows(spark, sf_dir), located, ["v", "u"])


@register("""SELECT doc_id, coalesce(quality, -1) AS quality, coalesce(flags, 0) AS flags FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN coalesce(quality, 0) ELSE quality END AS quality, n_chars % 4 AS own, toxic,
    (n_chars % 4) | coalesce(toxic, 0)::BIGINT * 256 AS flags FROM documents LEFT JOIN labels USING (doc_id))""")
def labels_and_flags_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, 0).alias("quality"), (F.col("n_chars") % 4).alias("qc_flags"))
    out = joins.or_flags(joins.map_label(docs, labels, "doc_id", "quality"), labels.select("doc_id", (F.col("toxic") * 256).cast("long").alias("qc_flags")), "doc_id")
    return out.select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.col("qc_flags").alias("flags"))


@register("""WITH d AS (SELECT DISTINCT strftime(ts, '%Y%m%d') AS day_key FROM events), w(kind, params, destination) AS (VALUES ('mask', 'a=1', 'x'), ('video', 'a=2', NULL)),
    l AS (SELECT day_key, kind, CASE WHEN day_key::INT % 3 = 0 THEN 'a=0' ELSE params END AS params, destination FROM d CROSS JOIN w WHERE day_key::INT % 2 = 0)
    SELECT d.day_key, w.kind FROM d CROSS JOIN w WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.day_key = d.day_key AND l.kind = w.kind AND l.params = w.params AND l.destination IS NOT DISTINCT FROM w.destination)""")
def work_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events").select(F.date_format("ts", "yyyyMMdd").alias("day_key")).distinct()
    wanted = spark.createDataFrame([("mask", "a=1", "x"), ("video", "a=2", None)], "kind string, params string, destination string")
    key = F.col("day_key").cast("int")
    ledger = days.crossJoin(wanted).where(key % 2 == 0).withColumn("params", F.when(key % 3 == 0, "a=0").otherwise(F.col("params")))
    return joins.pending_work(days, ledger, wanted)


@register("""SELECT DISTINCT (ts::DATE - 10) AS day FROM events WHERE ts::DATE - 10 >= (SELECT min(ts)::DATE FROM events)""")
def days_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return joins.temporal_coverage(e.select(F.date_sub(F.to_date("ts"), 10).alias("day")).distinct(), e)


@register(f"""WITH t AS (SELECT DISTINCT date_trunc('day', o_orderdate) - INTERVAL 28 YEAR AS ts FROM orders UNION SELECT DISTINCT date_trunc('day', ts) FROM events), v AS ({_DAILY.format(a='view', n='views')}), d AS (SELECT ts, sum(views)::BIGINT AS views FROM v GROUP BY ALL) SELECT ts, views FROM t LEFT JOIN d USING (ts)""")
def sensors_reindexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = lambda c: F.date_trunc("day", c).cast("timestamp_ntz").alias("ts")
    times = table(spark, sf_dir, "orders").select(day(F.col("o_orderdate") - F.expr("INTERVAL 28 YEARS"))).union(table(spark, sf_dir, "events").select(day(F.col("ts")))).distinct()
    return joins.reindex_to(times, daily_of(spark, sf_dir, "view", "views").groupBy("ts").agg(F.sum("views").alias("views")))


@register(f"""WITH g AS ({_GRID}) SELECT step FROM (SELECT step FROM g WHERE domain = 'D01' EXCEPT SELECT step FROM g WHERE domain = 'D02' AND step % 3 = 0)""")
def steps_not_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid_rows(spark, sf_dir)
    return joins.missing_steps(g.where("domain = 'D01'"), g.where("domain = 'D02' AND step % 3 = 0"), ["step"])


@register("""SELECT doc_id FROM labels WHERE quality = 1 INTERSECT SELECT doc_id FROM documents WHERE n_chars > 1000""")
def ids_on_both_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.disjoint_check(table(spark, sf_dir, "labels").where("quality = 1"), table(spark, sf_dir, "documents").where("n_chars > 1000"), "doc_id")


@register("""SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_quantity > 45 GROUP BY ALL ORDER BY n DESC, l_suppkey LIMIT 5""")
def top_offenders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.top_counts(table(spark, sf_dir, "lineitem").where("l_quantity > 45"), ["l_suppkey"], 5)


@register("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN value * 2 WHEN event_id % 2 = 0 THEN value + 1 ELSE value END AS value FROM events""")
def parts_consolidated(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "value")
    return dataset.consolidate_parts([e, e.where("event_id % 2 = 0").withColumn("value", F.col("value") + 1), e.where("event_id % 3 = 0").withColumn("value", F.col("value") * 2)], "event_id")


# -- statistics and preparation ---------------------------------------------------------------------------------------------------


@register("""SELECT event_id, round((value - (SELECT avg(value) FROM events)) / (SELECT stddev_pop(value) FROM events), 6) AS value FROM events""")
def normalised_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "value")
    return windows.transform(e, windows.fit_normalizer(e, ["value"])).select("event_id", r6("value").alias("value"))


@register("""WITH c AS (SELECT (l_linenumber % 4)::BIGINT AS class, count(*) AS n FROM lineitem GROUP BY ALL) SELECT class, round(ln(n / sum(n) OVER ()), 8) AS log_share, (SELECT round(avg(l_quantity), 6) FROM lineitem) AS mean FROM c""")
def climatology_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("k", (F.col("l_linenumber") % 4).cast("long"))
    means = windows.target_means(li, ["l_quantity"]).select(r6("l_quantity").alias("mean"))
    return windows.target_means(li, [], "k").select("class", F.round("log_share", 8).alias("log_share")).crossJoin(means)


@register("""WITH k AS (SELECT doc_id::VARCHAR AS k, sha256('{"doc_id":' || doc_id || coalesce(',"quality":' || quality, '') || coalesce(',"toxic":' || toxic, '') || '}') AS h FROM labels), p AS (SELECT ('0x' || substr(md5(k), 1, 3))::INT AS part, k, h FROM k),
    r AS (SELECT part, count(*) AS n, sha256(string_agg(h, '' ORDER BY k, h)) AS h FROM p GROUP BY part) SELECT sum(n)::BIGINT AS n, sha256(string_agg(h, '' ORDER BY part, h)) AS hash FROM r""")
def labels_content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.content_hash(table(spark, sf_dir, "labels"), ["doc_id"])


@register("""WITH b AS (SELECT floor(l_extendedprice / 1000)::BIGINT AS b, count(*) AS n FROM lineitem GROUP BY ALL), c AS (SELECT b, n, sum(n) OVER (ORDER BY b) AS up, sum(n) OVER (ORDER BY b DESC) AS down, sum(n) OVER () AS t FROM b)
    SELECT min(b * 1000.0)::DOUBLE AS first_low, max(b * 1000.0 + 1000)::DOUBLE AS last_high FROM c WHERE up > 0.001 * t AND down > 0.001 * t""")
def display_range_of_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = table(spark, sf_dir, "lineitem").groupBy(F.floor(F.col("l_extendedprice") / 1000).alias("b")).agg(F.count("*").alias("n"))
    return stats.display_range(bins.select((F.col("b") * 1000.0).alias("low"), (F.col("b") * 1000.0 + 1000).alias("high"), "n"))


@register(f"""WITH g AS (SELECT domain, step, v / 20 AS v FROM ({_GRID})), s AS (SELECT step, min(v) AS lo, max(v) AS hi FROM g GROUP BY ALL), i AS (SELECT CASE WHEN quantile_cont(hi - lo, 0.5) >= 16 THEN 4.0 WHEN quantile_cont(hi - lo, 0.5) >= 8 THEN 2.0 ELSE 1.0 END AS i FROM s)
    SELECT step, i::DOUBLE AS interval, array_to_string(list_filter(range((ceil(lo / i) * i)::BIGINT, floor(hi)::BIGINT + 1, i::BIGINT), lambda x: x > lo AND x < hi), ',') AS levels FROM s, i""")
def contour_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.choose_interval(grid_rows(spark, sf_dir).withColumn("v", F.col("v") / 20), "v")
    return out.withColumn("levels", F.array_join(F.transform("levels", lambda x: x.cast("string")), ","))


@register(f"""WITH g AS ({_GRID}) SELECT domain, step, y, x, round(v - lag(v) OVER (PARTITION BY domain, y, x ORDER BY step), 6) AS v FROM g""")
def rain_increments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.rain_increment(grid_rows(spark, sf_dir), "v").select("domain", "step", "y", "x", r6("v").alias("v"))


@register("""SELECT event_id, lag(value) OVER (PARTITION BY user_id, ts::DATE ORDER BY ts) AS persistence_value FROM events""")
def persistence_within_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("day_id", F.to_date("ts"))
    return windows.persistence_reference(e, "value", keys=["user_id"]).select("event_id", "persistence_value")


@register("""WITH e AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, CASE WHEN event_id % 5 <> 2 THEN ts END AS ts FROM events),
    n AS (SELECT *, max(CASE WHEN ts IS NOT NULL THEN i END) OVER b AS bi, max(ts) OVER b AS bt, min(CASE WHEN ts IS NOT NULL THEN i END) OVER a AS ai, min(ts) OVER a AS nt
          FROM e WINDOW b AS (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT event_id, date_trunc('minute', coalesce(ts, make_timestamp((epoch_us(bt) + (epoch_us(nt) - epoch_us(bt)) * ((i - bi) / (ai - bi)::DOUBLE))::BIGINT))) AS ts FROM n""")
def stamps_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.when(F.col("event_id") % 5 != 2, F.col("ts")).alias("ts"))
    return windows.repair_stamps(e, "event_id", keys=["user_id"]).select("event_id", F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("ts"))


@register("""WITH d AS (SELECT user_id AS station, date_trunc('hour', ts) AS ts, max(value) AS v FROM events GROUP BY ALL), b AS (SELECT station, min(ts) AS lo, max(ts) AS hi FROM d GROUP BY ALL), s AS (SELECT station, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM b)
    SELECT s.station, s.ts, v FROM s LEFT JOIN d USING (station, ts)""")
def regular_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("station"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")).agg(F.max("value").alias("v"))
    return hourly.regular_grid(d, "1 hour", ["station"])


@register("""SELECT event_id, coalesce(CASE WHEN event_id % 4 <> 0 THEN value END, 12.5) AS f, value AS t FROM events WHERE event_id % 7 <> 0""")
def features_imputed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 4 != 0, F.col("value")).alias("f"), F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("t"))
    return windows.impute(e, ["f"], "t", means={"f": 12.5})


@register("""SELECT event_id, round(value::FLOAT::DOUBLE, 4) AS a, hour(ts)::DOUBLE AS b, round((value * 2)::FLOAT::DOUBLE, 4) AS label FROM events WHERE event_id % 5 <> 0""")
def tabular_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("v"), F.hour("ts").alias("h"), (F.col("value") * 2).alias("y"), "event_id")
    out = windows.tabular_dataset(e, ["v", "h", "event_id"], "y")
    return out.select(F.col("features")[2].cast("long").alias("event_id"), F.round(F.col("features")[0].cast("double"), 4).alias("a"), F.col("features")[1].cast("double").alias("b"), F.round(F.col("label").cast("double"), 4).alias("label"))


@register("""SELECT event_id, hour(ts)::BIGINT AS hour, lag(value) OVER w AS value_lag_1, lag(x) OVER w AS x_lag_1, round(avg(x) OVER (PARTITION BY user_id ORDER BY ts ROWS 2 PRECEDING), 6) AS x_roll_3_mean, x - lag(x) OVER w AS x_diff_1 FROM (SELECT *, event_id % 17 AS x FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts)""")
def feature_pipeline_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("x", F.col("event_id") % 17)
    out, _ = windows.feature_pipeline(e, ["value", "x"], "value", keys=["user_id"])
    return out.select("event_id", F.col("hour").cast("long").alias("hour"), "value_lag_1", "x_lag_1", r6("x_roll_3_mean").alias("x_roll_3_mean"), "x_diff_1")


@register("""WITH d AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events) SELECT 'short' AS model, event_id FROM d WHERE i >= 6 UNION ALL SELECT 'long', event_id FROM d WHERE i >= 6""")
def comparable_rows_of_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    rows = windows.comparable_rows(e, {"short": 2, "long": 6}, "common_sequence_horizon", ["user_id"], max_gap_seconds=10.0**9)
    return rows["short"].select(F.lit("short").alias("model"), "event_id").unionByName(rows["long"].select(F.lit("long").alias("model"), "event_id"))


@register("""SELECT event_id, 'sky-' || strftime(ts, '%Y%m%d-%H%M') AS sample_id, strftime(ts, '%Y%m%d') AS day_id, 'a/' || event_type || '.png' AS path, round_even(value, 1) AS rounded FROM events""")
def sample_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("file:///data/sky/a/"), F.col("event_type"), F.lit(".png"))
    return table(spark, sf_dir, "events").select("event_id", dataset.sample_id(F.col("ts")).alias("sample_id"), dataset.day_id(F.col("ts")).alias("day_id"), dataset.relative_path(path, "/data/sky").alias("path"), publish.round_for_publication(F.col("value"), "m/s").alias("rounded"))


@register("""SELECT o_orderstatus, o_orderkey % 4 AS k, count(*) AS n, round(sqrt(avg((p - o) ** 2)), 3) AS rmse, round(avg(abs(p - o)), 3) AS mae, round(avg(p - o), 3) AS mbe, round(avg(abs((o - p) / o)) * 100, 6) AS mape
    FROM (SELECT o_orderstatus, o_orderkey, o_totalprice AS o, o_totalprice * (1 + (o_orderkey % 7 - 3) / 50.0) AS p FROM orders) GROUP BY ALL""")
def metrics_by_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    df = table(spark, sf_dir, "orders").select("o_orderstatus", (k % 4).alias("k"), F.col("o_totalprice").alias("o"), (F.col("o_totalprice") * (1 + (k % 7 - 3) / 50.0)).alias("p"))
    t = metrics.score(df, "o", "p", ["o_orderstatus", "k"], ["n", "rmse", "mae", "mbe", "mape"])
    return t.select("o_orderstatus", "k", "n", *[F.round(c, 3).alias(c) for c in ("rmse", "mae", "mbe")], r6("mape").alias("mape"))


# -- fits ---------------------------------------------------------------------------------------------------------------------------

#: ln x less digamma(x), and trigamma(x), by the series about x + 12.
_LN_PSI = "ln({x}) - (ln({x} + 12) - 0.5 / ({x} + 12) - 1 / (12 * ({x} + 12) ** 2) + 1 / (120 * ({x} + 12) ** 4) - 1 / (252 * ({x} + 12) ** 6)) + list_sum(list_transform(range(0, 12), lambda i: 1 / ({x} + i)))"
_TRI = "1 / ({x} + 12) + 0.5 / ({x} + 12) ** 2 + 1 / (6 * ({x} + 12) ** 3) - 1 / (30 * ({x} + 12) ** 5) + 1 / (42 * ({x} + 12) ** 7) + list_sum(list_transform(range(0, 12), lambda i: 1 / ({x} + i) ** 2))"


def _one_row(spark: SparkSession, values: dict, digits: int) -> DataFrame:
    return spark.createDataFrame([tuple(round(float(v), digits) for v in values.values())], ", ".join(f"{k} double" for k in values))


@register(f"""WITH RECURSIVE m AS (SELECT ln(avg(value)) - avg(ln(value)) AS s, avg(value) AS mean FROM events WHERE value > 0),
    f AS (SELECT 0 AS i, (1 + sqrt(1 + 4 * s / 3)) / (4 * s) AS k FROM m UNION ALL SELECT i + 1, k - ({_LN_PSI.format(x='k')} - s) / (1 / k - ({_TRI.format(x='k')})) FROM f, m WHERE i < 25)
    SELECT round(k, 6) AS shape, round(mean / k, 4) AS scale FROM f, m WHERE i = 25""")
def gamma_fitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = distributions.fit_distribution(table(spark, sf_dir, "events"), "value", "gamma").params
    return _one_row(spark, {"shape": round(p["shape"], 6), "scale": round(p["scale"], 4)}, 6)


@register("""SELECT round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std FROM events""")
def normal_fitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = distributions.fit_distribution(table(spark, sf_dir, "events"), "value", "normal").params
    return _one_row(spark, {"mean": p["mean"], "std": p["std"]}, 6)


@register("""WITH RECURSIVE x AS (SELECT value AS v, ln(value) AS l FROM events WHERE value > 0), m AS (SELECT count(*) AS n, avg(l) AS ml, max(l) AS top, (stddev_samp(v) / avg(v)) ** -1.086 AS k0 FROM x), ls AS (SELECT list(l) AS ls FROM x),
    f AS (SELECT 0 AS i, k0 AS k FROM m UNION ALL SELECT i + 1, k - (1 / k + ml - b / a) / (-1 / (k * k) - (c / a - (b / a) ** 2)) FROM (SELECT i, k, ml, list_sum(list_transform(ls, lambda l: exp(k * (l - top)))) AS a,
          list_sum(list_transform(ls, lambda l: exp(k * (l - top)) * l)) AS b, list_sum(list_transform(ls, lambda l: exp(k * (l - top)) * l * l)) AS c FROM f, m, ls WHERE i < 12))
    SELECT round(k, 6) AS shape, round(exp(top + ln(list_sum(list_transform(ls, lambda l: exp(k * (l - top)))) / n) / k), 4) AS scale FROM f, m, ls WHERE i = 12""")
def weibull_fitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = distributions.fit_distribution(table(spark, sf_dir, "events"), "value", "weibull").params
    return _one_row(spark, {"shape": round(p["shape"], 6), "scale": round(p["scale"], 4)}, 6)


_PSI = "ln({x} + 12) - 0.5 / ({x} + 12) - 1 / (12 * ({x} + 12) ** 2) + 1 / (120 * ({x} + 12) ** 4) - 1 / (252 * ({x} + 12) ** 6) - list_sum(list_transform(range(0, 12), lambda i: 1 / ({x} + i)))"


@register(f"""WITH RECURSIVE x AS (SELECT (value / 500)::DOUBLE AS v FROM events WHERE value / 500 > 0 AND value / 500 < 1), m AS (SELECT avg(v) AS mu, var_pop(v) AS s2, avg(ln(v)) AS g1, avg(ln(1 - v)) AS g2 FROM x), z AS (SELECT mu * (mu * (1 - mu) / s2 - 1) AS a0, (1 - mu) * (mu * (1 - mu) / s2 - 1) AS b0, g1, g2 FROM m),
    f AS (SELECT 0 AS i, a0 AS a, b0 AS b FROM z UNION ALL SELECT i + 1, greatest(a - (h22 * f1 + t * f2) / (h11 * h22 - t * t), a / 2), greatest(b - (t * f1 + h11 * f2) / (h11 * h22 - t * t), b / 2)
          FROM (SELECT i, a, b, t, {_PSI.format(x='a')} - d - g1 AS f1, {_PSI.format(x='b')} - d - g2 AS f2, {_TRI.format(x='a')} - t AS h11, {_TRI.format(x='b')} - t AS h22
                FROM (SELECT i, a, b, g1, g2, {_PSI.format(x='(a + b)')} AS d, {_TRI.format(x='(a + b)')} AS t FROM f, z WHERE i < 40)))
    SELECT round(a, 5) AS a, round(b, 5) AS b FROM f WHERE i = 40""")
def beta_fitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select((F.col("value") / 500).alias("v"))
    p = distributions.fit_beta(e, "v")
    return _one_row(spark, {"a": p["a"], "b": p["b"]}, 5)


# -- grids and physics ----------------------------------------------------------------------------------------------------------------


@register("""SELECT event_id, round(u * c + v * s, 6) AS east, round(v * c - u * s, 6) AS north FROM (SELECT event_id, value AS u, value / 2 AS v, cos(event_id / 100.0) AS c, sin(event_id / 100.0) AS s FROM events)""")
def winds_rotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, a = F.col("value"), F.col("event_id") / 100.0
    east, north = atmosphere.rotate_to_earth(v, v / 2, F.cos(a), F.sin(a))
    return table(spark, sf_dir, "events").select("event_id", r6(east).alias("east"), r6(north).alias("north"))


@register("""WITH e AS (SELECT event_id, 280 + value / 20 AS t2, 95000 + value AS psfc, value / 40000 AS q2, value / 30 AS u10, value / 60 - 2 AS v10, value * 2 AS sw, CASE WHEN event_type = 'error' THEN 0.0 ELSE 300 + value / 10 END AS glw FROM events)
    SELECT event_id, round(t2 - 273.15, 6) AS "T", round(psfc / 100, 6) AS p, round(q2 * 1000, 6) AS q, round(q2 * psfc / (0.622 + q2) / 100, 6) AS e, round(sqrt(u10 * u10 + v10 * v10), 6) AS "WS", CASE WHEN glw <> 0 THEN sw END AS "Swdw", NULL::DOUBLE AS "H" FROM e""")
def operational_columns_of_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    e = table(spark, sf_dir, "events").select("event_id", (280 + v / 20).alias("T2"), (95000 + v).alias("PSFC"), (v / 40000).alias("Q2"), (v / 30).alias("U10"), (v / 60 - 2).alias("V10"), (v * 2).alias("SWDOWN"), F.when(F.col("event_type") == "error", 0.0).otherwise(300 + v / 10).alias("GLW"))
    out = grid.operational_columns(e, ["event_id"], ["T", "p", "q", "e", "WS", "Swdw", "H"])
    return out.select("event_id", *[r6(c).alias(c) for c in ("T", "p", "q", "e", "WS")], "Swdw", "H")


_LEVELS = "SELECT l_orderkey AS cell, l_linenumber * 30.0 + l_quantity / 10 AS h, l_extendedprice AS v FROM lineitem"


@register(f"""WITH l AS ({_LEVELS}), d AS (SELECT cell, h, min(v) AS v FROM l GROUP BY ALL), c AS (SELECT cell, list(struct_pack(h := h, v := v) ORDER BY h) AS c FROM d GROUP BY cell),
    k AS (SELECT cell, c, greatest(1, least(len(list_filter(c, lambda p: p.h <= 100)), len(c) - 1))::BIGINT AS k FROM c)
    SELECT cell, round(CASE WHEN len(c) = 1 THEN c[1].v ELSE c[k].v + (c[least(k + 1, len(c))].v - c[k].v) * ((100 - c[k].h) / (c[least(k + 1, len(c))].h - c[k].h)) END, 3) AS v FROM k""")
def values_at_height(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("cell"), (F.col("l_linenumber") * 30.0 + F.col("l_quantity") / 10).alias("h"), F.col("l_extendedprice").alias("v"))
    once = li.groupBy("cell", "h").agg(F.min("v").alias("v"))
    return grid.vertical_interpolate(once, "v", "h", 100.0, ["cell"]).select("cell", F.round("v", 3).alias("v"))


_SIGMA, _RADIUS = 1.5, 6
_RAW = [math.exp(-0.5 * (k / _SIGMA) ** 2) for k in range(-_RADIUS, _RADIUS + 1)]
_KERNEL = ", ".join(f"({k}, {w / sum(_RAW)!r}::DOUBLE)" for k, w in zip(range(-_RADIUS, _RADIUS + 1), _RAW))
_MIRROR = "CASE WHEN {p} < 0 THEN -{p} - 1 WHEN {p} > 9 THEN 19 - {p} ELSE {p} END"


@register(f"""WITH g AS (SELECT domain, y, x, max(v) AS v FROM ({_GRID}) GROUP BY ALL), w(k, w) AS (VALUES {_KERNEL}),
    a AS (SELECT p.domain, p.y, p.x, sum(q.v * w) AS v FROM g p CROSS JOIN w JOIN g q ON q.domain = p.domain AND q.x = p.x AND q.y = {_MIRROR.format(p='(p.y + k)')} GROUP BY ALL),
    b AS (SELECT p.domain, p.y, p.x, sum(q.v * w) AS v FROM a p CROSS JOIN w JOIN a q ON q.domain = p.domain AND q.y = p.y AND q.x = {_MIRROR.format(p='(p.x + k)')} GROUP BY ALL) SELECT domain, y, x, round(v, 5) AS v FROM b""")
def fields_smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid_rows(spark, sf_dir).groupBy("domain", "y", "x").agg(F.max("v").alias("v")).withColumn("step", F.lit(0))
    return grid.smooth(g, "v", _SIGMA).select("domain", "y", "x", F.round("v", 5).alias("v"))


@register(f"""SELECT DISTINCT domain, valid_time, valid_time - INTERVAL 3 HOUR AS local_time FROM ({_GRID})""")
def local_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid_rows(spark, sf_dir).withColumn("valid_time", F.col("valid_time") + F.expr("INTERVAL 90 SECONDS"))
    out = grid.local_hour_label(g.select("domain", "valid_time").distinct())
    return out.select("domain", (F.col("valid_time") - F.expr("INTERVAL 90 SECONDS")).alias("valid_time"), "local_time")


@register(f"""WITH e AS (SELECT event_id, date_trunc('second', ts) AS ts FROM events), {sun_sql('e', 0, 's')} SELECT event_id, round(CASE WHEN 1361.0 * e0 * mu > 0 THEN 1098.0 * mu * exp(-0.057 / mu) / (1361.0 * e0 * mu) END, 6) AS clear FROM s""")
def clear_sky_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("ts", F.date_trunc("second", "ts").cast("timestamp_ntz"))
    return e.select("event_id", r6(solar.clear_sky_reference(F.col("ts"), SITE, "kt")).alias("clear"))


# -- streams --------------------------------------------------------------------------------------------------------------------------


@register("""SELECT user_id AS station, ts, event_type, CASE WHEN value BETWEEN 5 AND 120 THEN value END AS value FROM events""")
def stream_gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_to_table(spark, sensors.stream_gate(feed(spark, sf_dir), [("value", 5, 120)]), "gated")


@register("""WITH h AS (SELECT user_id AS station, date_trunc('day', ts) AS ts, count(value) AS n, avg(value) AS v FROM events GROUP BY ALL) SELECT station, ts, round(CASE WHEN n >= 2 THEN v END, 6) AS value FROM h WHERE ts + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR""")
def stream_daily_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stream_to_table(spark, sensors.stream_hourly(feed(spark, sf_dir), ["value"], ["station"], freq="1 day", min_samples=2), "daily")
    return out.select("station", F.col("ts").cast("timestamp_ntz").alias("ts"), r6("value").alias("value"))


@register("""SELECT user_id AS station, ts, event_type, value FROM events""")
def stream_appended_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each batch is delivered twice; the table has every station's stamp once."""
    path = scratch_path(spark, "sink")
    write = sensors.append_sink(path, ["station", "ts"])
    query = feed(spark, sf_dir).writeStream.foreachBatch(lambda b, n: (write(b, n), write(b, n), None)[-1]).option("checkpointLocation", path + "-log").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(path)


@register("""WITH w AS (SELECT event_type, date_trunc('day', ts) + i * INTERVAL 12 HOUR AS start, ts, value FROM events, (SELECT unnest([-1, 0, 1]) AS i)), s AS (SELECT event_type, start + INTERVAL 1 DAY AS ts, avg(value) AS m, min(value) AS lo, max(value) AS hi FROM w WHERE ts >= start AND ts < start + INTERVAL 1 DAY GROUP BY ALL)
    SELECT event_type, ts, round(m, 6) AS value_mean, lo AS value_min, hi AS value_max FROM s WHERE ts <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR""")
def stream_monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stream_to_table(spark, sensors.rolling_monitor(feed(spark, sf_dir), ["value"], ["event_type"], span="1 day", every="12 hours"), "monitor")
    return out.select("event_type", F.col("ts").cast("timestamp_ntz").alias("ts"), r6("value_mean").alias("value_mean"), "value_min", "value_max")


@register("""SELECT user_id AS station, ts, event_type, value FROM events""")
def stream_deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    twice = feed(spark, sf_dir).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    out = stream_to_table(spark, sensors.stream_dedup(twice, ["station"]), "dedup")
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


# -- station networks -------------------------------------------------------------------------------------------------------------------


@register("""SELECT event_id, ts - INTERVAL 3 HOUR AS ts, round((value - 32) * 5 / 9, 6) AS "T", round(value * 0.514444, 6) AS "WS", round(-value * 0.514444 * sin(radians(value * 7.3 % 360)), 6) AS u, round(-value * 0.514444 * cos(radians(value * 7.3 % 360)), 6) AS v, round(value * 25.4, 6) AS precip FROM events""")
def metar_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    raw = table(spark, sf_dir, "events").select(F.col("ts").alias("valid"), v.alias("tmpf"), v.alias("dwpf"), F.col("event_id").alias("relh"), (v * 7.3 % 360).alias("drct"), v.alias("sknt"), v.alias("p01i"), v.alias("mslp"))
    out = networks.normalise_metar(raw)
    return out.select(F.col("ur").alias("event_id"), "ts", *[r6(c).alias(c) for c in ("T", "WS", "u", "v", "precip")])


@register("""SELECT event_id, date_trunc('hour', ts) - INTERVAL 3 HOUR AS ts, round(CASE WHEN event_type = 'error' THEN value ELSE (value + value / 2) / 2 END, 6) AS "T", round(value * (16.6667 / 60), 4) AS "Sw_dw" FROM events""")
def hourly_network_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    raw = table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy/MM/dd").alias("date"), F.concat(F.date_format("ts", "HH"), F.lit("00 UTC")).alias("hour"), v.alias("tmax"), F.when(F.col("event_type") != "error", v / 2).alias("tmin"), v.alias("kj"))
    out = networks.normalise_hourly_network(raw, {"T": ("tmax", "tmin")}, {"Sw_dw": "kj"}, {"event_id": "event_id"})
    return out.select("event_id", "ts", r6("T").alias("T"), F.round("Sw_dw", 4).alias("Sw_dw"))


_PAIRED = "SELECT user_id % 5 AS station, ts, value - 20 AS T_obs, value * 1.1 - 25 AS T_model FROM events"


def paired_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return table(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("station"), "ts", (v - 20).alias("T_obs"), (v * 1.1 - 25).alias("T_model"))


@register(f"""WITH p AS (SELECT station, hour(ts) AS hour, CASE WHEN T_obs > 0 THEN T_obs END AS o, CASE WHEN T_model > 0 THEN T_model END AS m FROM ({_PAIRED}) WHERE month(ts) IN (1, 2))
    SELECT station, 'T' AS variable, hour::BIGINT AS hour, count(*) FILTER (o IS NOT NULL AND m IS NOT NULL) AS n, round(sqrt(avg((m - o) ** 2)), 6) AS rmse, round(avg(abs(m - o)), 6) AS mae, round(avg(m - o), 6) AS mbe FROM p GROUP BY GROUPING SETS ((station), (station, hour))""")
def scores_by_hour_of_station(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = networks.scores_by_hour(paired_rows(spark, sf_dir), ["T"], [1, 2])
    return t.select("station", "variable", F.col("hour").cast("long").alias("hour"), "n", *[r6(c).alias(c) for c in ("rmse", "mae", "mbe")])


@register(f"""SELECT station, month(ts)::BIGINT AS month, 'T' AS variable, round(avg(T_obs), 6) AS obs, round(avg(T_model), 6) AS model FROM ({_PAIRED}) GROUP BY ALL""")
def monthly_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = networks.monthly_mean_pairs(paired_rows(spark, sf_dir), ["T"])
    return t.select("station", F.col("month").cast("long").alias("month"), "variable", r6("obs").alias("obs"), r6("model").alias("model"))


@register("""SELECT event_type, hour(ts)::BIGINT AS hour, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value) / sqrt(count(value)), 6) AS error FROM events GROUP BY ALL""")
def hourly_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = networks.hourly_mean_error(table(spark, sf_dir, "events"), "value", ["event_type"])
    return t.select("event_type", F.col("hour").cast("long").alias("hour"), "n", r6("mean").alias("mean"), r6("error").alias("error"))


@register("""SELECT o_orderstatus, year(o_orderdate)::BIGINT AS year, month(o_orderdate)::BIGINT AS month, round(avg(v) FILTER (v > 0), 4) AS v FROM (SELECT *, o_totalprice - 100000 AS v FROM orders) GROUP BY ALL""")
def monthly_positive_fluxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").withColumn("v", F.col("o_totalprice") - 100000)
    t = networks.monthly_positive_means(df, ["v"], ["o_orderstatus"], "o_orderdate")
    return t.select("o_orderstatus", F.col("year").cast("long").alias("year"), F.col("month").cast("long").alias("month"), F.round("v", 4).alias("v"))


@register("""WITH c AS (SELECT date_trunc('hour', ts - INTERVAL 30 MINUTE) + INTERVAL 1 HOUR AS ts, avg(value) AS v, count(value) AS n FROM events GROUP BY ALL) SELECT ts, round(CASE WHEN n >= 2 THEN v END, 6) AS value FROM c""")
def centred_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hourly.centred_hourly_mean(table(spark, sf_dir, "events"), ["value"], min_samples=2)
    return out.select("ts", r6("value").alias("value"))


@register("""WITH r AS (SELECT event_id, user_id, ts, avg(value) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS m FROM events) SELECT event_id, round(lead(m) OVER (PARTITION BY user_id ORDER BY ts), 6) AS value_smooth FROM r""")
def centre_shifted_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.centre_shift_rolling(table(spark, sf_dir, "events"), "value", ["user_id"], hours=24)
    return out.select("event_id", r6("value_smooth").alias("value_smooth"))
