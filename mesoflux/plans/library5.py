"""Registered queries, continued: old records, sky documents, winds and pressures, stuck streams, evaluation reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import solar
from ..operators import grid
from ..sources import old_record
from ..sources.scratch import scratch_path
from ..streaming import sensors
from . import evaluation, sky
from .catalogue import SITE, r6, register, table
from .library import stream_to_table, sun_sql


def old_lines(spark: SparkSession, sf_dir: str) -> str:
    """events as old point records, a row an event with its id for a sea temperature; sign-ups as 47 fields; errors before the radiation's
    first call; views without an emissivity. Returns the folder, whose files have a header each."""
    e, v = table(spark, sf_dir, "events"), F.col("value")
    text = lambda c: F.format_string("%.4f", c)
    kind = F.col("event_type")
    t = 20 + v / 50
    eps = F.when(kind == "view", 0.88).otherwise(0.95)
    flux = text((0.2 - 273.15) * v), text((eps - 273.15) * 5.670374419e-08 * F.pow(t, F.lit(4.0)))
    wide = kind == "signup"
    blank = F.lit("")
    cells: dict[str, Column] = {"year": F.year("ts"), "month": F.month("ts"), "day": F.dayofmonth("ts"), "hour": F.hour("ts"), "T": t, "pressure": text(950 + v / 50), "e": F.lit("1"), "ur": F.lit("1"), "es": F.lit("3000"), "q": text(10 + v / 100), "Swdw": v}
    cells |= {"Swup_calc": F.when(wide, blank).otherwise(flux[0]), "Lwup_calc": F.when(wide, blank).otherwise(flux[1]), "Lwdw_glw": F.when(kind == "error", "0.0").otherwise("400"), "ALBD": F.lit("-272.9500"), "EMISS": F.when(kind == "view", blank).otherwise("-272.2000"), "H": F.lit("12.5"), "TSM": F.col("event_id")}
    named = [cells.get(c, blank).cast("string") for c in old_record.OLD]
    tail = F.when(wide, F.concat(F.lit("," * 11), flux[0], F.lit(","), flux[1])).otherwise("")
    folder = scratch_path(spark, "old-record")
    line = F.concat(F.concat_ws(",", *named), tail)
    # a file of each part of the scan, without an exchange or a sort; the first row of a part brings the header along
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    e.select(F.when(first, F.concat(F.lit(",".join(old_record.OLD) + "\n"), line)).otherwise(line).alias("value")).write.text(folder)
    return folder


_OLD = """WITH o AS (SELECT *, 20 + value / 50 AS t, CASE WHEN event_type = 'view' THEN 0.88::DOUBLE ELSE 0.95::DOUBLE END AS eps, event_type = 'error' AS cold, round(10 + value / 100, 4) / 1000 AS w, round(950 + value / 50, 4) AS p FROM events)"""


@register(f"""{_OLD} SELECT event_id, CASE WHEN cold THEN 'nan' ELSE '0.2000' END AS albedo, CASE WHEN cold THEN 'nan' WHEN event_type <> 'view' THEN '0.9500' END AS emissivity,
    CASE WHEN NOT cold THEN round(0.2 * value, 4) END AS swup, CASE WHEN NOT cold THEN round(eps * 5.670374419e-08 * (t + 273.15) ** 4, 4) END AS lwup, round(w * p / (0.622 + w), 4) AS e, round(100 * (w * p / (0.622 + w)) * 100 / 3000, 4) AS rh, CASE WHEN cold THEN 'nan' ELSE '12.5' END AS h, 'nan' AS precip FROM o""")
def old_records_of_both_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old rows of 35 and 47 fields written in the present layout and read back."""
    target = scratch_path(spark, "new-record")
    old_record.migrate_old_record(spark, old_lines(spark, sf_dir), target)
    new = spark.read.option("header", True).csv(target)
    at = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    return new.select(F.col("sst_c").cast("long").alias("event_id"), "albedo", "emissivity", at("swup_w_m2").alias("swup"), at("lwup_air_w_m2").alias("lwup"), at("e_hpa").alias("e"), at("rh_pct").alias("rh"), F.col("hfx_w_m2").alias("h"), F.col("precip_mm").alias("precip"))


_COLD = ("albedo", "glw_w_m2", "hfx_w_m2", "lwup_air_w_m2", "swdown_w_m2", "swup_w_m2", "emissivity")


@register(f"""WITH e AS (SELECT count(*) AS n, count(*) FILTER (event_type = 'signup') AS wide, count(*) FILTER (event_type = 'view') AS bare, count(*) FILTER (event_type = 'error') AS cold FROM events)
    SELECT * FROM (SELECT 'rows' AS what, '' AS "column", n FROM e UNION ALL SELECT 'recovered', '', 2 * wide FROM e UNION ALL SELECT 'repaired', 'emissivity', n - bare FROM e
    {' '.join(f"UNION ALL SELECT 'repaired', '{c}', n FROM e" for c in ('albedo', 'swup_w_m2', 'lwup_air_w_m2', 'e_hpa', 'rh_pct'))} {' '.join(f"UNION ALL SELECT 'blanked', '{c}', cold FROM e" for c in _COLD)}) WHERE n > 0""")
def old_record_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the migration recovered, repaired and blanked, by column, as counted while it wrote."""
    got = old_record.migrate_old_record(spark, old_lines(spark, sf_dir), scratch_path(spark, "new-record"))
    rows = [("rows", "", got.rows), ("recovered", "", got.recovered), *[("repaired", c, n) for c, n in got.repaired.items()], *[("blanked", c, n) for c, n in got.blanked.items()]]
    return spark.createDataFrame([r for r in rows if r[2]], "what string, column string, n long")


# -- sky documents ---------------------------------------------------------------------------------------------------------------

_EDGES = [round(0.1 * k, 1) for k in range(11)]
_EDGE_SQL = ", ".join(f"({k}, {a}::DOUBLE, {b}::DOUBLE)" for k, (a, b) in enumerate(zip(_EDGES, _EDGES[1:])))
_PAIRS = "p AS (SELECT event_id, ts, value / 300 AS kt, (event_id % 1000) / 900 AS kd, CASE WHEN event_type <> 'error' THEN value / 600 + (event_id % 7) / 10 END AS half FROM events)"


def clearness_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, v = F.col("event_id"), F.col("value")
    rows = table(spark, sf_dir, "events").select("ts", "event_type", (v / 300).alias("kt"), (k % 1000 / 900).alias("kd"), F.when(F.col("event_type") != "error", v / 600 + k % 7 / 10).alias("half"))
    return rows.withColumn("mf", solar.marques_filho(F.col("kt")))


@register(f"""WITH x AS (SELECT 'all' AS subset, value / 300 AS kt FROM events UNION ALL SELECT 'views', value / 300 FROM events WHERE event_type = 'view'), b(bin, low, high) AS (VALUES {_EDGE_SQL}),
    t AS (SELECT subset, count(*) AS n, count(*) FILTER (kt > 1) AS above, count(*) FILTER (kt <= 0.35) AS c1, count(*) FILTER (kt > 0.35 AND kt <= 0.55) AS c2, count(*) FILTER (kt > 0.55 AND kt <= 0.65) AS c3, count(*) FILTER (kt > 0.65) AS c4 FROM x GROUP BY subset),
    k AS (SELECT subset, bin, count(*) AS counted FROM x JOIN b ON kt >= low AND (kt < high OR (bin = 9 AND kt <= 1)) GROUP BY ALL), f AS (SELECT t.*, b.bin, coalesce(counted, 0) AS counted FROM t CROSS JOIN b LEFT JOIN k ON k.subset = t.subset AND k.bin = b.bin)
    SELECT subset, bin, n, above, counted, round(sum(counted) OVER (PARTITION BY subset ORDER BY bin) / n, 6) AS cumulative, c1, c2, c3, c4 FROM f""")
def sky_cumulative_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cumulative document of two subsets, parsed again."""
    subsets = {"all": ("All", F.lit(True)), "views": ("Views", F.col("event_type") == "view")}
    docs = sky.cumulative_documents(clearness_pairs(spark, sf_dir), subsets, edges=_EDGES)
    one = "struct<n:bigint,counts:array<bigint>,cumulative:array<double>,above:bigint,sky_conditions:struct<conditions:array<struct<count:bigint>>>>"
    rows = docs.select(F.explode(F.from_json("value", f"subsets map<string,{one}>")["subsets"]).alias("subset", "d"))
    c = "d.sky_conditions.conditions"
    rows = rows.select("subset", "d.n", "d.above", "d.cumulative", *[F.get(c, F.lit(k))["count"].alias(f"c{k + 1}") for k in range(4)], F.posexplode("d.counts").alias("bin", "counted"))
    return rows.select("subset", "bin", "n", "above", "counted", F.get("cumulative", F.col("bin")).alias("cumulative"), "c1", "c2", "c3", "c4")


_SCORES = "round(sqrt(avg((m - kd) ** 2)), 6) AS rmse, round(avg(m - kd), 6) AS mbe, round(avg(abs(m - kd)), 6) AS mae, count(m) AS pairs"


@register(f"""WITH {_PAIRS}, b(bin, low, high) AS (VALUES {_EDGE_SQL}), m AS (SELECT kt, kd, half AS m, 'half' AS id FROM p UNION ALL SELECT kt, kd, 0.13 + 0.86 / (1 + exp(-6.29 + 12.26 * kt)), 'mf' FROM p), s AS (SELECT id, {_SCORES} FROM m GROUP BY id),
    q AS (SELECT bin, count(half) AS n, CASE WHEN count(half) >= 30 THEN quantile_cont(half, [0.1, 0.5, 0.9]) END AS q FROM b LEFT JOIN p ON kt >= low AND kt < high GROUP BY bin),
    d AS (SELECT 'half' AS id, bin, n, round(q[2], 6) AS median, round(q[1], 6) AS p10, round(q[3], 6) AS p90 FROM q UNION ALL SELECT 'mf', bin, NULL, round(0.13 + 0.86 / (1 + exp(-6.29 + 12.26 * (low + high) / 2)), 6), NULL, NULL FROM b)
    SELECT id, bin, n, median, p10, p90, rmse, mbe, mae, pairs FROM d JOIN s USING (id)""")
def sky_models_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curves, bands and scores of the document of diffuse fraction against clearness, parsed again."""
    docs = sky.ktkd_document(clearness_pairs(spark, sf_dir), {"mf": ("mf", solar.marques_filho)}, {"half": "half"}, _EDGES)
    bins = "array<struct<bin:int,n:bigint,median:double,p10:double,p90:double>>"
    d = docs.select(F.from_json("value", f"models array<struct<id:string,bins:{bins}>>, scores array<struct<id:string,rmse:double,mbe:double,mae:double,n:bigint>>").alias("d"))
    scores = d.select(F.inline("d.scores")).withColumnRenamed("n", "pairs")
    drawn = d.select(F.inline("d.models")).select("id", F.inline("bins")).join(scores, "id")
    return drawn.select("id", "bin", "n", *[r6(c).alias(c) for c in ("median", "p10", "p90", "rmse", "mbe", "mae")], "pairs")


@register(f"""WITH {_PAIRS}, c AS (SELECT *, least(floor(round(kt * 10, 9)), 9) AS j, least(floor(round(kd * 10, 9)), 9) AS i FROM p WHERE kt BETWEEN 0 AND 1 AND kd BETWEEN 0 AND 1)
    SELECT round(kt, 3) AS kt, round(kd, 3) AS kd, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS t FROM c QUALIFY row_number() OVER (PARTITION BY i, j ORDER BY md5(epoch_us(ts)::VARCHAR), kt, kd) <= 3""")
def sky_points_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points of the same document: three of each cell of the density, the document's feature."""
    docs = sky.ktkd_document(clearness_pairs(spark, sf_dir), {}, {}, _EDGES, per_cell=3)
    p = docs.select(F.explode(F.from_json("value", "points array<array<string>>")["points"]).alias("p"))
    return p.select(F.col("p")[0].cast("double").alias("kt"), F.col("p")[1].cast("double").alias("kd"), F.col("p")[2].alias("t"))


# -- grids -----------------------------------------------------------------------------------------------------------------------

_AIR = """l AS (SELECT o_orderkey AS cell, k AS level, (101000 - k * (3500 + (o_custkey % 5) * 400) - o_orderkey % 90)::DOUBLE AS p, (10 + k * 350 + o_custkey % 50)::DOUBLE AS z, (284 + o_orderkey % 15 - 2 * k) * (1 + 0.608::DOUBLE * (0.012::DOUBLE / (k + 1))) AS tv FROM orders, (SELECT unnest(range(0, 6)) AS k))"""


@register(f"""WITH {_AIR}, g AS (SELECT cell, p AS p0, z AS z0 FROM l WHERE level = 0), u AS (SELECT cell, min(level) AS up FROM l JOIN g USING (cell) WHERE p < p0 - 10000 GROUP BY cell),
    j AS (SELECT cell, p0, z0, a.z - (a.z - b.z) * w AS z, a.tv - (a.tv - b.tv) * w AS t FROM (SELECT g.cell, p0, z0, a, b, ln((p0 - 10000) / a.p) / ln(b.p / a.p) AS w FROM g JOIN u USING (cell) JOIN l a ON a.cell = g.cell AND a.level = up JOIN l b ON b.cell = g.cell AND b.level = up - 1)),
    k AS (SELECT *, t * (p0 / (p0 - 10000)) ** (0.0065 * 287.04 / 9.81) AS ts, t + 0.0065 * z AS sea, 273.16 + 17.5 AS hot FROM j)
    SELECT cell, round(p0 * exp(2 * 9.81 * z0 / (287.04 * (CASE WHEN ts > hot THEN hot - 0.005 * (ts - hot) ** 2 ELSE least(sea, hot) END + ts))) / 100, 5) AS slp FROM k""")
def pressures_at_sea_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column of air an order, with cool and hot surfaces and a bracket at the second or third level."""
    key, cust, k = F.col("o_orderkey"), F.col("o_custkey"), F.col("level")
    air = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("level"))
    air = air.select(key.alias("cell"), "level", (101000.0 - k * (3500 + cust % 5 * 400) - key % 90).alias("p"), (10.0 + k * 350 + cust % 50).alias("z"), (284.0 + key % 15 - 2 * k).alias("tk"), (0.012 / (k + 1)).alias("qv"))
    return grid.sea_level_pressure(air, ["cell"]).select("cell", F.round("slp", 5).alias("slp"))


@register("""WITH l AS (SELECT o_orderkey AS step, k, 20.0::DOUBLE + k * (30 + o_custkey % 7) AS h, (o_orderkey % 17 - 8 + k / 2)::DOUBLE AS u, (o_custkey % 13 - 6 - k / 3)::DOUBLE AS v FROM orders, (SELECT unnest(range(0, 5)) AS k)),
    t AS (SELECT unnest([50, 100, 150])::DOUBLE AS height), b AS (SELECT step, height, greatest(0, least(count(*) FILTER (h <= height), 4) - 1) AS k FROM l, t GROUP BY step, height),
    w AS (SELECT b.step, height, (height - x.h) / (y.h - x.h) AS w, x.u AS xu, y.u AS yu, x.v AS xv, y.v AS yv FROM b JOIN l x ON x.step = b.step AND x.k = b.k JOIN l y ON y.step = b.step AND y.k = b.k + 1),
    i AS (SELECT step, height, xu + (yu - xu) * w AS u, xv + (yv - xv) * w AS v, sqrt(xu * xu + xv * xv) + (sqrt(yu * yu + yv * yv) - sqrt(xu * xu + xv * xv)) * w AS speed FROM w)
    SELECT step, height, round(u, 5) AS u, round(v, 5) AS v, round(speed, 5) AS speed, round((degrees(atan2(u, v)) + 360) % 360, 3) AS bearing FROM i""")
def winds_at_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winds of five levels a column at 50, 100 and 150 m."""
    key, cust, k = F.col("o_orderkey"), F.col("o_custkey"), F.col("level")
    air = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("level"))
    air = air.select(F.lit("D01").alias("domain"), key.alias("step"), F.lit(0).alias("y"), F.lit(0).alias("x"), "level", (20.0 + k * (30 + cust % 7)).alias("agl"), (key % 17 - 8 + k / 2).alias("u"), (cust % 13 - 6 - k / 3).alias("v"))
    return grid.wind_at_heights(air).select("step", "height", *[F.round(c, 5).alias(c) for c in ("u", "v", "speed")], F.round("bearing", 3).alias("bearing"))


# -- streams and reports -----------------------------------------------------------------------------------------------------------


@register("""WITH s AS (SELECT user_id AS station, TIMESTAMP '2020-01-01' + row_number() OVER (PARTITION BY user_id ORDER BY event_id) * INTERVAL 5 MINUTE AS ts, CASE WHEN event_type <> 'error' THEN floor(value / 50) END AS v FROM events),
    b AS (SELECT *, sum(c) OVER (PARTITION BY station ORDER BY ts) AS g FROM (SELECT *, CASE WHEN v = lag(v) OVER (PARTITION BY station ORDER BY ts) THEN 0 ELSE 1 END AS c FROM s))
    SELECT station, ts, v AS value, run FROM (SELECT *, row_number() OVER (PARTITION BY station, g ORDER BY ts) AS run FROM b) WHERE v IS NOT NULL AND run > 2""")
def stream_stuck_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stuck values of every station's stream, on a grid of five minutes."""
    folder = scratch_path(spark, "stuck-feed")
    place = F.row_number().over(grid.Window.partitionBy("user_id").orderBy("event_id"))
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("station"), (F.lit("2020-01-01").cast("timestamp_ntz") + F.make_dt_interval(mins=place * 5)).alias("ts"), F.when(F.col("event_type") != "error", F.floor(F.col("value") / 50).cast("double")).alias("v"))
    rows.write.parquet(folder)
    out = stream_to_table(spark, sensors.stream_stuck(spark.readStream.schema(rows.schema).parquet(folder), "v", 2, "station", idle="1 hour"), "stuck")
    return out.select("station", F.col("ts").cast("timestamp_ntz").alias("ts"), "value", F.col("run").cast("long").alias("run"))


_EVALUATED = "x AS (SELECT event_id, ts, value AS o, value + event_id % 9 - 3 AS p FROM events)"


@register(f"""WITH {_EVALUATED}, {sun_sql("x", 0, "a")}, r AS (SELECT x.*, floor(degrees(asin(mu)) / 10) * 10 AS el FROM x JOIN a USING (event_id)),
    s AS (SELECT 'overall' AS kind, 'all' AS stratum, o, p FROM r UNION ALL SELECT 'hour', hour(ts)::VARCHAR, o, p FROM r UNION ALL SELECT 'month', month(ts)::VARCHAR, o, p FROM r UNION ALL SELECT 'elevation', el::BIGINT::VARCHAR, o, p FROM r UNION ALL SELECT 'class', (event_id % 4)::VARCHAR, o, p FROM r)
    SELECT 'dhi' AS target, kind, stratum, count(*) AS n, round(sqrt(avg((p - o) ** 2)), 6) AS rmse, round(avg(abs(p - o)), 6) AS mae, round(avg(p - o), 6) AS mbe FROM s GROUP BY ALL""")
def evaluation_strata_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strata of a written report."""
    paths = _report(spark, sf_dir)
    t = spark.read.option("header", True).csv(paths["stratified"])
    return t.select("target", "kind", "stratum", F.col("n").cast("long").alias("n"), *[F.round(F.col(c).cast("double"), 6).alias(c) for c in ("rmse", "mae", "mbe")])


@register("""WITH c AS (SELECT event_id % 4 AS t, (event_id + (event_id // 7) % 2) % 4 AS p, count(*) AS n FROM events GROUP BY ALL) SELECT 'true_' || t AS "true", sum(n) FILTER (p = 0)::BIGINT AS pred_0, sum(n) FILTER (p = 1)::BIGINT AS pred_1, sum(n) FILTER (p = 2)::BIGINT AS pred_2, sum(n) FILTER (p = 3)::BIGINT AS pred_3 FROM c GROUP BY t""")
def evaluation_confusion_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The confusion table of a written report; a pair of classes that never occurs is 0 there, null here."""
    t = spark.read.option("header", True).csv(_report(spark, sf_dir)["confusion"])
    return t.select("true", *[F.nullif(F.col(f"pred_{k}").cast("long"), F.lit(0)).alias(f"pred_{k}") for k in range(4)])


@register(f"""WITH {_EVALUATED}, l AS (SELECT *, lag(o) OVER (PARTITION BY ts::DATE ORDER BY ts) AS ref FROM x), k AS (SELECT count(*) AS n, sqrt(avg((p - o) ** 2)) AS m, sqrt(avg((ref - o) ** 2)) AS r FROM l WHERE ref IS NOT NULL)
    SELECT (SELECT count(*) FROM x) AS n_samples, (SELECT round(sqrt(avg((p - o) ** 2)), 6) FROM x) AS rmse, k.n AS pairs, round(1 - m / r, 6) AS skill, (SELECT round(avg((event_id % 4 = (event_id + (event_id // 7) % 2) % 4)::INT), 6) FROM events) AS accuracy FROM k""")
def evaluation_metrics_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics document of a written report."""
    d = F.from_json("value", "n_samples bigint, global map<string,struct<scores:struct<rmse:double>,persistence:struct<n:bigint,skill:double>>>, classes struct<accuracy:double>")
    one = spark.read.text(_report(spark, sf_dir)["metrics"]).select(d.alias("d"))
    return one.select("d.n_samples", r6(F.col("d.global")["dhi"]["scores"]["rmse"]).alias("rmse"), F.col("d.global")["dhi"]["persistence"]["n"].alias("pairs"), r6(F.col("d.global")["dhi"]["persistence"]["skill"]).alias("skill"), r6(F.col("d.classes.accuracy")).alias("accuracy"))


def _report(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    k, v = F.col("event_id"), F.col("value")
    rows = table(spark, sf_dir, "events").select("ts", F.to_date("ts").cast("string").alias("day_id"), v.alias("obs_dhi"), (v + k % 9 - 3).alias("pred_dhi"), (k % 4).alias("obs_sky"), ((k + F.floor(k / 7) % 2) % 4).alias("pred_sky"))
    return evaluation.write_evaluation_report(rows, ["dhi"], scratch_path(spark, "report"), SITE, ts="ts", facts={"model": "nine"})
