"""Every registered query of the engine itself, with its equivalent SQL. All of them read the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import atmosphere, solar
from ..operators import calibration, hourly, joins, metrics, quality, ranks, stats, windows
from ..sources import catalogue_pages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
SITE = solar.Site(-13.0, -38.5, -3.0)
CHANNELS = ("click", "view", "purchase", "error", "signup")
FIRST_DAY, LAST_DAY = "2024-01-05", "2024-01-20"


def register(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a sensor record: a channel a column, a station a user."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("station"), "ts", *[F.when(F.col("event_type") == c, F.col("value")).alias(c) for c in CHANNELS])


_WIDE = "SELECT user_id AS station, ts, " + ", ".join(f"CASE WHEN event_type = '{c}' THEN value END AS {c}" for c in CHANNELS) + " FROM events"


# -- quality control and calibration -----------------------------------------------------------------------------------------


@register(f"""WITH w AS ({_WIDE}), g AS (SELECT station, ts, CASE WHEN click BETWEEN 1 AND 150 THEN click END AS click, CASE WHEN view BETWEEN 1 AND 150 THEN view END AS view FROM w),
    h AS (SELECT station, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS ts, CASE WHEN count(click) >= 1 THEN avg(click) END AS click, CASE WHEN count(view) >= 1 THEN avg(view) END AS view FROM g GROUP BY ALL),
    b AS (SELECT station, time_bucket(INTERVAL 6 HOUR, min(ts), TIMESTAMP '1970-01-01') AS lo, time_bucket(INTERVAL 6 HOUR, max(ts), TIMESTAMP '1970-01-01') AS hi FROM g GROUP BY station),
    s AS (SELECT station, unnest(generate_series(lo, hi, INTERVAL 6 HOUR)) AS ts FROM b)
    SELECT s.station, s.ts, round(click, 6) AS click, round(view, 6) AS view FROM s LEFT JOIN h USING (station, ts)""")
def hourly_qc_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gated means on a complete grid of windows, per station."""
    gated = quality.range_gate(wide(spark, sf_dir), [("click", 1, 150), ("view", 1, 150)])
    out = hourly.aggregate_hourly(gated, ["click", "view"], keys=["station"], freq="6 hours", min_samples=1)
    return out.select("station", "ts", r6("click").alias("click"), r6("view").alias("view"))


@register(f"""WITH w AS ({_WIDE}) SELECT * FROM (SELECT 'click' AS "column", count(*) FILTER (WHERE click < 1 OR click > 150) AS n FROM w
    UNION ALL SELECT 'view', count(*) FILTER (WHERE view < 1 OR view > 150) FROM w UNION ALL SELECT 'error', count(*) FILTER (WHERE error > 1e9) FROM w) WHERE n > 0""")
def range_violation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.range_violations(wide(spark, sf_dir), [("click", 1, 150), ("view", 1, 150), ("error", None, 1e9), ("absent", 0, 1)])


@register(f"""WITH w AS ({_WIDE}) SELECT station, ts, CASE WHEN NOT coalesce(click IN (0.5, 1.5) OR click > 200, false) THEN click END AS click,
    CASE WHEN NOT (view IS NOT NULL AND ts BETWEEN '2024-01-05' AND '2024-01-20') THEN view END AS view FROM w""")
def sentinels_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = quality.Sentinel
    rules = [s("click", "value", 0.5), s("click", "value", 1.5), s("click", "range", upper=200), s("view", "invalid", first=FIRST_DAY, last=LAST_DAY), s("absent", "value", 1.0)]
    return quality.mask_sentinels(wide(spark, sf_dir), rules).select("station", "ts", "click", "view")


@register(f"""WITH w AS ({_WIDE}) SELECT station, ts, round(CASE WHEN ts < '2024-01-11' THEN click * 1.1 WHEN ts >= '2024-01-15' AND ts < '2024-01-21' THEN click * 0.9 ELSE click END, 6) AS click,
    CASE WHEN ts >= '2024-01-25' THEN NULL ELSE view END AS view, round(CASE WHEN ts < '2024-01-11' THEN CASE WHEN ts < '2024-01-11' THEN click * 1.1 ELSE click END WHEN ts >= '2024-01-11' AND ts < '2024-01-31' THEN error END, 6) AS unified FROM w""")
def calibrated_and_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = calibration.Calibration, calibration.Switch
    out = calibration.apply_calibrations(wide(spark, sf_dir), [c("click", None, "2024-01-10", 1.1), c("click", "2024-01-15", "2024-01-20", 0.9), c("view", "2024-01-25", None, None)])
    out = calibration.unify_columns(out, [s("unified", "click", None, "2024-01-10"), s("unified", "error", "2024-01-11", "2024-01-30")])
    return out.select("station", "ts", r6("click").alias("click"), "view", r6("unified").alias("unified"))


_RULES_SQL = "SELECT o_custkey AS k, o_orderdate AS start, o_orderdate + INTERVAL 30 DAY AS \"end\" FROM orders"


def _order_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("start"), (F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")).alias("end"))


@register(f"""WITH r AS ({_RULES_SQL}), o AS (SELECT k, start, "end", max("end") OVER (PARTITION BY k ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS other_end FROM r)
    SELECT * FROM o WHERE start <= other_end""")
def rule_window_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.window_overlaps(_order_windows(spark, sf_dir), "k")


@register(f"""WITH r AS ({_RULES_SQL}), g AS (SELECT k, max("end") OVER (PARTITION BY k ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS gap_start,
    lead(start) OVER (PARTITION BY k ORDER BY start, "end") AS gap_end FROM r) SELECT * FROM g WHERE gap_start < gap_end""")
def uncovered_window_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.uncovered_gaps(_order_windows(spark, sf_dir), "k")


@register("""WITH d AS (SELECT l_suppkey AS k, l_shipdate::DATE AS day, max(l_linenumber) AS v FROM lineitem GROUP BY ALL),
    s AS (SELECT *, CASE WHEN v = lag(v) OVER w AND day = lag(day) OVER w + 1 THEN 0 ELSE 1 END AS st FROM d WINDOW w AS (PARTITION BY k ORDER BY day)),
    r AS (SELECT *, sum(st) OVER (PARTITION BY k ORDER BY day ROWS UNBOUNDED PRECEDING) AS run FROM s)
    SELECT k, day::TIMESTAMP AS ts, CASE WHEN count(*) OVER (PARTITION BY k, run) <= 2 THEN v::DOUBLE END AS v FROM r""")
def stuck_runs_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("k"), F.to_date("l_shipdate").cast("timestamp_ntz").alias("ts")).agg(F.max("l_linenumber").cast("double").alias("v"))
    return quality.persistent_runs(days, "v", 2, ["k"], step="1 day")


@register("""WITH e AS (SELECT user_id AS station, ts, value AS v, lag(value) OVER w AS b, lead(value) OVER w AS a, ts - lag(ts) OVER w AS g1, lead(ts) OVER w - ts AS g2
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts))
    SELECT station, ts, CASE WHEN coalesce(g1 <= INTERVAL 48 HOUR AND g2 <= INTERVAL 48 HOUR AND abs(v - b) > 60 AND abs(a - v) > 60 AND (v - b) * (a - v) < 0 AND abs(a - b) <= 20, false) THEN NULL ELSE v END AS v FROM e""")
def lone_spikes_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("station"), "ts", F.col("value").alias("v"))
    return quality.short_excursions(e, "v", 60.0, 20.0, ["station"], step="24 hours")


_RETURNS = "lead(near, {d}) OVER w AND abs(lead(jump, {d}) OVER w) > 60 AND lead(jump, {d}) OVER w * jump < 0 AND abs(lead(v, {d}) OVER w - before) <= 20"


@register(f"""WITH RECURSIVE d AS (SELECT user_id, ts, value AS v, row_number() OVER w AS i, value - lag(value) OVER w AS jump, lag(value) OVER w AS before, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER w) BETWEEN 1 AND 172800000000, false) AS near FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    c AS (SELECT *, CASE WHEN near AND abs(jump) > 60 THEN CASE WHEN {_RETURNS.format(d=1)} THEN i + 1 WHEN lead(near, 1) OVER w AND {_RETURNS.format(d=2)} THEN i + 2 WHEN lead(near, 1) OVER w AND lead(near, 2) OVER w AND {_RETURNS.format(d=3)} THEN i + 3 END END AS e FROM d WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    r AS (SELECT user_id, i, ts, v, 0::BIGINT AS until FROM c WHERE i = 1 UNION ALL SELECT c.user_id, c.i, c.ts, c.v, CASE WHEN c.i - 1 >= r.until AND c.e IS NOT NULL THEN c.e ELSE r.until END FROM r JOIN c ON c.user_id = r.user_id AND c.i = r.i + 1)
    SELECT user_id AS station, ts, CASE WHEN i >= until THEN v END AS v FROM r""")
def step_excursions_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("station"), "ts", F.col("value").alias("v"))
    return quality.step_excursions(e, "v", 60.0, 20.0, 3, ["station"], step_seconds=86_400.0)


@register("""WITH d AS (SELECT l_suppkey AS k, l_shipdate::DATE AS day, max(l_quantity) AS top FROM lineitem GROUP BY ALL), y AS (SELECT k, day, lag(day) OVER (PARTITION BY k ORDER BY day) AS p FROM d WHERE top <= 20)
    SELECT k, min(day) AS first, max(day) AS last, count(*) AS days FROM (SELECT k, day, sum(CASE WHEN p IS NULL OR day - p > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY day ROWS UNBOUNDED PRECEDING) AS run FROM y) GROUP BY k, run HAVING count(*) >= 2""")
def dry_day_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_shipdate").alias("ts"), (F.col("l_quantity") - 20).alias("depth"))
    return quality.blocked_gauge_runs(li, "depth", ["k"], min_days=2)


@register(f"""WITH w AS ({_WIDE}) SELECT 'click' AS "column", count(*) FILTER (WHERE click > 0 AND abs(click / 0.254 - round_even(click / 0.254, 0)) > 1e-5) AS n FROM w
    UNION ALL SELECT 'view', count(*) FILTER (WHERE view > 0 AND abs(view / 0.254 - round_even(view / 0.254, 0)) > 1e-5) FROM w""")
def unquantised_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.unquantised(wide(spark, sf_dir), ["click", "view"])


@register(f"""WITH w AS ({_WIDE}), l AS (SELECT station, ts, 'click' AS "column", click AS v FROM w UNION ALL SELECT station, ts, 'view', view FROM w)
    SELECT "column", date_trunc('month', ts)::DATE AS month, max(v) AS top, count(v) AS n FROM l GROUP BY ALL HAVING count(v) >= 20 AND max(v) < 1000""")
def months_below_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.months_never_saturated(wide(spark, sf_dir), ["click", "view"], floor=1000.0, min_samples=20)


# -- time aggregation -----------------------------------------------------------------------------------------------------------


@register("""WITH e AS (SELECT user_id AS station, date_trunc('day', ts) AS ts, value AS s, (value * 7.3) % 360 AS d FROM events),
    m AS (SELECT station, ts, count(d) AS n, avg(-s * sin(radians(d))) AS u, avg(-s * cos(radians(d))) AS v FROM e GROUP BY ALL)
    SELECT station, ts, round(CASE WHEN n >= 2 AND (u <> 0 OR v <> 0) THEN ((degrees(atan2(-u, -v)) % 360) + 360) % 360 END, 4) AS d FROM m""")
def vector_mean_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("station"), "ts", F.col("value").alias("s"), (F.col("value") * 7.3 % 360).alias("d"))
    out = hourly.aggregate_hourly(e, [], directions=["d"], speeds={"d": "s"}, keys=["station"], freq="1 day", min_samples=2, complete=False)
    return out.select("station", "ts", F.round("d", 4).alias("d"))


@register("""SELECT user_id AS station, date_trunc('day', ts) AS ts, round(avg(CASE WHEN event_type = 'view' THEN 1.0 ELSE 0.0 END), 6) AS ok_fraction FROM events GROUP BY ALL""")
def status_ok_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("station"), "ts", "event_type")
    return hourly.ok_fraction(e, "event_type", ["station"], freq="1 day", ok="view").withColumn("ok_fraction", r6("ok_fraction"))


@register("""SELECT h.hour, round(avg(value), 6) AS value FROM (SELECT unnest(range(0, 24)) AS hour) h LEFT JOIN events e ON hour(e.ts) = h.hour GROUP BY h.hour""")
def diurnal_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly.diurnal_cycle(table(spark, sf_dir, "events"), ["value"]).select(F.col("hour").cast("long").alias("hour"), r6("value").alias("value"))


@register("""SELECT m.month, round(avg(o_totalprice), 4) AS o_totalprice FROM (SELECT unnest(range(1, 13)) AS month) m LEFT JOIN orders o ON month(o.o_orderdate) = m.month GROUP BY m.month""")
def pooled_monthly_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hourly.monthly_means(table(spark, sf_dir, "orders"), ["o_totalprice"], ts="o_orderdate")
    return out.select(F.col("month").cast("long").alias("month"), F.round("o_totalprice", 4).alias("o_totalprice"))


@register("""WITH s AS (SELECT o_totalprice AS v, CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 'DJF' WHEN month(o_orderdate) IN (6, 7, 8) THEN 'JJA' END AS subset FROM orders)
    SELECT subset, count(*) AS n, round(avg(v), 4) AS mean FROM (SELECT v, 'all' AS subset FROM s UNION ALL SELECT v, subset FROM s WHERE subset IS NOT NULL) GROUP BY subset""")
def seasonal_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly.with_subsets(table(spark, sf_dir, "orders"), "o_orderdate").groupBy("subset").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"))


@register("""WITH d AS (SELECT user_id AS station, ts::DATE AS day, sum(value) AS value FROM events GROUP BY ALL), b AS (SELECT station, min(day) AS lo, max(day) AS hi FROM d GROUP BY station)
    SELECT s.station, s.day::DATE AS day, round(value, 6) AS value FROM (SELECT station, unnest(generate_series(lo, hi, INTERVAL 1 DAY))::DATE AS day FROM b) s LEFT JOIN d USING (station, day)""")
def daily_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("station"), "ts", "value")
    return hourly.daily_totals(e, "value", ["station"]).withColumn("value", r6("value"))


@register("""SELECT l_returnflag, round(sum(l_discount * l_extendedprice) / sum(l_extendedprice), 8) AS ratio FROM lineitem WHERE l_extendedprice > 50 GROUP BY ALL""")
def ratio_of_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("l_extendedprice")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(hourly.bulk_ratio(F.col("l_discount") * c, c, 50.0), 8).alias("ratio"))


@register("""WITH l AS (SELECT o_orderdate AS ts, 'o_totalprice' AS variable FROM orders WHERE o_totalprice IS NOT NULL),
    f AS (SELECT variable, year(ts) AS y, 'year' AS kind, year(ts)::VARCHAR AS label FROM l UNION ALL SELECT variable, year(ts), 'season', CASE WHEN month(ts) IN (12, 1, 2) THEN 'DJF' WHEN month(ts) IN (3, 4, 5) THEN 'MAM' WHEN month(ts) IN (6, 7, 8) THEN 'JJA' ELSE 'SON' END FROM l)
    SELECT variable, kind, label, count(*) AS hours, array_to_string(list_sort(list(DISTINCT y)), ',') AS years FROM f GROUP BY ALL""")
def coverage_by_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hourly.coverage_panel(table(spark, sf_dir, "orders"), ["o_totalprice"], "o_orderdate")
    return out.withColumn("years", F.array_join(F.transform("years", lambda y: y.cast("string")), ","))


# -- joins ----------------------------------------------------------------------------------------------------------------------


@register("""WITH c AS (SELECT user_id, ts, value FROM events WHERE event_type = 'click'), v AS (SELECT user_id, ts, value FROM events WHERE event_type = 'view'),
    j AS (SELECT c.user_id, c.ts, c.value AS value_obs, v.value AS value_model, abs(epoch_us(v.ts) - epoch_us(c.ts)) AS gap,
          row_number() OVER (PARTITION BY c.user_id, c.ts ORDER BY abs(epoch_us(v.ts) - epoch_us(c.ts)) NULLS LAST, v.ts) AS k
          FROM c LEFT JOIN v ON c.user_id = v.user_id AND abs(epoch_us(v.ts) - epoch_us(c.ts)) <= 43200000000)
    SELECT user_id, ts, value_obs, value_model, round(gap / 1e6, 6) AS gap_seconds FROM j WHERE k = 1""")
def asof_nearest_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    pick = lambda kind: e.where(F.col("event_type") == kind).select("user_id", "ts", "value")
    return joins.asof_nearest(pick("click"), pick("view"), ["user_id"], tolerance="12 hours").withColumn("gap_seconds", r6("gap_seconds"))


@register("""WITH r AS (SELECT o_custkey AS user_id, 1 + row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rule, TIMESTAMP '2024-01-01' + (o_orderkey % 28) * INTERVAL 1 DAY AS start FROM orders)
    SELECT e.event_id, r.rule, r.start FROM events e JOIN r ON e.user_id = r.user_id AND e.ts >= r.start AND e.ts <= r.start + INTERVAL 36 HOUR""")
def interval_joined_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    days = F.make_interval(days=(F.col("o_orderkey") % 28).cast("int"))
    rules = o.select(F.col("o_custkey").alias("user_id"), (1 + F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))).cast("long").alias("rule"), (F.lit("2024-01-01").cast("timestamp_ntz") + days).alias("start"))
    rules = rules.withColumn("end", F.col("start") + F.expr("INTERVAL 36 HOURS"))
    return joins.interval_join(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), rules, "user_id", bucket_days=2).select("event_id", "rule", "start")


@register("""WITH p AS (SELECT s_suppkey, ((s_suppkey * 37) % 100) / 10.0 AS lat, ((s_suppkey * 53) % 100) / 10.0 AS lon FROM supplier), c AS (SELECT c_custkey % 40 AS y, c_custkey // 40 AS x, ((c_custkey * 7) % 101) / 10.0 AS clat, ((c_custkey * 11) % 103) / 10.0 AS clon FROM customer),
    j AS (SELECT s_suppkey, y, x, row_number() OVER (PARTITION BY s_suppkey ORDER BY sqrt(pow(clat - lat, 2) + pow(clon - lon, 2)), y, x) AS k, 
          sqrt(pow((clat - lat) * 111.32, 2) + pow((clon - lon) * 111.32 * cos(radians(lat)), 2)) AS km FROM p, c)
    SELECT s_suppkey, y, x, round(km, 6) AS distance_km FROM j WHERE k = 1""")
def nearest_grid_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("s_suppkey"), F.col("c_custkey")
    points = table(spark, sf_dir, "supplier").select("s_suppkey", ((k * 37 % 100) / 10.0).alias("lat"), ((k * 53 % 100) / 10.0).alias("lon"))
    cells = table(spark, sf_dir, "customer").select((c % 40).alias("y"), F.floor(c / 40).alias("x"), ((c * 7 % 101) / 10.0).alias("lat"), ((c * 11 % 103) / 10.0).alias("lon"))
    return joins.nearest_cell(points, cells).select("s_suppkey", "y", "x", r6("distance_km").alias("distance_km"))


@register("""WITH p AS (SELECT c_custkey, ((c_custkey * 37) % 100) / 10.0 AS lat, ((c_custkey * 53) % 100) / 10.0 AS lon FROM customer),
    d(domain, dx, south, north, west, east) AS (VALUES ('D01', 9.0, 0.0, 9.0, 0.0, 9.0), ('D02', 3.0, 2.0, 6.0, 2.0, 6.0), ('D03', 1.0, 4.0, 5.0, 4.0, 5.0), ('D04', 3.0, 5.0, 7.0, 5.0, 7.0)),
    j AS (SELECT c_custkey, domain, row_number() OVER (PARTITION BY c_custkey ORDER BY dx, domain) AS k FROM p LEFT JOIN d ON lat BETWEEN south AND north AND lon BETWEEN west AND east)
    SELECT c_custkey, domain FROM j WHERE k = 1""")
def finest_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    points = table(spark, sf_dir, "customer").select("c_custkey", ((k * 37 % 100) / 10.0).alias("lat"), ((k * 53 % 100) / 10.0).alias("lon"))
    rows = [("D01", 9.0, 0.0, 9.0, 0.0, 9.0), ("D02", 3.0, 2.0, 6.0, 2.0, 6.0), ("D03", 1.0, 4.0, 5.0, 4.0, 5.0), ("D04", 3.0, 5.0, 7.0, 5.0, 7.0)]
    domains = spark.createDataFrame(rows, "domain string, dx double, south double, north double, west double, east double")
    return joins.assign_domains(points, domains).select("c_custkey", "domain")


@register("""WITH d AS (SELECT user_id AS station, date_trunc('hour', ts) AS ts, avg(value) AS kt FROM events GROUP BY ALL)
    SELECT d.station, d.ts, round(coalesce((p.kt + n.kt) / 2, p.kt, n.kt, d.kt), 6) AS psi FROM d LEFT JOIN d p ON p.station = d.station AND p.ts = d.ts - INTERVAL 1 HOUR LEFT JOIN d n ON n.station = d.station AND n.ts = d.ts + INTERVAL 1 HOUR""")
def neighbour_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("station"), F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz").alias("ts")).agg(F.avg("value").alias("kt"))
    return joins.neighbour_mean(h, "kt", ["station"]).select("station", "ts", r6("psi").alias("psi"))


@register("""SELECT event_id, round(sum(value) OVER w / sum(value + 10) OVER w, 8) AS daily_kt FROM events WINDOW w AS (PARTITION BY user_id, ts::DATE)""")
def daily_ratio_on_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("top", F.col("value") + 10)
    return joins.daily_ratio(e, "value", "top", ["user_id"]).select("event_id", F.round("daily_kt", 8).alias("daily_kt"))


@register("""SELECT doc_id, 'missing' AS problem FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'duplicate' FROM labels GROUP BY doc_id HAVING count(*) > 1""")
def index_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.coverage_check(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@register("""SELECT a.vec_id, list_sum(list_transform(list(b.vec_id), lambda x: x))::BIGINT AS members, count(*) AS n FROM embeddings a JOIN embeddings b ON a.label = b.label AND abs(a.vec_id - b.vec_id) <= 20 GROUP BY a.vec_id""")
def window_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").withColumn("ts", F.timestamp_seconds(F.col("vec_id")))
    out = joins.window_members(e, 20, "label", F.col("vec_id"))
    return out.select("vec_id", F.aggregate("members", F.lit(0).cast("long"), lambda s, x: s + x).alias("members"), F.size("members").cast("long").alias("n"))


@register("""WITH m AS (SELECT a.vec_id, b.embedding AS e FROM embeddings a JOIN embeddings b ON a.label = b.label AND abs(a.vec_id - b.vec_id) <= 20),
    u AS (SELECT vec_id, unnest(e)::DOUBLE AS x, unnest(range(1, len(e) + 1)) AS p FROM m), g AS (SELECT vec_id, p, avg(x) AS x FROM u GROUP BY ALL)
    SELECT vec_id, round(sum(x * p), 4) AS checksum FROM g GROUP BY vec_id""")
def pooled_window_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").withColumn("ts", F.timestamp_seconds(F.col("vec_id")))
    pooled = windows.pool_embeddings(joins.window_members(e, 20, "label", F.col("embedding")), "members")
    return pooled.select("vec_id", F.round(F.aggregate(F.transform("pooled", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x), 4).alias("checksum"))


@register("""SELECT page_id, url FROM pages WHERE page_id IN (SELECT page_id FROM pages WHERE regexp_matches(html, 'href="/[A-Za-z]+"'))""")
def pages_with_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = catalogue_pages.extract_links(table(spark, sf_dir, "pages"), r'href="(/[A-Za-z]+)"')
    return table(spark, sf_dir, "pages").select("page_id", "url").join(links.select("page_id").distinct(), "page_id", "left_semi")


@register("""WITH l AS (SELECT DISTINCT unnest(regexp_extract_all(html, 'href="(/[A-Za-z]+)"', 1)) AS link FROM pages) SELECT link FROM l""")
def distinct_catalogue_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue_pages.extract_links(table(spark, sf_dir, "pages"), r'href="(/[A-Za-z]+)"').select("link").distinct()


# -- scores ---------------------------------------------------------------------------------------------------------------------

_PAIRS = "SELECT o_orderkey, o_orderstatus, o_totalprice AS o, p FROM orders JOIN (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount)) AS p FROM lineitem GROUP BY ALL) l ON l_orderkey = o_orderkey"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("p"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").alias("o"))
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).drop("l_orderkey")


@register(f"""WITH x AS ({_PAIRS}), m AS (SELECT *, avg(o) OVER () AS m FROM x)
    SELECT 'price' AS variable, count(*) AS n, round(sqrt(avg((p - o) ** 2)), 3) AS rmse, round(avg(abs(p - o)), 3) AS mae, round(avg(p - o), 3) AS mbe, round(1 - sum((p - o) ** 2) / sum((o - m) ** 2), 6) AS r2, round(corr(o, p), 6) AS r,
    round(1 - sum((p - o) ** 2) / sum((abs(p - m) + abs(o - m)) ** 2), 6) AS d FROM m""")
def paired_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _pairs(spark, sf_dir).withColumnsRenamed({"o": "price_obs", "p": "price_model"})
    t = metrics.paired_table(df, ["price"])
    return t.select("variable", "n", *[F.round(c, 3).alias(c) for c in ("rmse", "mae", "mbe")], *[r6(c).alias(c) for c in ("r2", "r", "d")])


@register(f"""WITH x AS (SELECT o_orderstatus, o % 360 AS o, p % 360 AS p FROM ({_PAIRS})), g AS (SELECT o_orderstatus, (((p - o + 180) % 360) + 360) % 360 - 180 AS e FROM x)
    SELECT o_orderstatus, count(*) AS n, round(sqrt(avg(e * e)), 4) AS rmse, round(avg(abs(e)), 4) AS mae, round(avg(e), 4) AS mbe FROM g GROUP BY ALL""")
def circular_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _pairs(spark, sf_dir).select("o_orderstatus", (F.col("o") % 360).alias("WD_obs"), (F.col("p") % 360).alias("WD_model"))
    t = metrics.paired_table(df, ["WD"], ["o_orderstatus"])
    return t.select("o_orderstatus", "n", *[F.round(c, 4).alias(c) for c in ("rmse", "mae", "mbe")])


@register(f"""WITH x AS ({_PAIRS}), s AS (SELECT 'overall' AS kind, 'all' AS stratum, o, p FROM x UNION ALL SELECT 'status', o_orderstatus, o, p FROM x UNION ALL SELECT 'band', floor(o / 100000)::BIGINT::VARCHAR, o, p FROM x)
    SELECT kind, stratum, count(*) AS n, round(sqrt(avg((p - o) ** 2)), 3) AS rmse, round(avg(abs((o - p) / o)) * 100, 6) AS mape FROM s GROUP BY ALL""")
def stratified_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    strata = {"status": F.col("o_orderstatus"), "band": F.floor(F.col("o") / 100000)}
    t = metrics.stratified(_pairs(spark, sf_dir), "o", "p", strata, ["n", "rmse", "mape"])
    return t.select("kind", "stratum", "n", F.round("rmse", 3).alias("rmse"), r6("mape").alias("mape"))


@register(f"""WITH x AS ({_PAIRS}), y AS (SELECT *, lag(o) OVER (ORDER BY o_orderkey) AS ref FROM x)
    SELECT count(*) AS n, round(sqrt(avg((p - o) ** 2)), 3) AS rmse_model, round(sqrt(avg((ref - o) ** 2)), 3) AS rmse_reference, round(1 - sqrt(avg((p - o) ** 2)) / sqrt(avg((ref - o) ** 2)), 6) AS skill FROM y WHERE ref IS NOT NULL""")
def skill_against_persistence(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = ranks.previous(_pairs(spark, sf_dir), ["o"], "o_orderkey")
    t = metrics.skill(df, "o", "p", "o_prev")
    return t.select("n", F.round("rmse_model", 3).alias("rmse_model"), F.round("rmse_reference", 3).alias("rmse_reference"), r6("skill").alias("skill"))


@register("""WITH c AS (SELECT quality AS t, toxic AS p, count(*) AS n FROM labels GROUP BY ALL), a AS (SELECT unnest([0, 1]) AS t), b AS (SELECT unnest([0, 1]) AS p)
    SELECT a.t::BIGINT AS truth, b.p::BIGINT AS pred, coalesce(n, 0) AS n FROM a CROSS JOIN b LEFT JOIN c ON c.t = a.t AND c.p = b.p""")
def confusion_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(table(spark, sf_dir, "labels"), "quality", "toxic", [0, 1]).select(F.col("truth").cast("long").alias("truth"), F.col("pred").cast("long").alias("pred"), F.col("n").cast("long").alias("n"))


@register("""WITH j AS (SELECT lang, quality AS t, toxic AS p FROM labels JOIN documents USING (doc_id)),
    g AS (SELECT lang, count(*) AS n, avg((t = p)::INT) AS accuracy, count(*) FILTER (t = 0 AND p = 0) AS h0, count(*) FILTER (t = 1 AND p = 1) AS h1, count(*) FILTER (t = 0) AS r0, count(*) FILTER (t = 1) AS r1, count(*) FILTER (p = 0) AS s0, count(*) FILTER (p = 1) AS s1 FROM j GROUP BY lang)
    SELECT lang, n, round(accuracy, 6) AS accuracy, round(list_avg(list_filter([h0 / nullif(r0, 0), h1 / nullif(r1, 0)], lambda x: x IS NOT NULL)), 6) AS balanced_accuracy,
    round(list_avg(list_filter([2.0 * h0 / nullif(r0 + s0, 0), 2.0 * h1 / nullif(r1 + s1, 0)], lambda x: x IS NOT NULL)), 6) AS macro_f1 FROM g""")
def classification_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    t = metrics.classification(df, "quality", "toxic", [0, 1], ["lang"])
    return t.select("lang", "n", *[r6(c).alias(c) for c in ("accuracy", "balanced_accuracy", "macro_f1")])


@register(f"""WITH x AS ({_PAIRS}), v AS (SELECT o_orderstatus, v, sum(a) AS a, sum(b) AS b FROM (SELECT o_orderstatus, o AS v, 1 AS a, 0 AS b FROM x UNION ALL SELECT o_orderstatus, p, 0, 1 FROM x) GROUP BY ALL),
    c AS (SELECT o_orderstatus, abs(sum(a) OVER w / sum(a) OVER (PARTITION BY o_orderstatus) - sum(b) OVER w / sum(b) OVER (PARTITION BY o_orderstatus)) AS gap FROM v WINDOW w AS (PARTITION BY o_orderstatus ORDER BY v ROWS UNBOUNDED PRECEDING))
    SELECT o_orderstatus, round(max(gap), 8) AS ks FROM c GROUP BY ALL""")
def two_sample_ks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.ks_two_sample(_pairs(spark, sf_dir), "o", "p", ["o_orderstatus"]).withColumn("ks", F.round("ks", 8))


@register(f"""WITH x AS ({_PAIRS}), m AS (SELECT *, avg(o) OVER (PARTITION BY o_orderstatus) AS m FROM x)
    SELECT o_orderstatus, count(*) AS n, round(stddev_pop(p - o), 3) AS sd, round(regr_slope(p, o), 6) AS sbf, round(1 - sum((p - o) ** 2) / sum((o - m) ** 2), 6) AS nse, round(1 - sum(abs(p - o)) / sum(abs(o - m)), 6) AS lce FROM m GROUP BY ALL""")
def extended_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = metrics.residual_metrics(_pairs(spark, sf_dir), "o", "p", ["o_orderstatus"])
    return t.select("o_orderstatus", "n", F.round("sd", 3).alias("sd"), *[r6(c).alias(c) for c in ("sbf", "nse", "lce")])


# -- solar geometry and physics -----------------------------------------------------------------------------------------------------

_SUN = """WITH t AS (SELECT event_id, ts, value, hour(ts) + minute(ts) / 60.0 + floor(second(ts)) / 3600.0 AS h, dayofyear(ts) AS doy FROM events),
    g AS (SELECT *, 2 * pi() / 365.0 * (doy - 1 + (h - 12) / 24.0) AS g FROM t),
    s AS (SELECT *, 0.006918 - 0.399912 * cos(g) + 0.070257 * sin(g) - 0.006758 * cos(2 * g) + 0.000907 * sin(2 * g) - 0.002697 * cos(3 * g) + 0.00148 * sin(3 * g) AS dec,
          229.18 * (7.5e-05 + 0.001868 * cos(g) - 0.032077 * sin(g) - 0.014615 * cos(2 * g) - 0.040849 * sin(2 * g)) AS eqt,
          1.00011 + 0.034221 * cos(g) + 0.00128 * sin(g) + 0.000719 * cos(2 * g) + 7.7e-05 * sin(2 * g) AS e0 FROM g),
    a AS (SELECT *, (h * 60 + eqt + 4 * -38.5 + 180) / 4 - 180 AS ha FROM s),
    c AS (SELECT *, greatest(-1.0, least(1.0, sin(radians(-13.0)) * sin(dec) + cos(radians(-13.0)) * cos(dec) * cos(radians(ha)))) AS mu FROM a)
    """


@register(_SUN + """SELECT event_id, round(degrees(asin(mu)), 6) AS elevation, round(ha, 6) AS hour_angle, round(greatest(0.0, 1361.0 * e0 * mu), 5) AS e0h,
    round(CASE WHEN mu > 0 THEN 1098.0 * mu * exp(-0.057 / mu) ELSE 0 END, 5) AS clear, round(CASE WHEN 1361.0 * e0 * mu > 0 THEN value * 4 / (1361.0 * e0 * mu) END, 6) AS kt,
    round((CASE WHEN ((ha + 180) % 360 + 360) % 360 - 180 > 0 THEN z + 180 ELSE 540 - z END) % 360, 4) AS azimuth
    FROM (SELECT *, degrees(acos(greatest(-1.0, least(1.0, (sin(radians(-13.0)) * mu - sin(dec)) / (cos(radians(-13.0)) * sin(acos(mu))))))) AS z FROM c)""")
def solar_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts")
    e = table(spark, sf_dir, "events").withColumn("ts", F.date_trunc("second", ts).cast("timestamp_ntz"))
    return e.select(
        "event_id", r6(solar.elevation(ts, SITE)).alias("elevation"), r6(solar.hour_angle(ts, SITE)).alias("hour_angle"), F.round(solar.extraterrestrial(ts, SITE), 5).alias("e0h"),
        F.round(solar.haurwitz(solar.cos_zenith(ts, SITE)), 5).alias("clear"), r6(solar.clearness_index(F.col("value") * 4, ts, SITE)).alias("kt"), F.round(solar.azimuth(ts, SITE), 4).alias("azimuth"),
    )


_KT = "SELECT event_id, value / 100.0 AS kt, value AS ghi FROM events"


@register(f"""WITH k AS ({_KT}), e AS (SELECT *, greatest(0.0, least(1.0, CASE WHEN kt <= 0.22 THEN 1 - 0.09 * kt WHEN kt <= 0.8 THEN 0.9511 - 0.1604 * kt + 4.388 * kt ** 2 - 16.638 * kt ** 3 + 12.336 * kt ** 4 ELSE 0.165 END)) AS kd FROM k)
    SELECT event_id, round(kd, 6) AS erbs, round(kd * ghi, 9) AS pseudo_diffuse, round(0.13 + 0.86 / (1 + exp(-6.29 + 12.26 * kt)), 6) AS marques_filho,
    round(1 / (1 + exp(-5.38 + 6.63 * kt - 0.006 * 12 - 0.007 * 45 + 1.75 * kt + 1.31 * kt)), 6) AS ridley,
    (CASE WHEN kt <= 0.35 THEN 0 WHEN kt <= 0.55 THEN 1 WHEN kt <= 0.65 THEN 2 ELSE 3 END)::BIGINT AS sky FROM e""")
def diffuse_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    kt, ghi = F.col("value") / 100.0, F.col("value")
    return table(spark, sf_dir, "events").select(
        "event_id", r6(solar.erbs(kt)).alias("erbs"), F.round(solar.pseudo_diffuse(ghi, kt), 9).alias("pseudo_diffuse"), r6(solar.marques_filho(kt)).alias("marques_filho"),
        r6(solar.logistic_diffuse(kt, F.lit(12.0), F.lit(45.0), kt, kt, solar.RIDLEY)).alias("ridley"), solar.sky_class(kt).cast("long").alias("sky"),
    )


@register("""WITH e AS (SELECT event_id, value AS s, (value * 7.3) % 360 AS d, value / 10 AS t, value / 20000 AS q FROM events)
    SELECT event_id, round(-s * sin(radians(d)), 6) AS u, round(-s * cos(radians(d)), 6) AS v, round(q * 101325 / (0.622 + q), 5) AS e, round(611.2 * exp(17.67 * t / (t + 243.5)), 4) AS es,
    round(greatest(0.0, least(100.0, 100 * (q * 101325 / (0.622 + q)) / (611.2 * exp(17.67 * t / (t + 243.5))))), 5) AS rh, round(101325 / (287.05 * (t + 273.15) * (1 + 0.61 * q)), 6) AS rho,
    round(0.5 * (101325 / (287.05 * (t + 273.15) * (1 + 0.61 * q))) * s * s * s, 2) AS power FROM e""")
def wind_and_humidity(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, d, t, q, p = F.col("value"), F.col("value") * 7.3 % 360, F.col("value") / 10, F.col("value") / 20000, F.lit(101325.0)
    u, v = atmosphere.wind_components(s, d)
    rho = atmosphere.air_density(p, atmosphere.convert(t, "C", "K"), q)
    return table(spark, sf_dir, "events").select(
        "event_id", r6(u).alias("u"), r6(v).alias("v"), F.round(atmosphere.vapor_pressure(q, p), 5).alias("e"), F.round(atmosphere.saturation_vapor_pressure(t), 4).alias("es"),
        F.round(atmosphere.relative_humidity(q, p, t), 5).alias("rh"), r6(rho).alias("rho"), F.round(atmosphere.wind_power_density(rho, s), 2).alias("power"),
    )


@register("""WITH e AS (SELECT event_id, value AS sw, 0.2 AS al, 300 + value / 10 AS glw, 0.97 AS em, 290 + value / 50 AS ts FROM events)
    SELECT event_id, round(al * sw, 6) AS swup, round(em * 5.670374419e-08 * ts ** 4 + (1 - em) * glw, 5) AS lwup, round(sw - al * sw + glw - (em * 5.670374419e-08 * ts ** 4 + (1 - em) * glw), 5) AS rnet FROM e""")
def surface_radiation_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    b = atmosphere.radiation_budget(v, F.lit(0.2), 300 + v / 10, F.lit(0.97), 290 + v / 50)
    return table(spark, sf_dir, "events").select("event_id", r6(b["swup"]).alias("swup"), F.round(b["lwup"], 5).alias("lwup"), F.round(b["rnet"], 5).alias("rnet"))


@register(_SUN + """SELECT event_id, CASE WHEN value * 4 > 1.5 * 1367.0 * e0 * CASE WHEN mu > 0 THEN mu ** 1.2 ELSE 0 END + 100 OR (mu > 0 AND value <= 0) THEN NULL ELSE value * 4 END AS "Sw_dw" FROM c""")
def impossible_shortwave_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.date_trunc("second", "ts").cast("timestamp_ntz").alias("ts"), (F.col("value") * 4).alias("Sw_dw"))
    return quality.mask_impossible(e, SITE).drop("ts")


@register(_SUN + """, n AS (SELECT ts::DATE AS day, count(*) FILTER (WHERE value > 50 AND degrees(asin(mu)) < -10) AS n FROM c GROUP BY ALL) SELECT * FROM n WHERE n >= 3""")
def corrupted_nights(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.date_trunc("second", "ts").cast("timestamp_ntz").alias("ts"), F.col("value").alias("Sw_dw"))
    return quality.night_corrupted_days(e, SITE, ["Sw_dw"])


# -- statistics -------------------------------------------------------------------------------------------------------------------


@register("""SELECT l_returnflag, count(*) AS n, round(avg(l_extendedprice), 4) AS mean, round(stddev_samp(l_extendedprice), 4) AS std, min(l_extendedprice) AS min, max(l_extendedprice) AS max,
    round(quantile_cont(l_extendedprice, 0.25), 4) AS p25, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.99), 4) AS p99, round(skewness(l_extendedprice), 6) AS skew, round(kurtosis(l_extendedprice), 6) AS kurtosis FROM lineitem GROUP BY ALL""")
def shape_of_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stats.describe_shape(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_returnflag"])
    return t.select("l_returnflag", "n", *[F.round(c, 4).alias(c) for c in ("mean", "std")], "min", "max", *[F.round(c, 4).alias(c) for c in ("p25", "p50", "p99")], r6("skew").alias("skew"), r6("kurtosis").alias("kurtosis"))


@register("""WITH b AS (SELECT unnest(range(0, 10)) AS bin), v AS (SELECT l_returnflag, l_quantity AS x FROM lineitem), f AS (SELECT DISTINCT l_returnflag FROM v),
    c AS (SELECT l_returnflag, CASE WHEN x = 50 THEN 9 ELSE floor(x / 5) END::BIGINT AS bin, count(*) AS n FROM v WHERE x BETWEEN 0 AND 50 GROUP BY ALL)
    SELECT l_returnflag, bin, coalesce(n, 0) AS n, round(coalesce(n, 0) / (sum(n) OVER (PARTITION BY l_returnflag) * 5), 8) AS density FROM f CROSS JOIN b LEFT JOIN c USING (l_returnflag, bin)""")
def quantity_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = stats.histogram(table(spark, sf_dir, "lineitem"), "l_quantity", stats.linear_edges(0, 50, 5), ["l_returnflag"])
    return h.select("l_returnflag", F.col("bin").cast("long").alias("bin"), F.col("n").cast("long").alias("n"), F.round("density", 8).alias("density"))


@register("""SELECT least(floor(l_quantity / 10), 4)::BIGINT AS i, least(floor(l_extendedprice / 20000), 5)::BIGINT AS j, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 0 AND 50 AND l_extendedprice BETWEEN 0 AND 120000 GROUP BY ALL""")
def price_by_quantity(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = stats.histogram_2d(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_quantity", stats.linear_edges(0, 120000, 20000), stats.linear_edges(0, 50, 10))
    return h.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "n")


@register("""WITH b AS (SELECT unnest(range(0, 5)) AS bin), v AS (SELECT floor(l_quantity / 10)::BIGINT AS bin, l_discount AS y FROM lineitem WHERE l_quantity >= 0 AND l_quantity < 50)
    SELECT bin, (bin * 10 + 5)::DOUBLE AS centre, count(y) AS n, round(quantile_cont(y, 0.1), 6) AS p10, round(quantile_cont(y, 0.5), 6) AS median, round(quantile_cont(y, 0.9), 6) AS p90 FROM b LEFT JOIN v USING (bin) GROUP BY ALL""")
def discount_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stats.quantile_band(table(spark, sf_dir, "lineitem"), "l_quantity", "l_discount", stats.linear_edges(0, 50, 10), 5)
    return t.select(F.col("bin").cast("long").alias("bin"), "centre", F.col("n").cast("long").alias("n"), *[r6(c).alias(c) for c in ("p10", "median", "p90")])


@register("""WITH s AS (SELECT unnest(range(0, 16)) AS sector), c AS (SELECT floor((((value * 7.3) % 360 + 11.25) % 360) / 22.5)::BIGINT AS sector, count(*) AS n FROM events GROUP BY ALL)
    SELECT sector, coalesce(n, 0) AS n, round(coalesce(n, 0) / sum(n) OVER (), 8) AS share FROM s LEFT JOIN c USING (sector)""")
def wind_rose(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stats.sector_frequencies(table(spark, sf_dir, "events").select((F.col("value") * 7.3 % 360).alias("d")), "d")
    return t.select(F.col("sector").cast("long").alias("sector"), F.col("n").cast("long").alias("n"), F.round("share", 8).alias("share"))


@register("""WITH e AS (SELECT event_type, radians((value * 7.3) % 360) AS r FROM events), m AS (SELECT event_type, count(*) AS n, avg(cos(r)) AS c, avg(sin(r)) AS s FROM e GROUP BY ALL)
    SELECT event_type, n, round(((degrees(atan2(s, c)) % 360) + 360) % 360, 4) AS mean_direction, round(sqrt(c * c + s * s), 6) AS resultant FROM m""")
def circular_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stats.circular_summary(table(spark, sf_dir, "events").select("event_type", (F.col("value") * 7.3 % 360).alias("d")), "d", ["event_type"])
    return t.select("event_type", "n", F.round("mean_direction", 4).alias("mean_direction"), r6("resultant").alias("resultant"))


@register("""WITH e AS (SELECT CASE WHEN value / 100 <= 0.35 THEN 0 WHEN value / 100 <= 0.55 THEN 1 WHEN value / 100 <= 0.65 THEN 2 ELSE 3 END AS c FROM events)
    SELECT k.c::BIGINT AS class, count(e.c) AS n, round(count(e.c) / sum(count(e.c)) OVER (), 8) AS share FROM (SELECT unnest([0, 1, 2, 3]) AS c) k LEFT JOIN e ON e.c = k.c GROUP BY k.c""")
def sky_class_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select(solar.sky_class(F.col("value") / 100).alias("sky"))
    return stats.class_shares(df, "sky", [0, 1, 2, 3]).select(F.col("class").cast("long").alias("class"), F.col("n").cast("long").alias("n"), F.round("share", 8).alias("share"))


@register("""WITH c AS (SELECT floor(l_quantity / 5)::BIGINT AS bin, count(*) AS n FROM lineitem GROUP BY ALL) SELECT bin, n, round(sum(n) OVER (ORDER BY bin) / sum(n) OVER (), 8) AS cumulative FROM c""")
def cumulative_quantity(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = table(spark, sf_dir, "lineitem").groupBy(F.floor(F.col("l_quantity") / 5).alias("bin")).agg(F.count("*").alias("n"))
    return stats.cumulative_frequency(bins, "bin", "n").withColumn("cumulative", F.round("cumulative", 8))


@register("""SELECT l_returnflag, min(l_extendedprice) AS scale_min, round(quantile_cont(l_extendedprice, 0.98), 4) AS scale_max FROM lineitem WHERE l_linenumber >= 2 GROUP BY ALL""")
def display_scale_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stats.scale_bounds(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_returnflag"], "l_linenumber", from_step=2)
    return t.withColumn("scale_max", F.round("scale_max", 4))


@register("""WITH n AS (SELECT o_orderstatus, o_totalprice AS x, ntile(60) OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice) AS bin FROM orders), g AS (SELECT o_orderstatus, bin, avg(x) AS mean, count(*) AS n FROM n GROUP BY ALL)
    SELECT o_orderstatus, bin::BIGINT AS bin, round(mean, 3) AS mean, round(n / sum(n) OVER (PARTITION BY o_orderstatus), 8) AS weight FROM g""")
def equal_count_price_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stats.equal_count_bins(table(spark, sf_dir, "orders"), "o_totalprice", 60, ["o_orderstatus"])
    return t.select("o_orderstatus", F.col("bin").cast("long").alias("bin"), F.round("mean", 3).alias("mean"), F.round("weight", 8).alias("weight"))


@register("""SELECT l_returnflag, count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 5) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept,
    round(sqrt((regr_syy(l_extendedprice, l_quantity) - regr_slope(l_extendedprice, l_quantity) * regr_sxy(l_extendedprice, l_quantity)) / (count(*) - 1)), 4) AS sigma FROM lineitem GROUP BY ALL""")
def price_on_quantity_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stats.linear_fit(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"])
    return t.select("l_returnflag", "n", F.round("slope", 5).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("sigma", 4).alias("sigma"))


@register("""WITH p AS (SELECT event_type, value AS v, lag(value) OVER (PARTITION BY event_type ORDER BY ts) AS q FROM events), c AS (SELECT event_type, count(*) AS n, corr(v, q) AS r1 FROM p GROUP BY ALL)
    SELECT event_type, n, round(r1, 6) AS r1, round(n * (1 - r1) / (1 + r1), 3) AS n_eff FROM c""")
def effective_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stats.effective_sample_size(table(spark, sf_dir, "events"), "value", "ts", ["event_type"])
    return t.select("event_type", "n", r6("r1").alias("r1"), F.round("n_eff", 3).alias("n_eff"))


@register()
def embeddings_content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.content_hash(table(spark, sf_dir, "embeddings"), ["vec_id"])


# -- sequences and preparation ------------------------------------------------------------------------------------------------------


@register("""SELECT event_id, lag(value, 1) OVER w AS value_lag_1, lag(value, 3) OVER w AS value_lag_3, round(avg(value) OVER w4, 6) AS value_roll_4_mean, round(stddev_samp(value) OVER w4, 6) AS value_roll_4_std, round(value - lag(value, 1) OVER w, 6) AS value_diff_1
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts), w4 AS (PARTITION BY user_id ORDER BY ts ROWS 3 PRECEDING)""")
def lags_rolling_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    out = windows.add_diffs(windows.add_rolling(windows.add_lags(e, ["value"], [1, 3], ["user_id"]), ["value"], [4], keys=["user_id"]), ["value"], keys=["user_id"])
    return out.select("event_id", "value_lag_1", "value_lag_3", r6("value_roll_4_mean").alias("value_roll_4_mean"), r6("value_roll_4_std").alias("value_roll_4_std"), r6("value_diff_1").alias("value_diff_1"))


@register("""WITH d AS (SELECT event_id, user_id, ts, epoch(date_trunc('second', ts)) - epoch(lag(date_trunc('second', ts)) OVER w) AS g, row_number() OVER w AS i FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    g AS (SELECT *, coalesce((g > 43200)::INT, 0) AS gap FROM d) SELECT event_id, i >= 4 AND sum(gap) OVER (PARTITION BY user_id ORDER BY ts ROWS 2 PRECEDING) = 0 AS is_target FROM g""")
def gap_free_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.sequence_targets(table(spark, sf_dir, "events"), 4, ["user_id"], max_gap_seconds=43_200).select("event_id", "is_target")


@register("""WITH d AS (SELECT event_id, user_id, ts, epoch(date_trunc('second', ts)) - epoch(lag(date_trunc('second', ts)) OVER w) AS g, row_number() OVER w AS i, list(value) OVER (PARTITION BY user_id ORDER BY ts ROWS 3 PRECEDING) AS x, value FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    t AS (SELECT *, i >= 4 AND sum(coalesce((g > 43200)::INT, 0)) OVER (PARTITION BY user_id ORDER BY ts ROWS 2 PRECEDING) = 0 AS ok FROM d)
    SELECT user_id, ts, round(x[1] + 10 * x[2] + 100 * x[3] + 1000 * x[4], 2) AS checksum FROM t WHERE ok""")
def gap_free_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = windows.build_sequences(table(spark, sf_dir, "events"), ["value"], "value", 4, ["user_id"], max_gap_seconds=43_200)
    total = F.aggregate(F.transform("x", lambda r, i: F.round(r[0].cast("double"), 2) * F.pow(F.lit(10.0), i)), F.lit(0.0), lambda a, v: a + v)
    return s.select("user_id", "ts", F.round(total, 2).alias("checksum"))


@register("""SELECT event_id, CASE WHEN k < floor(n * 0.7) THEN 'train' WHEN k < floor(n * 0.7) + floor(n * 0.15) THEN 'val' ELSE 'test' END AS split FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events)""")
def split_by_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.chronological_split(table(spark, sf_dir, "events"), keys=["user_id"]).select("event_id", "split")


@register("""WITH p AS (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS k, floor(count(*) OVER (PARTITION BY user_id) / 4)::BIGINT AS v FROM events)
    SELECT f.fold::BIGINT AS fold, event_id, CASE WHEN k < f.fold * v THEN 'train' ELSE 'val' END AS role FROM p, (SELECT unnest([1, 2, 3]) AS fold) f WHERE k < f.fold * v + v""")
def expanding_window_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.expanding_folds(table(spark, sf_dir, "events"), 3, ["user_id"]).select(F.col("fold").cast("long").alias("fold"), "event_id", "role")


@register("""WITH d AS (SELECT DISTINCT strftime(ts, '%Y%m%d') AS day_id FROM events), p AS (SELECT day_id, row_number() OVER (ORDER BY day_id) - 1 AS k, count(*) OVER () AS n FROM d)
    SELECT day_id, CASE WHEN k < round(n * 0.7) THEN 'train' WHEN k < round(n * 0.7) + 1 THEN NULL WHEN k < round(n * 0.7) + round(n * 0.15) THEN 'val' WHEN k < round(n * 0.7) + round(n * 0.15) + 1 THEN NULL ELSE 'test' END AS split FROM p""")
def split_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.day_split(table(spark, sf_dir, "events"), gap_days=1)


@register("""WITH m AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS v FROM events),
    n AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN ts END IGNORE NULLS) OVER b AS bt, last_value(v IGNORE NULLS) OVER b AS bv, first_value(CASE WHEN v IS NOT NULL THEN ts END IGNORE NULLS) OVER a AS ta, first_value(v IGNORE NULLS) OVER a AS av
          FROM m WINDOW b AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT event_id, round(coalesce(v, bv + (av - bv) * ((epoch_us(ts) - epoch_us(bt)) / nullif(epoch_us(ta) - epoch_us(bt), 0))), 5) AS filled, bv AS ffilled FROM n""")
def gaps_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("v", F.when(F.col("event_id") % 3 != 0, F.col("value"))).withColumn("w", F.col("v"))
    out = windows.ffill(windows.interpolate_time(e, "v", ["user_id"]), ["w"], ["user_id"])
    return out.select("event_id", F.round("v", 5).alias("filled"), F.col("w").alias("ffilled"))


@register("""WITH p AS (SELECT event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events), s AS (SELECT avg(value) AS m, stddev_samp(value) AS d FROM p WHERE k < floor(n * 0.7))
    SELECT event_id, round((value - m) / d, 6) AS value FROM p, s""")
def scaled_by_training_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled, _ = windows.split_and_scale(table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value"), [], "value", ["user_id"])
    return scaled.select("event_id", r6("value").alias("value"))


@register("""SELECT event_id, hour(ts) AS hour, dayofyear(ts) AS day_of_year, month(ts) AS month, isodow(ts) - 1 AS weekday, round(sin(2 * pi() * hour(ts) / 24.0), 6) AS hour_sin, round(cos(2 * pi() * dayofyear(ts) / 365.25), 6) AS doy_cos FROM events""")
def calendar_and_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.cyclic_features(windows.calendar_features(table(spark, sf_dir, "events")))
    ints = [F.col(c).cast("long").alias(c) for c in ("hour", "day_of_year", "month", "weekday")]
    return out.select("event_id", *ints, r6("hour_sin").alias("hour_sin"), r6("doy_cos").alias("doy_cos"))


from . import library, library2, library3, library4, library5, library6  # noqa: E402, F401  they register their queries too
