"""Queries on the observation series, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hydraulics import afflux_ratio, blockage_factor, critical_bf, discharge, relative_label
from ..functions.labels import coverage_label
from ..operators import evaluation, states, timeseries as ts
from ..sources import sensor_csv
from ..sources.scratch import staged
from ..sources.tables import OBSERVATIONS_SQL, epoch_us, observations, table

#: Fixed "now" of the label queries: 2024-02-01T00:00:00Z, in seconds.
NOW_S = 1706745600
WINDOW_S, TRIGGER, GROWN, K = 3 * 86400, 0.2, 0.0005, 2
#: Buckets of the running values: 30 days of the observations, 10**6 seconds of the long series.
WIDTH, LONG_WIDTH = 30 * 86400.0, 1e6
O = OBSERVATIONS_SQL  # noqa: E741


def unique_times(spark, sf_dir):
    """Observations with one row per site and second: the one with the smallest seq."""
    obs = observations(spark, sf_dir)
    return obs.groupBy("site", "ts_s").agg(F.min_by(F.struct("seq", "event_type", "frac"), "seq").alias("m")).select("site", "ts_s", "m.*")


UNIQUE = O + ", uo AS (SELECT * FROM obs QUALIFY row_number() OVER (PARTITION BY site, ts_s ORDER BY seq) = 1)"
GROWTH = (
    UNIQUE
    + f""", anchored AS (
  SELECT *, count(frac) OVER w AS n, first_value(CASE WHEN frac IS NOT NULL THEN ts_s END IGNORE NULLS) OVER w AS t1, first_value(frac IGNORE NULLS) OVER w AS f1,
    last_value(CASE WHEN frac IS NOT NULL THEN ts_s END IGNORE NULLS) OVER p AS t0, last_value(frac IGNORE NULLS) OVER p AS f0
  FROM uo WINDOW w AS (PARTITION BY site ORDER BY ts_s RANGE BETWEEN {WINDOW_S} PRECEDING AND CURRENT ROW), p AS (PARTITION BY site ORDER BY ts_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), grown AS (
  SELECT site, seq, ts_s, frac, CASE WHEN frac IS NOT NULL AND (ts_s - CASE WHEN n >= 2 THEN t1 ELSE t0 END) / 60.0::DOUBLE > 1e-6
    THEN (frac - CASE WHEN n >= 2 THEN f1 ELSE f0 END) / ((ts_s - CASE WHEN n >= 2 THEN t1 ELSE t0 END) / 60.0::DOUBLE) END AS growth_per_min
  FROM anchored
), runs AS (
  SELECT *, CAST(coalesce(frac >= {TRIGGER} OR growth_per_min >= {GROWN}::DOUBLE, false) AS INT) AS hit, sum(1 - CAST(coalesce(frac >= {TRIGGER} OR growth_per_min >= {GROWN}::DOUBLE, false) AS INT)) OVER (PARTITION BY site ORDER BY ts_s) AS run FROM grown
), streaks AS (
  SELECT site, seq, ts_s, frac, growth_per_min, (sum(hit) OVER (PARTITION BY site, run ORDER BY ts_s))::BIGINT AS streak FROM runs
), alerts AS (
  SELECT *, streak >= {K} AS alert, bool_or(streak >= {K}) OVER (PARTITION BY site ORDER BY ts_s) AS latched, streak = {K} AS onset FROM streaks
)"""
)


def grown(spark, sf_dir):
    return ts.growth(unique_times(spark, sf_dir).drop("event_type"), "site", "ts_s", "frac", WINDOW_S, width=WIDTH)


def alerts(spark, sf_dir):
    return ts.alerts(grown(spark, sf_dir), "site", ["ts_s"], "frac", "growth_per_min", TRIGGER, GROWN, K, width=WIDTH)


def operator_verdict(spark, sf_dir):
    last = ts.latest(alerts(spark, sf_dir), "site", ["ts_s", "seq"])
    return last.select("site", "ts_s", "frac", "growth_per_min", "streak", "alert", ts.verdict("frac", "growth_per_min", F.col("alert")).alias("state"), F.when(~F.col("alert"), ts.minutes_to("frac", "growth_per_min")).alias("minutes_to_threshold"))


def alert_rows(spark, sf_dir):
    return alerts(spark, sf_dir).select("site", "seq", "streak", "alert", "latched", "onset")


def growth_anchor(spark, sf_dir):
    return grown(spark, sf_dir).select("site", "seq", "growth_per_min")


def rolling(how):
    def run(spark, sf_dir):
        return ts.rolling_nonnull(observations(spark, sf_dir), "site", ["ts_s", "seq"], "frac", 5, "smoothed", how, WIDTH).select("site", "seq", F.bround("smoothed", 6).alias("smoothed"))

    return run


def rolling_sql(how):
    return f"""WITH {O}, n AS (SELECT *, count(frac) OVER (PARTITION BY site ORDER BY ts_s, seq ROWS UNBOUNDED PRECEDING) AS nn FROM obs)
SELECT site, seq, round_even(CASE WHEN nn > 0 THEN {how}(frac) OVER (PARTITION BY site ORDER BY nn RANGE BETWEEN 4 PRECEDING AND CURRENT ROW) END, 6) AS smoothed FROM n"""


def locf_age(spark, sf_dir):
    obs = observations(spark, sf_dir)
    value = F.when(F.col("event_type") == "purchase", F.col("frac"))
    return ts.carried(obs, "site", ["ts_s", "seq"], value, "ts_s", "carried", "age_s", WIDTH).select("site", "seq", "carried", "age_s")


def segment_reset(spark, sf_dir):
    seg = ts.segments(observations(spark, sf_dir), "site", ["ts_s", "seq"], F.col("event_type") == "signup", width=WIDTH)
    return seg.groupBy("site", "segment").agg(F.count(F.lit(1)).alias("n"), F.count("frac").alias("n_measured"), F.max("frac").alias("max_frac"))


def asof_nearest(spark, sf_dir):
    obs = observations(spark, sf_dir)
    left = obs.where("event_type = 'signup'").select(F.col("seq").alias("left_seq"), F.col("ts_s").alias("left_ts"))
    right = obs.where("event_type = 'click'").select(F.col("seq").alias("right_seq"), F.col("ts_s").alias("right_ts"), F.col("frac").alias("right_frac"))
    return ts.nearest(left, right, "left_ts", "right_ts", "right_seq", 600)


def latest_per_device(spark, sf_dir):
    return ts.latest(observations(spark, sf_dir), "event_type", ["ts_s", "seq"]).select("event_type", "site", "seq", "ts_s", "frac")


def keyed_hours(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", F.floor(epoch_us() / 3600000000).alias("hour"), "event_id", F.round(F.col("value") * 100).cast("bigint").alias("cents"))


def ingest_dedupe(spark, sf_dir):
    rows = keyed_hours(spark, sf_dir)
    return rows.groupBy("user_id", "hour").agg(F.min_by(F.struct("event_id", "cents"), "event_id").alias("m")).select("user_id", "hour", "m.*")


def forecast_upsert(spark, sf_dir):
    rows = keyed_hours(spark, sf_dir)
    return rows.groupBy("user_id", "hour").agg(F.max_by(F.struct("event_id", "cents"), "event_id").alias("m")).select("user_id", "hour", "m.*")


def sensor_lines(spark, sf_dir):
    """Sensor lines made of events: errors measure ``nan``, every 97th line lacks fields."""
    cents = F.round(F.col("value") * 100).cast("bigint").cast("string")
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.floor(epoch_us() / 1000000).cast("string").alias("s"), cents.alias("c"))
    full = F.concat_ws(",", F.lit("t"), "s", "c", F.when(F.col("event_type") == "error", "nan").otherwise(F.col("c")), F.lit("1"), F.lit("5"), F.lit(""), F.lit("0"), F.lit(""), "event_type", F.lit("0"), F.lit("ntp"), F.lit("-60"), F.lit(""))
    return e.select((F.floor(F.col("event_id") / 50)).alias("batch_id"), "event_id", F.when(F.col("event_id") % 97 == 0, "a,b,c").otherwise(full).alias("csv"))


def sensor_csv_parse(spark, sf_dir):
    made = sensor_csv.accepted(sensor_csv.parse(sensor_lines(spark, sf_dir)))
    return made.select("batch_id", "event_id", "ts_epoch", "jarak_cm", "tinggi_cm", "valid", "tip_total", "level", "sms_status")


def rain_rate(spark, sf_dir):
    minutes = table(spark, sf_dir, "events").where("event_type = 'click'").groupBy(F.floor(epoch_us() / 60000000).alias("minute")).agg(F.count(F.lit(1)).alias("tips"))
    return ts.sliding_sum(minutes, "minute", "tips", 10, 1440, "sum").select("minute", "tips", (F.col("sum") * 1.8).alias("rate"))


def forecast_summary(spark, sf_dir):
    hours = (F.floor(epoch_us() / 1000000) - NOW_S) / F.lit(3600.0)
    cents = F.when(F.col("event_type") != "error", F.round(F.col("value") * 100).cast("bigint"))
    made = ts.rain_outlook(table(spark, sf_dir, "events"), "user_id", "event_id", hours, cents, 5000, -240, 2400)
    return made.select("user_id", F.col("total").alias("total_cents"), F.col("rain.at").alias("first_rain"))


def afflux_chain(spark, sf_dir):
    bf = blockage_factor(F.col("frac"), 0.5, 0.25)
    rows = observations(spark, sf_dir).select("seq", bf.alias("bf"))
    return rows.select("seq", "bf", afflux_ratio(F.col("bf")).alias("ratio"), F.round(discharge(F.col("bf"), 2.0, F.lit(0.8)), 6).alias("discharge"), F.round(critical_bf(F.col("bf"), F.lit(1.6)), 6).alias("critical"))


def relative_time_label(spark, sf_dir):
    age = F.lit(NOW_S) - F.floor(epoch_us() / 1000000)
    return table(spark, sf_dir, "events").select("event_id", relative_label(age).alias("label"))


def coverage_labels(spark, sf_dir):
    share = F.when(F.col("event_type") != "error", F.round(F.col("value") * 100).cast("bigint") / F.lit(50000.0))
    return table(spark, sf_dir, "events").select("event_id", coverage_label(share).alias("label"))


def hourly(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.floor(epoch_us() / 3600000000).alias("hour"), "event_type", F.round(F.col("value") * 100).cast("bigint").alias("cents"))
    return e.groupBy("hour").agg(F.count_if(F.col("event_type") == "click").alias("rain"), F.sum("cents").alias("cover"))


def lag_correlation(spark, sf_dir):
    return evaluation.lag_correlation(hourly(spark, sf_dir), "hour", "rain", "cover", 6).withColumn("r", F.round("r", 6))


def rmse_mae(spark, sf_dir):
    from pyspark.sql import Window

    steps = hourly(spark, sf_dir).withColumn("d", F.col("cover") - F.lag("cover").over(Window.orderBy("hour")))  # a row per hour
    return evaluation.errors(steps, F.col("d")).select(F.round("rmse", 6).alias("rmse"), F.round("mae", 6).alias("mae"))


def long_series(spark, sf_dir):
    """lineitem as a long series of measurements: 50 sites, a time of its own for every row, one in three not measured."""
    t = (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("double").alias("ts_s")
    share = F.when(F.col("l_returnflag") != "R", F.col("l_discount") * 5)
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("l_suppkey"), F.min(share).alias("frac"))
    return rows.select((F.col("l_suppkey") % 50).alias("site"), t, "frac")


def series_chain(spark, sf_dir):
    """Rolling median, growth, streak and the nearest order of each row of the long series.

    Each level is a scan in buckets of time, written before the next, which reads it twice.
    """
    made = ts.rolling_nonnull(staged(long_series(spark, sf_dir), "long"), "site", ["ts_s"], "frac", 30, "smoothed", width=LONG_WIDTH)
    made = ts.growth(staged(made, "smoothed"), "site", "ts_s", "frac", 300, width=LONG_WIDTH)
    made = ts.streak(staged(made, "grown"), "site", ["ts_s"], F.col("frac") >= 0.3, width=LONG_WIDTH)
    orders = table(spark, sf_dir, "orders").select((F.col("o_orderkey") * 8 + 5).cast("double").alias("order_ts"), F.col("o_orderkey").alias("order_seq"))
    near = ts.nearest(made, orders, "ts_s", "order_ts", "order_seq", 60)
    return near.select("site", "ts_s", F.round("smoothed", 6).alias("smoothed"), F.round("growth_per_min", 6).alias("growth_per_min"), "streak", "order_seq")


def level_fsm(spark, sf_dir):
    rows = observations(spark, sf_dir).select("site", "seq", "ts_s", (F.col("frac") * 100).alias("height"), F.lit(0.0).alias("rain"))
    return states.levels(rows, "site", "ts_s", "height", "rain", enter=(30.0, 60.0), leave=(25.0, 55.0), dwell=86400.0, seq="seq")


def throttle_sampler(spark, sf_dir):
    return states.throttled(observations(spark, sf_dir).select("site", "seq", "ts_s"), "site", "ts_s", 86400.0, seq="seq")


CENTS = "round(value * 100)::BIGINT"
SECONDS = "floor(epoch_us(ts) / 1000000.0)::BIGINT"
HOUR = "floor(epoch_us(ts) / 3600000000.0)::BIGINT"
LABELS = "CASE WHEN a < 10 THEN 'baru saja' WHEN a < 60 THEN a || ' detik lalu' WHEN a < 3600 THEN a // 60 || ' menit lalu' WHEN a < 86400 THEN a // 3600 || ' jam lalu' ELSE a // 86400 || ' hari lalu' END"
HOURLY = f"h AS (SELECT {HOUR} AS hour, count(*) FILTER (event_type = 'click') AS rain, sum({CENTS})::BIGINT AS cover FROM events GROUP BY 1)"

QUERIES = {
    "operator_verdict": operator_verdict, "alert_streak": alert_rows, "growth_anchor": growth_anchor, "rolling_median_nonnull": rolling("median"), "rolling_mean_nonnull": rolling("mean"),
    "locf_age": locf_age, "segment_reset": segment_reset, "asof_nearest": asof_nearest, "latest_per_device": latest_per_device, "ingest_dedupe": ingest_dedupe, "forecast_upsert": forecast_upsert,
    "sensor_csv_parse": sensor_csv_parse, "rain_rate_sliding": rain_rate, "forecast_summary": forecast_summary, "afflux_chain": afflux_chain, "relative_time_label": relative_time_label,
    "coverage_label": coverage_labels, "lag_correlation": lag_correlation, "rmse_mae": rmse_mae, "level_fsm": level_fsm, "throttle_sampler": throttle_sampler,
    "series_chain": series_chain,
}

LONG = "s AS (SELECT l_suppkey % 50 AS site, (l_orderkey * 8 + l_linenumber)::DOUBLE AS ts_s, frac FROM (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS l_suppkey, min(CASE WHEN l_returnflag <> 'R' THEN l_discount * 5 END) AS frac FROM lineitem GROUP BY 1, 2))"

ORACLES = {
    "series_chain": f"""WITH {LONG}, n AS (
  SELECT *, count(frac) OVER (PARTITION BY site ORDER BY ts_s ROWS UNBOUNDED PRECEDING) AS nn, count(frac) OVER w AS c, first_value(CASE WHEN frac IS NOT NULL THEN ts_s END IGNORE NULLS) OVER w AS t1, first_value(frac IGNORE NULLS) OVER w AS f1,
    last_value(CASE WHEN frac IS NOT NULL THEN ts_s END IGNORE NULLS) OVER p AS t0, last_value(frac IGNORE NULLS) OVER p AS f0, sum(CASE WHEN frac >= 0.3::DOUBLE THEN 0 ELSE 1 END) OVER (PARTITION BY site ORDER BY ts_s ROWS UNBOUNDED PRECEDING) AS run
  FROM s WINDOW w AS (PARTITION BY site ORDER BY ts_s RANGE BETWEEN 300 PRECEDING AND CURRENT ROW), p AS (PARTITION BY site ORDER BY ts_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), a AS (
  SELECT site, ts_s, round(CASE WHEN nn > 0 THEN median(frac) OVER (PARTITION BY site ORDER BY nn RANGE BETWEEN 29 PRECEDING AND CURRENT ROW) END, 6) AS smoothed,
    CASE WHEN frac IS NOT NULL AND (ts_s - CASE WHEN c >= 2 THEN t1 ELSE t0 END) / 60.0::DOUBLE > 1e-6 THEN round((frac - CASE WHEN c >= 2 THEN f1 ELSE f0 END) / ((ts_s - CASE WHEN c >= 2 THEN t1 ELSE t0 END) / 60.0::DOUBLE), 6) END AS growth_per_min,
    (sum(CASE WHEN frac >= 0.3::DOUBLE THEN 1 ELSE 0 END) OVER (PARTITION BY site, run ORDER BY ts_s))::BIGINT AS streak FROM n
), o AS (SELECT (o_orderkey * 8 + 5)::DOUBLE AS order_ts, o_orderkey AS order_seq FROM orders),
near AS (
  SELECT a.site, a.ts_s, o.order_seq FROM a JOIN o ON o.order_ts BETWEEN a.ts_s - 60 AND a.ts_s + 60 QUALIFY row_number() OVER (PARTITION BY a.site, a.ts_s ORDER BY abs(a.ts_s - o.order_ts), o.order_ts, o.order_seq) = 1
)
SELECT a.*, near.order_seq FROM a LEFT JOIN near USING (site, ts_s)""",
    "operator_verdict": f"""WITH {GROWTH}
SELECT site, ts_s, frac, growth_per_min, streak, alert, CASE WHEN frac IS NULL THEN 'unknown' WHEN alert OR frac >= 0.18::DOUBLE THEN 'blocked' WHEN coalesce(growth_per_min, 0) > 0 THEN 'watch' ELSE 'clear' END AS state,
  CASE WHEN NOT alert AND growth_per_min > 0 AND frac < 0.18::DOUBLE THEN (0.18::DOUBLE - frac) / growth_per_min END AS minutes_to_threshold
FROM alerts QUALIFY row_number() OVER (PARTITION BY site ORDER BY ts_s DESC, seq DESC) = 1""",
    "alert_streak": f"WITH {GROWTH} SELECT site, seq, streak, alert, latched, onset FROM alerts",
    "growth_anchor": f"WITH {GROWTH} SELECT site, seq, growth_per_min FROM grown",
    "rolling_median_nonnull": rolling_sql("median"),
    "rolling_mean_nonnull": rolling_sql("avg"),
    "locf_age": f"""WITH {O} SELECT site, seq, last_value(CASE WHEN event_type = 'purchase' THEN frac END IGNORE NULLS) OVER w AS carried,
  ts_s - last_value(CASE WHEN event_type = 'purchase' AND frac IS NOT NULL THEN ts_s END IGNORE NULLS) OVER w AS age_s
FROM obs WINDOW w AS (PARTITION BY site ORDER BY ts_s, seq ROWS UNBOUNDED PRECEDING)""",
    "segment_reset": f"""WITH {O}, s AS (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY site ORDER BY ts_s, seq ROWS UNBOUNDED PRECEDING)::BIGINT AS segment FROM obs)
SELECT site, segment, count(*) AS n, count(frac) AS n_measured, max(frac) AS max_frac FROM s GROUP BY 1, 2""",
    "asof_nearest": f"""WITH {O}, l AS (SELECT seq AS left_seq, ts_s AS left_ts FROM obs WHERE event_type = 'signup'), r AS (SELECT seq AS right_seq, ts_s AS right_ts, frac AS right_frac FROM obs WHERE event_type = 'click')
SELECT left_seq, left_ts, right_seq, right_ts, right_frac FROM l LEFT JOIN r ON abs(left_ts - right_ts) <= 600 QUALIFY row_number() OVER (PARTITION BY left_seq ORDER BY abs(left_ts - right_ts), right_ts, right_seq) = 1""",
    "throttle_sampler": f"""WITH RECURSIVE {O}, r AS (SELECT site, seq, ts_s, row_number() OVER (PARTITION BY site ORDER BY ts_s, seq) AS rn FROM obs),
f AS (SELECT site, seq, ts_s, rn, ts_s AS last, true AS kept FROM r WHERE rn = 1
  UNION ALL SELECT r.site, r.seq, r.ts_s, r.rn, CASE WHEN r.ts_s - f.last >= 86400 THEN r.ts_s ELSE f.last END, r.ts_s - f.last >= 86400 FROM f JOIN r ON r.site = f.site AND r.rn = f.rn + 1)
SELECT site, seq, ts_s FROM f WHERE kept""",
    "level_fsm": f"""WITH RECURSIVE {O}, r AS (SELECT site, seq, ts_s, frac * 100 AS height, row_number() OVER (PARTITION BY site ORDER BY ts_s, seq) AS rn FROM obs),
f AS (SELECT site, rn, seq, ts_s, height, CASE WHEN height > 60 THEN 2 WHEN height > 30 THEN 1 ELSE 0 END AS now, NULL::DOUBLE AS low FROM r WHERE rn = 1
  UNION ALL SELECT site, rn, seq, ts_s, height,
    CASE WHEN height IS NULL THEN was WHEN up > was THEN up WHEN was = 0 OR height >= edge THEN was WHEN ts_s - coalesce(low, ts_s) >= 86400 THEN was - 1 ELSE was END,
    CASE WHEN height IS NULL THEN low WHEN up > was OR was = 0 OR height >= edge THEN NULL WHEN ts_s - coalesce(low, ts_s) >= 86400 THEN NULL ELSE coalesce(low, ts_s) END
  FROM (SELECT r.*, f.now AS was, f.low, CASE WHEN r.height > 60 THEN 2 WHEN r.height > 30 THEN 1 ELSE 0 END AS up, CASE f.now WHEN 1 THEN 25 ELSE 55 END AS edge FROM f JOIN r ON r.site = f.site AND r.rn = f.rn + 1) s)
SELECT site, seq, ts_s, height, 0::DOUBLE AS rain, CASE now WHEN 0 THEN 'AMAN' WHEN 1 THEN 'WASPADA' ELSE 'BAHAYA' END AS level FROM f""",
    "latest_per_device": f"WITH {O} SELECT event_type, site, seq, ts_s, frac FROM obs QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts_s DESC, seq DESC) = 1",
    "ingest_dedupe": f"SELECT user_id, {HOUR} AS hour, event_id, {CENTS} AS cents FROM events QUALIFY row_number() OVER (PARTITION BY user_id, hour ORDER BY event_id) = 1",
    "forecast_upsert": f"SELECT user_id, {HOUR} AS hour, event_id, {CENTS} AS cents FROM events QUALIFY row_number() OVER (PARTITION BY user_id, hour ORDER BY event_id DESC) = 1",
    "sensor_csv_parse": f"""WITH b AS (SELECT *, event_id // 50 AS batch_id, bool_or(event_id % 97 = 0) OVER (PARTITION BY event_id // 50) AS bad FROM events)
SELECT batch_id, event_id, {SECONDS} AS ts_epoch, {CENTS}::DOUBLE AS jarak_cm, CASE WHEN event_type <> 'error' THEN {CENTS}::DOUBLE END AS tinggi_cm, 1 AS valid, NULL::BIGINT AS tip_total, event_type AS level, NULL::VARCHAR AS sms_status FROM b WHERE NOT bad""",
    "rain_rate_sliding": """WITH m AS (SELECT floor(epoch_us(ts) / 60000000.0)::BIGINT AS minute, count(*) AS tips FROM events WHERE event_type = 'click' GROUP BY 1)
SELECT minute, tips, sum(tips) OVER (ORDER BY minute RANGE BETWEEN 9 PRECEDING AND CURRENT ROW)::DOUBLE * 1.8::DOUBLE AS rate FROM m""",
    "forecast_summary": f"""SELECT user_id, (sum({CENTS}) FILTER (ok))::BIGINT AS total_cents, min(event_id) FILTER (ok AND {CENTS} >= 5000) AS first_rain FROM (SELECT *, event_type <> 'error' AND ({SECONDS} - {NOW_S}) / 3600.0::DOUBLE BETWEEN -240 AND 2400 AS ok FROM events) e GROUP BY 1""",
    "afflux_chain": f"""WITH {O}, b AS (SELECT seq, frac * 0.5::DOUBLE + 0.25::DOUBLE AS bf FROM obs)
SELECT seq, bf, CASE WHEN bf < 0.85::DOUBLE THEN 1 / ((1 - bf) * (1 - bf)) END AS ratio, round(0.61::DOUBLE * 2 * (1 - bf) * sqrt(2 * 9.81::DOUBLE * 0.8::DOUBLE), 6) AS discharge, round(CASE WHEN bf > 0 AND bf < 1.6::DOUBLE THEN 1 - sqrt(bf / 1.6::DOUBLE) END, 6) AS critical FROM b""",
    "relative_time_label": f"SELECT event_id, {LABELS} AS label FROM (SELECT event_id, {NOW_S} - {SECONDS} AS a FROM events)",
    "coverage_label": f"SELECT event_id, CASE WHEN event_type = 'error' THEN 'tidak terukur' ELSE replace(round(c::VARCHAR::DECIMAL(30, 17), 1)::DECIMAL(10, 1)::VARCHAR, '.', ',') || '%' END AS label FROM (SELECT event_id, event_type, {CENTS} / 50000::DOUBLE * 100 AS c FROM events) e",
    "lag_correlation": f"WITH {HOURLY} SELECT lag, round(corr(a.rain, b.cover), 6) AS r, count(*) AS n FROM h a, (SELECT unnest(range(0, 7))::INT AS lag) JOIN h b ON b.hour = a.hour + lag GROUP BY 1",
    "rmse_mae": f"WITH {HOURLY}, d AS (SELECT cover - lag(cover) OVER (ORDER BY hour) AS d FROM h) SELECT round(sqrt(sum(d::HUGEINT * d)::DOUBLE / count(d)), 6) AS rmse, round(sum(abs(d))::DOUBLE / count(d), 6) AS mae FROM d",
}
