"""Queries on measurements, device records and label texts: the library's operators on the test tables, as in ``datasets``."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry, hydraulics, labels
from ..functions.labels import DAYS, MONTHS
from ..operators import evaluation, fill, frames, masks, ranks, splits, timeseries as ts, validation
from ..sources import sinks
from ..sources.tables import epoch_us
from .datasets import duck, on

_SPLIT = "SELECT lang, doc_id, CASE WHEN doc_id % 10 < 7 THEN 'train' WHEN doc_id % 10 < 8 THEN 'val' ELSE 'test' END AS split FROM {documents}"
_STEPS = "SELECT p_size, p_retailprice, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS rn FROM {part}"
_EPOCHS = "SELECT o_custkey, o_orderkey, o_totalprice AS score, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS epoch, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM {orders}"
_BAD = f"SELECT o_custkey, epoch, score, sum(CASE WHEN best IS NULL OR score > best THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY epoch) AS since FROM ({_EPOCHS}) e"
_HOURS = "SELECT event_id, (event_id % 4000) / cast(100 AS double) - 2 AS hours FROM {events}"



def _corners_sql(first: int, n: int, width: int, height: int) -> str:
    """Corners on whole pixels as a list of structs, as ``_corner_columns`` makes them."""
    at = lambda i, most: f"floor(abs(embedding[{i + 1}]::DOUBLE) * 1000)::BIGINT % {most}"
    return "[" + ", ".join(f"{{'x': {at(first + i, width)}, 'y': {at(first + n + i, height)}}}" for i in range(n)) + "]"


#: Every pixel of a frame of 24 x 16 against every edge of a shape.
PIXELS = "px AS (SELECT i, i % 24 AS x, i // 24 AS y FROM range(384) AS r(i))"
INSIDE = """edges AS (SELECT vec_id, slot, c[k] AS a, c[k % len(c) + 1] AS b FROM (SELECT *, unnest(range(1, len(c) + 1)) AS k FROM s)),
hits AS (SELECT vec_id, slot, i, (b.x - a.x) * (y - a.y) = (b.y - a.y) * (x - a.x) AND x BETWEEN least(a.x, b.x) AND greatest(a.x, b.x) AND y BETWEEN least(a.y, b.y) AND greatest(a.y, b.y) AS on_edge,
  (a.y > y) <> (b.y > y) AND (x - a.x) * abs(b.y - a.y) < (b.x - a.x) * (y - a.y) * sign(b.y - a.y) AS crossed FROM edges, px),
q AS (SELECT vec_id, slot, i FROM hits GROUP BY 1, 2, 3 HAVING bool_or(on_edge) OR count(*) FILTER (crossed) % 2 = 1)"""

#: What each query gives, in SQL.
SQL = {
    # order of the record's columns is fixed; what the source lacks is null
    "fixed_columns": "SELECT event_id AS seq, user_id AS site, concat(replace(substring(cast(ts AS string), 1, 19), ' ', 'T'), 'Z') AS ts_utc, CASE WHEN event_type <> 'error' THEN value END AS measured, cast(NULL AS double) AS head_m FROM {events}",
    "csv_record": "SELECT event_id, concat_ws(',', cast(event_id AS string), cast(user_id AS string), CASE WHEN event_type = 'error' THEN '' ELSE event_type END, '') AS line FROM {events}",
    "path_fallback": "SELECT n.n_nationkey, coalesce(e.n_nationkey, b.k) AS resolved FROM {nation} n LEFT JOIN (SELECT n_name, n_nationkey FROM {nation} WHERE n_nationkey % 2 = 0) e ON n.n_name = e.n_name LEFT JOIN (SELECT substring(n_name, 1, 1) AS base, min(n_nationkey) AS k FROM {nation} GROUP BY substring(n_name, 1, 1) HAVING count(*) = 1) b ON substring(n.n_name, 1, 1) = b.base",
    "candidate_priority": "SELECT o_custkey, o_orderkey, o_orderpriority FROM (SELECT o_custkey, o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) AS rn FROM {orders}) c WHERE rn = 1",
    "checkpoint_status": "SELECT p.page_id, CASE WHEN p.page_id % 5 = 0 THEN 'NOT_EVALUATED' WHEN l.doc_id IS NULL THEN 'PENDING' ELSE 'DONE' END AS status FROM {pages} p LEFT JOIN {labels} l ON p.page_id = l.doc_id",
    "video_summary": "SELECT user_id, round(avg(v), 6) AS mean, median(v) AS med, min(v) AS least, max(v) AS most, count(*) - count(v) AS unmeasurable FROM (SELECT user_id, CASE WHEN event_type <> 'error' THEN value END AS v FROM {events}) e GROUP BY user_id",
    "exposure_sweep": f"SELECT p_size, d FROM (SELECT p_size, abs(p_retailprice - 1000) AS d, row_number() OVER (ORDER BY abs(p_retailprice - 1000), p_size) AS best FROM ({_STEPS}) s WHERE rn = 1) t WHERE best = 1",
    "split_deviation": f"SELECT lang, split, n, dev, dev > 0.15 AS warned FROM (SELECT lang, split, n, round(abs(n / cast(sum(n) OVER (PARTITION BY lang) AS double) - CASE split WHEN 'train' THEN cast(0.7 AS double) WHEN 'val' THEN cast(0.15 AS double) ELSE cast(0.15 AS double) END), 9) AS dev FROM (SELECT lang, split, count(*) AS n FROM ({_SPLIT}) s GROUP BY lang, split) c) d",
    "instance_union": "SELECT l_orderkey, count(DISTINCT l_partkey) AS union_px, count(*) AS instance_px FROM {lineitem} GROUP BY l_orderkey",
    "totals_by_kind": "SELECT event_type AS kind, user_id % 5 AS source, sum(cast(round(value * 100) AS bigint)) AS total FROM {events} GROUP BY event_type, user_id % 5",
    "trapezoid_volume": "SELECT l_orderkey, round(sum((a + a0) / 2 * (h - h0)), 4) AS volume FROM (SELECT l_orderkey, l_quantity AS a, cast(l_linenumber AS double) AS h, lag(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS a0, lag(cast(l_linenumber AS double)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS h0 FROM {lineitem}) s GROUP BY l_orderkey",
    "soft_dice": "SELECT l_returnflag, round(1 - 2 * sum(l_discount * y) / (sum(l_discount) + sum(y)), 9) AS loss FROM (SELECT l_returnflag, l_discount, CASE WHEN l_linestatus = 'O' THEN cast(1.0 AS double) ELSE cast(0.0 AS double) END AS y FROM {lineitem}) s GROUP BY l_returnflag HAVING sum(y) > 0",
    "early_stopping": f"SELECT o_custkey, max(score) AS best, min(CASE WHEN bad >= 3 THEN epoch END) AS stop_epoch, count(*) AS epochs FROM (SELECT o_custkey, epoch, score, row_number() OVER (PARTITION BY o_custkey, since ORDER BY epoch) - 1 AS bad FROM ({_BAD}) b) s GROUP BY o_custkey",
    "hour_median": "SELECT user_id, substring(cast(ts AS string), 1, 13) AS hour, median(value) AS med FROM {events} GROUP BY user_id, substring(cast(ts AS string), 1, 13)",
    "vocabulary_slots": "SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS slot FROM (SELECT DISTINCT p_brand FROM {part}) p",
    "key_uniqueness": "SELECT count(*) = count(DISTINCT event_id) AS unique_ids, count(*) = count(DISTINCT user_id) AS unique_sites FROM {events}",
    "area_flux": "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_tax <> 0 THEN round(l_discount * l_tax * l_quantity, 6) END AS flux, CASE WHEN l_tax = 0 THEN 'n/a' WHEN l_returnflag = 'N' THEN 'm2/s' ELSE 'relative_index' END AS units FROM {lineitem}",
    "degenerate_boxes": "SELECT l_orderkey, count(*) AS kept FROM {lineitem} WHERE NOT (l_quantity <= 10 OR l_extendedprice <= 10000) GROUP BY l_orderkey",
    "clipping": "SELECT p_brand, avg(CASE WHEN p_size >= 45 THEN cast(1.0 AS double) ELSE cast(0.0 AS double) END) > 0.02 AS clipped FROM {part} GROUP BY p_brand",
    "one_of_two": "SELECT p.page_id, (p.url IS NULL) = (d.text IS NULL) AS broken FROM {pages} p LEFT JOIN {documents} d ON p.page_id = d.doc_id",
    "sample_ids": "SELECT page_id, replace(url, '/', '__') AS sample_id, count(*) OVER (PARTITION BY replace(url, '/', '__')) > 1 AS ambiguous FROM {pages}",
    "reconnect_delay": "SELECT n_nationkey, least(cast(30 AS double), power(cast(2 AS double), least(greatest(n_nationkey, 1) - 1, 32))) AS delay_s FROM {nation}",
    "alert_reason": "SELECT l_orderkey, l_linenumber, l_partkey, concat_ws('; ', CASE WHEN l_discount >= 0.05 THEN concat('area ', printf('%.2f', l_discount), ' >= 0.05') END, CASE WHEN l_tax >= 0.04 THEN concat('growth ', printf('%.3f', l_tax), '/min >= 0.04') END) AS reason FROM {lineitem}",
    "until_label": f"SELECT event_id, CASE WHEN hours <= 0 THEN 'sedang berlangsung' WHEN hours < 1 THEN concat(cast(cast(greatest(1, floor(hours * 60 + 0.5)) AS bigint) AS string), ' menit lagi') ELSE concat(cast(cast(floor(hours + 0.5) AS bigint) AS string), ' jam lagi') END AS label FROM ({_HOURS}) h",
    "hydraulics_summary": "SELECT event_id, bf, bf >= cast(0.85 AS double) AS beyond_model, CASE WHEN bf < cast(0.85 AS double) THEN round(cast(1.2 AS double) / ((1 - bf) * (1 - bf)), 6) END AS head_m, CASE WHEN bf < cast(0.85 AS double) THEN round(cast(2 AS double) - cast(1.2 AS double) / ((1 - bf) * (1 - bf)), 6) END AS margin_m FROM (SELECT event_id, least(cast(1 AS double), value / 600) AS bf FROM {events} WHERE value IS NOT NULL) e",
    "share_findings": "SELECT lang AS scope, 'error' AS level FROM (SELECT lang, avg(CASE WHEN n_chars > 30000 THEN cast(1 AS double) ELSE cast(0 AS double) END) AS debris FROM {documents} GROUP BY lang) s WHERE debris < cast(0.00001 AS double)",
    "failure_kinds": "SELECT event_type AS kind, count(*) AS n FROM {events} WHERE event_type <> 'view' GROUP BY event_type",
    "prefixed_scores": "SELECT lang, avg(n_chars) AS val_mean, max(n_chars) AS val_most FROM {documents} GROUP BY lang",
    "resized_frames": "SELECT p_partkey, cast(greatest(1, round(p_size * cast(100 AS double) / greatest(p_size, 7))) AS int) AS w, cast(greatest(1, round(7 * cast(100 AS double) / greatest(p_size, 7))) AS int) AS h FROM {part}",
    "until_time": "SELECT event_id, CASE WHEN s <= 0 THEN 'sedang berlangsung' WHEN s < 3600 THEN concat('dalam ', cast(cast(greatest(1, floor(s / cast(60 AS double) + 0.5)) AS bigint) AS string), ' menit') WHEN floor(s / cast(3600 AS double) + 0.5) < 24 THEN concat('dalam ', cast(cast(floor(s / cast(3600 AS double) + 0.5) AS bigint) AS string), ' jam') ELSE concat('dalam ', cast(cast(floor(floor(s / cast(3600 AS double) + 0.5) / 24 + 0.5) AS bigint) AS string), ' hari') END AS label FROM (SELECT event_id, (event_id % 4000) * 90 - 300 AS s FROM {events}) e",
    "forecast_horizon": f"SELECT event_id, hours FROM ({_HOURS}) h WHERE hours BETWEEN -3 AND 24",
}

_list = lambda xs: ", ".join(f"'{x}'" for x in xs)
_Q = (0.05, 0.25, 0.5, 0.75, 0.95)

#: As above, in DuckDB only.
DUCK = {
    "frame_metrics": "SELECT vec_id, d AS debris_px, w AS water_px, a AS accumulation_px, CASE WHEN d + w > 0 THEN d / (d + w)::DOUBLE END AS coverage, a / 12::DOUBLE AS accumulation_frac FROM (SELECT vec_id, len(list_filter(m, lambda x, i: x > 0.1 AND i % 3 <> 0)) AS d, len(list_filter(m, lambda x, i: x > 0 AND x <= 0.1 AND i % 3 <> 0)) AS w, len(list_filter(m, lambda x, i: x > 0.1 AND i % 3 <> 0 AND i <= 18)) AS a FROM (SELECT vec_id, embedding AS m FROM embeddings) e) f",
    "velocity_median": "SELECT event_id, round_even(CASE WHEN nn > 0 THEN median(v) OVER (PARTITION BY user_id ORDER BY nn RANGE BETWEEN 14 PRECEDING AND CURRENT ROW) END, 3) AS velocity_px_s FROM (SELECT *, count(v) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS nn FROM (SELECT event_id, user_id, ts, CASE WHEN event_type <> 'error' THEN value END AS v FROM events) e) f",
    "utc_texts": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS ts_utc, epoch_us(date_trunc('second', ts)) // 1000000 AS back_s, strftime(ts, '%H:%M:%S') AS clock FROM events",
    "polygon_masks": f"""WITH {PIXELS}, s AS (SELECT vec_id, 1 AS slot, {_corners_sql(0, 8, 24, 16)} AS c FROM embeddings), {INSIDE}
SELECT e.vec_id, count(q.i) AS inside_px, coalesce(sum(q.i), 0)::BIGINT AS places, 384 AS px FROM embeddings e LEFT JOIN q USING (vec_id) GROUP BY e.vec_id""",
    "painted_shapes": f"""WITH {PIXELS}, s AS (SELECT vec_id, 1 AS slot, {_corners_sql(0, 8, 24, 16)} AS c FROM embeddings UNION ALL SELECT vec_id, 2, {_corners_sql(16, 3, 24, 16)} FROM embeddings UNION ALL SELECT vec_id, 3, {_corners_sql(24, 5, 24, 16)} FROM embeddings), {INSIDE},
top AS (SELECT vec_id, i, max(CASE slot WHEN 1 THEN 3 WHEN 3 THEN 2 ELSE 1 END) AS r FROM q GROUP BY 1, 2)
SELECT e.vec_id, 384 - count(r) AS n0, count(*) FILTER (r = 3) AS n1, count(*) FILTER (r = 1) AS n2, count(*) FILTER (r = 2) AS n3 FROM embeddings e LEFT JOIN top USING (vec_id) GROUP BY e.vec_id""",
    "polygon_reasons": """WITH p AS (SELECT vec_id, list_transform(embedding, lambda x: round(x::DOUBLE + 0.5::DOUBLE, 3)) AS e FROM embeddings),
r AS (SELECT vec_id, e, len(list_filter(e[1:8], lambda x: x < 0 OR x > 1)) > 0 AS out1, abs(e[1]*e[4] - e[3]*e[2] + e[3]*e[6] - e[5]*e[4] + e[5]*e[8] - e[7]*e[6] + e[7]*e[2] - e[1]*e[8]) / 2 AS a1,
  len(list_filter(e[9:14], lambda x: x < 0 OR x > 1)) > 0 AS out2, abs(e[9]*e[12] - e[11]*e[10] + e[11]*e[14] - e[13]*e[12] + e[13]*e[10] - e[9]*e[14]) / 2 AS a2 FROM p)
SELECT vec_id, CASE WHEN out1 THEN 'roi: koordinat harus di antara 0 dan 1' WHEN a1 < 1e-4::DOUBLE THEN 'roi: luas nyaris nol -- titik segaris?' WHEN vec_id % 5 = 0 THEN 'structure: bukan larik' WHEN vec_id % 5 = 1 THEN 'structure: minimal 3 titik'
  WHEN vec_id % 5 = 2 THEN 'structure: luas nyaris nol -- titik segaris?' WHEN vec_id % 5 = 3 THEN 'structure: koordinat harus angka' WHEN out2 THEN 'structure: koordinat harus di antara 0 dan 1' WHEN a2 < 1e-4::DOUBLE THEN 'structure: luas nyaris nol -- titik segaris?' END AS reason FROM r""",
    "coverage_errors": "SELECT event_type, avg(abs(a - b)) AS mae, max(abs(a - b)) AS max_error, count(a - b) AS n FROM (SELECT event_type, CASE WHEN event_id % 7 > 0 THEN event_id % 11 END AS a, CASE WHEN event_id % 5 > 0 THEN event_id % 3 END AS b FROM events) e GROUP BY event_type",
    "latest_pair": "SELECT (SELECT max({'t': ts, 'id': event_id}).id FROM events WHERE event_type = 'click') AS sensor, (SELECT max({'t': ts, 'id': event_id}).id FROM events WHERE event_type = 'view') AS camera",
    "motion_vectors": "SELECT label, count(*) AS n FROM embeddings WHERE sqrt(pow(embedding[1]::DOUBLE, 2) + pow(embedding[2]::DOUBLE, 2)) > 0.1::DOUBLE AND embedding[3] > 0 GROUP BY label",
    "ultrasonic_gate": "SELECT user_id, CASE WHEN n = 0 THEN 'timeout' WHEN d < 20 THEN 'too_close' WHEN d > 120 THEN 'out_of_range' ELSE 'ok' END AS state, CASE WHEN n > 0 AND d BETWEEN 20 AND 120 THEN greatest(0::DOUBLE, 100 - d) END AS height FROM (SELECT user_id, count(v) AS n, list_sort(list(v) FILTER (v IS NOT NULL))[count(v) // 2 + 1] AS d FROM (SELECT user_id, CASE WHEN event_type <> 'error' THEN value END AS v FROM events) e GROUP BY user_id) b",
    "latency_quantiles": "SELECT l_linestatus, n, s[1] AS least, s[least(n - 1, floor(0.5::DOUBLE * n)::INT) + 1] AS p50, s[least(n - 1, floor(0.95::DOUBLE * n)::INT) + 1] AS p95, s[n] AS most FROM (SELECT l_linestatus, count(*)::INT AS n, list_sort(list(l_quantity)) AS s FROM lineitem GROUP BY l_linestatus) a",
    "area_percentiles": "SELECT lang, " + ", ".join(f"round(quantile_cont(n_chars, {q}), 6) AS p{round(100 * q)}" for q in _Q) + " FROM documents GROUP BY lang",
    "frame_intervals": "SELECT event_id, greatest(1e-6::DOUBLE, coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1e6::DOUBLE, 0.1::DOUBLE)) AS dt_s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "polling_gaps": "SELECT user_id, sum(CASE WHEN gap < 0 THEN 1 ELSE 0 END) AS backward, max(gap) AS longest FROM (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY event_id) AS gap FROM events) g GROUP BY user_id",
    "stale_sources": "SELECT user_id, (epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(max(ts))) / 6e7::DOUBLE > 20 AS stale FROM events GROUP BY user_id",
    "date_label": f"SELECT o_orderkey, concat([{_list(DAYS)}][dayofweek(o_orderdate) + 1], ', ', day(o_orderdate)::VARCHAR, ' ', [{_list(MONTHS)}][month(o_orderdate)], ' ', year(o_orderdate)::VARCHAR) AS label FROM orders",
    "run_length_mask": "SELECT doc_id, coalesce(list_sum(m), 0)::BIGINT AS area, len(m) AS px FROM (SELECT doc_id, list_concat(list_resize([]::INT[], doc_id % 7, 0), list_resize([]::INT[], doc_id % 5, 1), list_resize([]::INT[], doc_id % 3, 0), list_resize([]::INT[], doc_id % 2, 1)) AS m FROM documents) r",
    "live_sources": "SELECT page_id, regexp_matches(url, '^[0-9]+$') OR instr(url, '://') > 0 AS live FROM pages",
    "colour_keys": "SELECT p_partkey, split(k, ',')[1]::INT * 65536 + split(k, ',')[2]::INT * 256 + split(k, ',')[3]::INT AS rgb FROM (SELECT p_partkey, concat_ws(',', (p_partkey % 256)::VARCHAR, p_size::VARCHAR, '7') AS k FROM part) c",
    "notifications": "SELECT doc_id, array_to_string(list_filter([CASE WHEN toxic = 1 THEN 'blocked' END, CASE WHEN quality = 0 THEN 'watch' END, CASE WHEN doc_id % 4 = 0 THEN 'stale' END], lambda x: x IS NOT NULL), ',') AS notes FROM labels",
}



def _values(t):
    """Events with ``v``, the value that was measured; errors measure none."""
    return t("events").withColumn("v", F.when(F.col("event_type") != "error", F.col("value")))


def _cents(c="value"):
    return F.round(F.col(c) * 100).cast("bigint")


def _fixed_columns(t):
    rows = _values(t).select(F.col("event_id").alias("seq"), F.col("user_id").alias("site"), (epoch_us() / 1000000).alias("ts_epoch"), F.col("v").alias("measured"))
    return sinks.fixed_columns(rows, ("seq", "site", "ts_utc", "measured", "head_m"), {"head_m": "double", "ts_utc": "string"})


def _resolved(t):
    base = F.substring("n_name", 1, 1)
    files = t("nation").select(F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise(F.concat(F.lit("/"), "n_name")).alias("path"), base.alias("base"), F.col("n_nationkey").alias("k"))
    made = splits.resolved(t("nation").select("n_nationkey", F.col("n_name").alias("path"), base.alias("base")), files.select("path", "base"), "path", "base", strict=False)
    return made.join(files.select(F.col("path").alias("resolved"), "k"), "resolved", "left").select("n_nationkey", F.col("k").alias("resolved"))


def _split_deviation(t):
    part = F.col("doc_id") % 10
    rows = t("documents").select("lang", F.when(part < 7, "train").when(part < 8, "val").otherwise("test").alias("split"))
    return splits.split_deviation(rows, "lang", {"train": 0.7, "val": 0.15, "test": 0.15}).where("NOT empty").drop("empty")


def _exposures(t):
    return frames.exposure_choice(t("part"), "p_size", ["p_partkey"], "p_retailprice", 1000.0)


def _rates(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_discount", "l_quantity", "l_tax", "l_returnflag")


def _area_flux(t):
    f = hydraulics.area_flux(F.col("l_discount"), F.nullif(F.col("l_tax"), F.lit(0.0)), F.col("l_quantity"), F.col("l_returnflag") == "N")
    return _rates(t).withColumn("f", f).select("l_orderkey", "l_linenumber", "l_partkey", "f.flux", "f.units")


def _soft_dice(t):
    made = evaluation.soft_dice(t("lineitem"), ["l_returnflag"], F.col("l_discount"), F.when(F.col("l_linestatus") == "O", 1.0).otherwise(0.0))
    return made.select("l_returnflag", F.round("loss", 9).alias("loss"))


def _hours(t):
    return t("events").select("event_id", ((F.col("event_id") % 4000) / F.lit(100.0) - 2).alias("hours"))


def _motion(t):
    e = lambda i: F.get("embedding", F.lit(i)).cast("double")
    rows = t("embeddings").select("label", e(0).alias("u"), e(1).alias("v"), F.get("embedding", F.lit(2)).alias("w"))
    return frames.moving(rows, "u", "v", F.col("w") > 0, 0.1).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def _latency(t):
    picks = {"least": ranks.first, "p50": ranks.at_share(0.5), "p95": ranks.at_share(0.95), "most": ranks.last}
    return ranks.nearest_ranks(t("lineitem"), ["l_linestatus"], "l_quantity", picks)


def _percentiles(t):
    made = ranks.percentiles(t("documents"), ["lang"], "n_chars", {f"p{round(100 * q)}": q for q in _Q})
    return made.select("lang", *[F.round(c, 6).alias(c) for c in made.columns if c not in ("lang", "n")])


def _intervals(t):
    return frames.intervals(t("events").withColumn("s", epoch_us()), "user_id", ["ts", "event_id"], F.col("s"), 0.1).select("event_id", "dt_s")


def _run_lengths(t):
    counts = F.array(*[F.col("doc_id") % k for k in (7, 5, 3, 2)])
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    px = F.coalesce(masks.run_mask(counts, F.lit(1), total.cast("int")), F.array().cast("array<int>"))
    return t("documents").select("doc_id", F.aggregate(px, F.lit(0), lambda a, x: a + x).alias("area"), F.size(px).alias("px"))


def _stale(t):
    now = F.lit(1706745600 * 1000000)
    last = t("events").groupBy("user_id").agg(F.max(epoch_us()).alias("at"))
    return last.select("user_id", labels.stale((now - F.col("at")) / F.lit(1e6)).alias("stale"))


def _gaps(t):
    return validation.polling_gaps(t("events").withColumn("at", epoch_us()), "user_id", "event_id", F.col("at"))


def _notes(t):
    rules = {"blocked": F.col("toxic") == 1, "watch": F.col("quality") == 0, "stale": F.col("doc_id") % 4 == 0}
    return t("labels").select("doc_id", F.array_join(labels.notifications(rules), ",").alias("notes"))


def _early(t):
    return evaluation.early_stop(t("orders"), ["o_custkey"], "o_orderkey", "o_totalprice", 3)


def _summary(t):
    gate = hydraulics.gate_summary(F.col("value") / 600, 1.2, 2.0, 1.5, 0.8)
    made = t("events").where("value IS NOT NULL").select("event_id", gate.alias("g"))
    return made.select("event_id", "g.bf", "g.beyond_model", F.round("g.head_m", 6).alias("head_m"), F.round("g.margin_m", 6).alias("margin_m"))


def _shares(t):
    shares = t("documents").groupBy("lang").agg(F.avg((F.col("n_chars") > 30000).cast("double")).alias("debris"), F.lit(1.0).alias("water"), F.lit("none").alias("water_source"))
    return validation.share_findings(shares, "lang").select("scope", "level")


def _frame_metrics(t):
    region = lambda keep: F.transform(F.col("embedding"), lambda _, i: keep(i + 1))
    px = frames.classified(F.col("embedding"), [(0.1, frames.DEBRIS), (0.0, frames.WATER)], frames.BACKGROUND)
    rows = t("embeddings").select("vec_id", px.alias("px"), region(lambda i: i % 3 != 0).alias("roi"), region(lambda i: i <= 18).alias("structure"))
    return frames.frame_metrics(rows, "px", "roi", "structure").select("vec_id", "debris_px", "water_px", "accumulation_px", "coverage", "accumulation_frac")


def _velocity(t):
    rows = _values(t).withColumns({"n": F.when(F.col("v").isNotNull(), 5).otherwise(0), "dt": F.lit(0.1)})
    return frames.velocities(rows, "user_id", ["ts", "event_id"], "v", "n", "dt").select("event_id", "velocity_px_s")


def _latest_pair(t):
    kind = lambda k: t("events").where(F.col("event_type") == k).select("ts", "event_id")
    made = ts.latest_pair(kind("click"), kind("view"), ["ts", "event_id"], ["ts", "event_id"])
    return made.select(F.col("left.event_id").alias("sensor"), F.col("right.event_id").alias("camera"))


def _utc(t):
    at = (epoch_us() / 1000000).alias("s")
    text = labels.utc_text(F.col("s"))
    return t("events").select("event_id", at).select("event_id", text.alias("ts_utc"), F.unix_timestamp(labels.parse_utc(text)).alias("back_s"), labels.clock_label(F.timestamp_seconds(F.floor("s"))).alias("clock"))


def _corner_columns(first: int, n: int, width: int, height: int):
    """Corners on whole pixels of a frame, made of a vector's components from ``first`` on."""
    at = lambda i, most: F.floor(F.abs(F.get("embedding", F.lit(i)).cast("double")) * 1000) % most
    return [(at(first + i, width), at(first + n + i, height)) for i in range(n)]


def _polygon_masks(t):
    unit = F.array(*[F.struct((x / F.lit(23.0)).alias("x"), (y / F.lit(15.0)).alias("y")) for x, y in _corner_columns(0, 8, 24, 16)])
    rows = t("embeddings").select("vec_id", frames.polygon_mask(unit, 24, 16).alias("m"))
    places = F.filter(F.transform("m", lambda p, i: F.when(p, i)), lambda i: i.isNotNull())
    return rows.select("vec_id", F.size(places).alias("inside_px"), F.aggregate(places, F.lit(0), lambda s, i: s + i).cast("long").alias("places"), F.size("m").alias("px"))


def _painted_shapes(t):
    shape = lambda slot, first, n: F.struct(F.lit(slot).alias("slot"), F.array(*[v.cast("double") for xy in _corner_columns(first, n, 24, 16) for v in xy]).alias("polygon"))
    shapes = t("embeddings").select("vec_id", F.explode(F.array(shape(1, 0, 8), shape(2, 16, 3), shape(3, 24, 5))).alias("s")).select("vec_id", "s.*", F.lit(24).alias("w"), F.lit(16).alias("h"))
    made = fill.painted_masks(shapes, "vec_id", "w", "h", "slot", paint_order=[3, 1])
    return made.select("vec_id", *[frames.counted(F.col("px"), k).cast("int").alias(f"n{k}") for k in range(4)])


def _polygon_reasons(t):
    point = lambda i: F.concat(F.lit("["), *[x for j in (i, i + 1) for x in (F.round(F.get("embedding", F.lit(j)).cast("double") + 0.5, 3).cast("string"), F.lit("," if j == i else "]"))])
    polygon = lambda first, n: F.concat(F.lit("["), F.concat_ws(",", *[point(first + 2 * i) for i in range(n)]), F.lit("]"))
    structure = F.when(F.col("vec_id") % 5 == 0, '"none"').when(F.col("vec_id") % 5 == 1, "[[0,0],[1,1]]").when(F.col("vec_id") % 5 == 2, "[[0.1,0.1],[0.5,0.5],[0.9,0.9]]").when(F.col("vec_id") % 5 == 3, '[[0,0],[1,"x"],[1,1]]').otherwise(polygon(8, 3))
    return t("embeddings").select("vec_id", masks.polygons_reason(F.concat(F.lit('{"roi":'), polygon(0, 4), F.lit(',"structure":'), structure, F.lit("}"))).alias("reason"))


def _coverage_errors(t):
    e = F.col("event_id")
    rows = t("events").select("event_type", F.when(e % 7 > 0, e % 11).alias("a"), F.when(e % 5 > 0, e % 3).alias("b"))
    return evaluation.coverage_error(rows, "a", "b", ["event_type"])


def _scores(t):
    return ts.prefixed(t("documents").groupBy("lang").agg(F.avg("n_chars").alias("mean"), F.max("n_chars").alias("most")), "val_", ("lang",))


QUERIES = {
    k: on(v)
    for k, v in {
        "fixed_columns": _fixed_columns,
        "csv_record": lambda t: t("events").select("event_id", labels.csv_record([F.col("event_id"), F.col("user_id"), F.when(F.col("event_type") != "error", F.col("event_type")), F.lit(None)]).alias("line")),
        "path_fallback": _resolved,
        "candidate_priority": lambda t: splits.preferred(t("orders"), ["o_custkey"], ["o_orderpriority", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderpriority"),
        "checkpoint_status": lambda t: splits.status(t("pages").select("page_id"), t("labels").select(F.col("doc_id").alias("page_id")), "page_id", F.col("page_id") % 5 == 0),
        "video_summary": lambda t: evaluation.video_summary(_values(t), ["user_id"], "v").withColumn("mean", F.round("mean", 6)),
        "exposure_sweep": _exposures,
        "split_deviation": _split_deviation,
        "instance_union": lambda t: frames.union_area(t("lineitem"), ["l_orderkey"], "l_partkey"),
        "totals_by_kind": lambda t: validation.totals_by_kind(t("events").select(F.col("event_type").alias("kind"), (F.col("user_id") % 5).alias("source"), _cents().alias("cents")), ["kind", "source"], F.col("cents")),
        "trapezoid_volume": lambda t: evaluation.volume(t("lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_quantity"], "l_quantity", "l_linenumber").withColumn("volume", F.round("volume", 4)),
        "soft_dice": _soft_dice,
        "early_stopping": _early,
        "hour_median": lambda t: ranks.percentiles(t("events").select("user_id", F.substring(F.col("ts").cast("string"), 1, 13).alias("hour"), "value"), ["user_id", "hour"], "value", {"med": 0.5}).drop("n"),
        "vocabulary_slots": lambda t: splits.slots(t("part"), "p_brand"),
        "key_uniqueness": lambda t: splits.is_unique(t("events"), unique_ids="event_id", unique_sites="user_id"),
        "area_flux": _area_flux,
        "degenerate_boxes": lambda t: t("lineitem").where(geometry.kept_box(F.lit(10), F.lit(10000), F.col("l_quantity"), F.col("l_extendedprice"))).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("kept")),
        "clipping": lambda t: frames.clipped(t("part"), ["p_brand"], ["p_size"], 45, 0.02),
        "one_of_two": lambda t: t("pages").join(t("documents").select(F.col("doc_id").alias("page_id"), "text"), "page_id", "left").select("page_id", (~validation.one_of(F.col("url"), F.col("text"))).alias("broken")),
        "sample_ids": lambda t: t("pages").select("page_id", geometry.sample_id(F.col("url")).alias("sample_id")).withColumn("ambiguous", F.count(F.lit(1)).over(Window.partitionBy("sample_id")) > 1),
        "reconnect_delay": lambda t: t("nation").select("n_nationkey", labels.reconnect_delay(F.col("n_nationkey")).alias("delay_s")),
        "alert_reason": lambda t: _rates(t).select("l_orderkey", "l_linenumber", "l_partkey", labels.alert_reason(F.col("l_discount"), F.col("l_tax"), 0.05, 0.04).alias("reason")),
        "until_label": lambda t: _hours(t).select("event_id", labels.due_label(F.col("hours")).alias("label")),
        "until_time": lambda t: t("events").select("event_id", labels.until_label((F.col("event_id") % 4000) * 90 - 300).alias("label")),
        "forecast_horizon": lambda t: _hours(t).where(F.col("hours").between(-3, 24)),
        "hydraulics_summary": _summary,
        "share_findings": _shares,
        "failure_kinds": lambda t: validation.failures(t("events").select(F.when(F.col("event_type") != "view", F.concat("event_type", F.lit(": "), F.col("event_id").cast("string"))).alias("error")), "error"),
        "motion_vectors": _motion,
        "ultrasonic_gate": lambda t: validation.echo_state(_values(t), "user_id", "v", 20, 100, 20),
        "latency_quantiles": _latency,
        "area_percentiles": _percentiles,
        "frame_intervals": _intervals,
        "polling_gaps": _gaps,
        "stale_sources": _stale,
        "date_label": lambda t: t("orders").select("o_orderkey", labels.date_label(F.col("o_orderdate")).alias("label")),
        "run_length_mask": _run_lengths,
        "live_sources": lambda t: t("pages").select("page_id", labels.live_source(F.col("url")).alias("live")),
        "colour_keys": lambda t: t("part").select("p_partkey", geometry.colour(F.concat_ws(",", (F.col("p_partkey") % 256).cast("string"), F.col("p_size").cast("string"), F.lit("7"))).alias("rgb")),
        "notifications": _notes,
        "prefixed_scores": _scores,
        "resized_frames": lambda t: t("part").select("p_partkey", geometry.resized(F.col("p_size"), F.lit(7), 100).alias("r")).select("p_partkey", F.col("r.width").alias("w"), F.col("r.height").alias("h")),
        "utc_texts": _utc,
        "polygon_masks": _polygon_masks,
        "painted_shapes": _painted_shapes,
        "polygon_reasons": _polygon_reasons,
        "coverage_errors": _coverage_errors,
        "frame_metrics": _frame_metrics,
        "velocity_median": _velocity,
        "latest_pair": _latest_pair,
    }.items()
}
ORACLES = {k: duck(v) for k, v in SQL.items()} | DUCK
