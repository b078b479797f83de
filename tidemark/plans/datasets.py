"""Queries on dataset preparation, evaluation, masks and geometry: the library's operators on the test tables.

Each has a DuckDB text that says the same in SQL; ``{name}`` stands for a table.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import geometry
from ..operators import evaluation, frames, masks, ranks, splits, states, validation
from ..sources.tables import table

_HASHED = "SELECT lang, source, doc_id, cast(substring(md5(concat('42:', lang, ':', source)), 1, 1) IN ('0','1','2','3','4','5','6','7','8','9','a') AS int) AS tr, cast(substring(md5(concat('42:', lang, ':', source)), 1, 1) IN ('b','c') AS int) AS va FROM {documents}"
_NAMED = f"SELECT lang, source, doc_id, CASE WHEN tr = 1 THEN 'train' WHEN va = 1 THEN 'val' ELSE 'test' END AS split FROM ({_HASHED}) h"
_LOC = "SELECT DISTINCT source FROM {documents}"
_CM = "SELECT d.lang, l.quality AS truth, l.toxic AS pred FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id WHERE l.quality BETWEEN 0 AND 1"
_IOU = "SELECT c.cls, {key} sum(CASE WHEN truth = c.cls AND pred = c.cls THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN truth <> c.cls AND pred = c.cls THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN truth = c.cls AND pred <> c.cls THEN 1 ELSE 0 END) AS fn FROM ({cm}) m CROSS JOIN (SELECT 0 AS cls UNION ALL SELECT 1 UNION ALL SELECT 2) c GROUP BY {keys}"

#: What each query gives, in SQL.
SQL = {
    "split_hash_order": "SELECT lang, source, row_number() OVER (PARTITION BY lang ORDER BY md5(concat('42:', lang, ':', source))) AS pos FROM (SELECT DISTINCT lang, source FROM {documents}) g",
    "split_counts": f"SELECT lang, split, count(*) AS n, count(DISTINCT source) AS n_groups FROM ({_NAMED}) s GROUP BY lang, split",
    "split_straddle": f"SELECT source, count(DISTINCT split) AS n_splits FROM ({_NAMED}) s GROUP BY source HAVING count(DISTINCT split) > 1",
    "split_overlap": f"SELECT source FROM ({_NAMED}) s WHERE split = 'train' INTERSECT SELECT source FROM ({_NAMED}) s WHERE split = 'test'",
    "split_difference": f"SELECT source FROM ({_NAMED}) s WHERE split = 'train' EXCEPT SELECT source FROM ({_NAMED}) s WHERE split = 'val'",
    "heldout_union": f"SELECT doc_id FROM ({_NAMED}) s WHERE split = 'val' UNION SELECT doc_id FROM {{labels}} WHERE toxic = 1",
    "merged_bag": "SELECT doc_id FROM {documents} WHERE lang = 'de' UNION ALL SELECT doc_id FROM {labels} WHERE quality = 0",
    "fold_locv": f"SELECT t.source AS test_loc, v.val_loc, tr.source AS train_loc FROM ({_LOC}) t JOIN (SELECT source, coalesce(lead(source) OVER (ORDER BY source), first_value(source) OVER (ORDER BY source)) AS val_loc FROM ({_LOC}) x) v ON t.source = v.source JOIN ({_LOC}) tr ON tr.source <> t.source AND tr.source <> v.val_loc",
    "excluded_anti": "SELECT d.doc_id, d.lang FROM {documents} d LEFT ANTI JOIN {labels} l ON d.doc_id = l.doc_id",
    "dangling_left": "SELECT l.doc_id, d.lang, d.doc_id IS NULL AS dangling FROM (SELECT doc_id * 2 AS doc_id FROM {labels}) l LEFT JOIN {documents} d ON l.doc_id = d.doc_id",
    "duplicate_keys": "SELECT source, lang, count(*) AS n FROM {documents} GROUP BY source, lang HAVING count(*) > 1",
    "review_order": "SELECT doc_id, row_number() OVER (ORDER BY CASE WHEN toxic = 1 THEN 0 ELSE 1 END, quality NULLS FIRST, doc_id) AS pos FROM {labels}",
    "verdict_counts": "SELECT CASE WHEN toxic = 1 THEN 'reject' WHEN quality = 1 THEN 'ok' ELSE '' END AS verdict, count(*) AS n FROM {labels} GROUP BY 1",
    "label_map_join": "SELECT n.n_nationkey, n.n_name, r.r_name, dense_rank() OVER (ORDER BY r.r_name) AS slot FROM {nation} n JOIN {region} r ON n.n_regionkey = r.r_regionkey",
    "unmapped_policy": "SELECT n.n_nationkey, CASE WHEN r.r_regionkey IS NULL THEN 255 ELSE r.r_regionkey END AS mapped FROM {nation} n LEFT JOIN (SELECT * FROM {region} WHERE r_regionkey < 3) r ON n.n_regionkey = r.r_regionkey",
    "class_histogram_share": "SELECT l_returnflag, l_linestatus, count(*) AS n, count(*) / cast(greatest(1, sum(count(*)) OVER ()) AS double) AS share FROM {lineitem} GROUP BY l_returnflag, l_linestatus",
    "orphan_values": "SELECT l_linestatus, count(*) AS n FROM {lineitem} WHERE l_linestatus NOT IN ('O') GROUP BY l_linestatus",
    "confusion_matrix": f"SELECT truth, pred, count(*) AS n FROM ({_CM}) m GROUP BY truth, pred",
    "confusion_by_group": f"SELECT lang, truth, pred, count(*) AS n FROM ({_CM}) m GROUP BY GROUPING SETS ((lang, truth, pred), (truth, pred))",
    "iou_metrics": f"SELECT cls, CASE WHEN tp + fp + fn > 0 THEN tp / (tp + fp + fn + 1e-9) END AS iou, CASE WHEN tp + fp + fn > 0 THEN tp / (tp + fp + 1e-9) END AS prec, CASE WHEN tp + fp + fn > 0 THEN tp / (tp + fn + 1e-9) END AS rec FROM (SELECT cls, cast(tp AS double) AS tp, cast(fp AS double) AS fp, cast(fn AS double) AS fn FROM ({_IOU.format(key='', cm=_CM, keys='c.cls', labels='{labels}')}) q) z".replace("1e-9", "cast(1e-9 AS double)"),
    "per_group_iou": f"SELECT lang, cls, CASE WHEN tp + fp + fn > 0 THEN tp / (tp + fp + fn + 1e-9) END AS iou FROM (SELECT lang, cls, cast(tp AS double) AS tp, cast(fp AS double) AS fp, cast(fn AS double) AS fn FROM ({_IOU.format(key='lang,', cm=_CM, keys='c.cls, lang')}) q) z".replace("1e-9", "cast(1e-9 AS double)"),
    "degradation_vs_max": "SELECT o_orderpriority, cents, CASE WHEN base > 0 THEN cast(floor(cast(10000 * (base - cents) AS double) / base) AS bigint) END AS drop_bp FROM (SELECT o_orderpriority, cents, first_value(cents) OVER (ORDER BY o_orderpriority DESC) AS base FROM (SELECT o_orderpriority, max(cast(round(o_totalprice * 100) AS bigint)) AS cents FROM {orders} GROUP BY o_orderpriority) g) b",
    "capped_sampler": "SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5(concat('7:', cast(doc_id AS string)))) AS rn, count(*) OVER (PARTITION BY lang) AS n FROM {documents}) s WHERE rn <= greatest(1, least(n, CASE WHEN lang = 'en' THEN 50 ELSE 100 END))",
    "systematic_sample": "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS rn FROM {orders}) s WHERE (rn - 1) % 10 = 0 AND (rn - 1) / 10 < 500",
    "leaderboard": "SELECT source, n_chars FROM {documents} ORDER BY n_chars DESC, doc_id LIMIT 1",
    "top_reasons": "SELECT event_type, count(*) AS n FROM {events} GROUP BY event_type ORDER BY n DESC, event_type LIMIT 5",
    "site_ranges": "SELECT user_id, min(value) AS least, max(value) AS most, count(*) AS n, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS missing FROM {events} GROUP BY user_id",
    "size_classes": "SELECT CASE WHEN n_chars < 1000 THEN 'small' WHEN n_chars < 10000 THEN 'medium' ELSE 'large' END AS size_class, count(*) AS n FROM {documents} GROUP BY 1",
    "auto_flags": "SELECT doc_id, CASE WHEN n_chars < 100 THEN 'too_small' WHEN n_chars > 20000 THEN 'too_large' WHEN lang = 'en' THEN '' ELSE 'low_score' END AS flag FROM {documents}",
    "config_grid": "SELECT a.n_name, b.r_name FROM {nation} a CROSS JOIN {region} b",
    "entry_partition": "SELECT page_id, substring(url, 1, strpos_(url, '/') - 1) AS head, substring(url, strpos_(url, '/') + 1, 1000000) AS tail FROM {pages}",
    "default_weight": "SELECT d.doc_id, coalesce(cast(l.quality AS double), cast(1.0 AS double)) AS weight FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id",
    "resume_anti": "SELECT d.doc_id FROM {documents} d LEFT ANTI JOIN {pages} p ON p.page_id * 3 = d.doc_id",
    "cost_accuracy_full": "SELECT coalesce(a.doc_id, b.page_id) AS doc_id, a.quality, b.url IS NOT NULL AS has_page FROM {labels} a FULL OUTER JOIN {pages} b ON a.doc_id = b.page_id",
}

#: As above, in DuckDB only.
DUCK = {
    "iou_mean": f"SELECT round(avg(iou), 9) AS miou FROM ({SQL['iou_metrics']}) t",
    "latency_nearest_rank": "SELECT l_returnflag, n0 AS n, s[n0 // 2 + 1] AS p50, s[least(n0 - 1, floor(0.9::DOUBLE * n0)::INT) + 1] AS p90 FROM (SELECT l_returnflag, list_sort(list(l_extendedprice)) AS s, count(*)::INT AS n0 FROM lineitem GROUP BY l_returnflag)",
    "upper_median": "SELECT user_id, list_sort(list(value))[count(*) // 2 + 1] AS med FROM events GROUP BY user_id",
    "paint_priority": "SELECT l_orderkey, l_returnflag AS painted FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber DESC, l_partkey DESC, l_extendedprice DESC, l_returnflag DESC) = 1",
    "polygon_area_validity": "SELECT vec_id, area, raw >= 1e-4::DOUBLE AND ok AS valid FROM (SELECT vec_id, len(list_filter(e, lambda x: x < -0.5 OR x > 0.5)) = 0 AS ok, abs(e[1]*e[4] - e[3]*e[2] + e[3]*e[6] - e[5]*e[4] + e[5]*e[8] - e[7]*e[6] + e[7]*e[2] - e[1]*e[8]) / 2 AS raw, round(abs(e[1]*e[4] - e[3]*e[2] + e[3]*e[6] - e[5]*e[4] + e[5]*e[8] - e[7]*e[6] + e[7]*e[2] - e[1]*e[8]) / 2, 6) AS area FROM (SELECT vec_id, list_transform(embedding[1:8], lambda x: x::DOUBLE) AS e FROM embeddings))",
    "mask_overlay": "SELECT vec_id, len(list_filter(m, lambda x: x = 2)) AS debris, len(list_filter(m, lambda x: x = 1)) AS water, len(list_filter(m, lambda x: x = 2)) / nullif(len(list_filter(m, lambda x: x > 0)), 0)::DOUBLE AS coverage FROM (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0.1 THEN 2 WHEN x > 0 THEN 1 ELSE 0 END) AS m FROM embeddings)",
    "lut_gather": "SELECT vec_id, list_sum(list_transform(embedding, lambda x: [0, 5, 9][CASE WHEN x > 0.1 THEN 3 WHEN x > 0 THEN 2 ELSE 1 END]))::BIGINT AS total FROM embeddings",
    "argmax_class": "SELECT vec_id, list_position(embedding, list_max(embedding)) - 1 AS cls FROM embeddings",
    "group_key_regex": r"SELECT page_id, CASE WHEN regexp_extract(url, '/([a-z]{2})/', 1) = '' THEN url ELSE regexp_extract(url, '/([a-z]{2})/', 1) END AS grp FROM pages",
    "greedy_split": """WITH RECURSIVE g AS (SELECT lang, source, count(*) AS n, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || coalesce(lang, 'None') || ':' || coalesce(source, 'None'))) AS rn, count(*) OVER (PARTITION BY lang) AS k, sum(count(*)) OVER (PARTITION BY lang) AS total FROM documents GROUP BY lang, source),
f AS (SELECT lang, source, n, rn, 1::BIGINT AS pick, n::DOUBLE AS a, 0::DOUBLE AS b, 0::DOUBLE AS c FROM g WHERE rn = 1
  UNION ALL SELECT lang, source, n, rn, pick, a + CASE WHEN pick = 1 THEN n ELSE 0 END, b + CASE WHEN pick = 2 THEN n ELSE 0 END, c + CASE WHEN pick = 3 THEN n ELSE 0 END FROM (
    SELECT g.lang, g.source, g.n, g.rn, f.a, f.b, f.c, CASE WHEN g.k >= 3 AND g.rn <= 3 THEN g.rn WHEN 0.7::DOUBLE * g.total - f.a >= 0.15::DOUBLE * g.total - f.b AND 0.7::DOUBLE * g.total - f.a >= 0.15::DOUBLE * g.total - f.c THEN 1 WHEN 0.15::DOUBLE * g.total - f.b >= 0.15::DOUBLE * g.total - f.c THEN 2 ELSE 3 END AS pick
    FROM f JOIN g ON g.lang IS NOT DISTINCT FROM f.lang AND g.rn = f.rn + 1) s)
SELECT lang, source, n, CASE pick WHEN 1 THEN 'train' WHEN 2 THEN 'val' ELSE 'test' END AS split FROM f""",
    "group_members": "SELECT source, array_to_string(list_transform(list_sort(list(doc_id))[1:5], lambda x: x::VARCHAR), ',') AS heads FROM documents GROUP BY source",
    "json_path": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
}

def duck(sql: str) -> str:
    """A text with its tables' names, as DuckDB reads it."""
    return re.sub(r"\{(\w+)\}", r"\1", sql).replace("LEFT ANTI JOIN", "ANTI JOIN").replace("cast(doc_id AS string)", "cast(doc_id AS varchar)")


def on(make):
    """A query that hands ``make`` a function from a table's name to the table."""
    return lambda spark, sf_dir: make(lambda name: table(spark, sf_dir, name))


SPLITS = (("train", 11), ("val", 2), ("test", 3))


def _split(t):
    return splits.hashed_split(t("documents").select("lang", "source", "doc_id"), 42, ["lang", "source"], SPLITS)


def _judged(t):
    """Labels with their language, as true (quality) and predicted (toxic) classes."""
    rows = t("labels").join(t("documents").select("doc_id", "lang"), "doc_id").select("lang", F.col("quality").alias("truth"), F.col("toxic").alias("pred"))
    return rows.where(evaluation.valid(F.col("truth"), 2))


def _scores(t, group=()):
    return evaluation.class_scores(evaluation.confusion(_judged(t), "truth", "pred", group), "truth", "pred", (0, 1, 2), group)


def _prices(t):
    """Highest price in cents by priority."""
    return t("orders").groupBy("o_orderpriority").agg(F.max(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("cents"))


def _degradation(t):
    made = evaluation.drop_from_largest(_prices(t), "o_orderpriority", "cents", places=12)
    return made.select("o_orderpriority", "cents", F.floor(F.col("drop_pct") * 100 + 1e-7).cast("bigint").alias("drop_bp"))


def _points(t):
    e = lambda i: F.get("embedding", F.lit(i)).cast("double")
    return t("embeddings").select("vec_id", F.array(*[F.struct(e(2 * i).alias("x"), e(2 * i + 1).alias("y")) for i in range(4)]).alias("polygon"))


def _classes(t):
    """Frames made of vectors: over 0.1 debris, over 0 water."""
    return t("embeddings").select("vec_id", frames.classified(F.col("embedding"), [(0.1, frames.DEBRIS), (0.0, frames.WATER)], frames.BACKGROUND).alias("px"))


def _overlay(t):
    one = lambda lo: F.transform("embedding", lambda x: (x > lo).cast("int"))
    made = t("embeddings").select("vec_id", frames.overlaid(one(0.0), one(0.1)).alias("px")).withColumn("c", frames.class_counts(F.col("px")))
    return made.select("vec_id", F.col("c.debris").alias("debris"), F.col("c.water").alias("water"), F.col("c.coverage").alias("coverage"))


def _group_members(t):
    first = ranks.heads(t("documents").select("source", "doc_id"), ["source"], ["doc_id"], 5)
    return first.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), ",").alias("heads"))


def _group_key(t):
    found = F.regexp_extract("url", "/([a-z]{2})/", 1)
    return t("pages").select("page_id", F.when(found == "", F.col("url")).otherwise(found).alias("grp"))


def _entries(t):
    return t("pages").withColumn("e", geometry.head_and_tail(F.col("url"))).select("page_id", "e.head", "e.tail")


def _size_class(n):
    return F.when(n < 1000, "small").when(n < 10000, "medium").otherwise("large")


QUERIES = {
    k: on(v)
    for k, v in {
        "split_hash_order": lambda t: splits.group_order(t("documents"), "lang", "source", 42),
        "split_counts": lambda t: splits.split_counts(_split(t), "lang", "source"),
        "split_straddle": lambda t: splits.straddling(_split(t), ["source"]),
        "split_overlap": lambda t: splits.in_both(_split(t), "train", "test", "source"),
        "split_difference": lambda t: splits.only_in(_split(t), "train", "val", "source"),
        "heldout_union": lambda t: splits.held_out(_split(t).where("split = 'val'").select("doc_id"), t("labels").where("toxic = 1").select("doc_id")),
        "merged_bag": lambda t: splits.merged(t("documents").where("lang = 'de'").select("doc_id"), t("labels").where("quality = 0").select("doc_id")),
        "fold_locv": lambda t: splits.location_folds(t("documents"), "source"),
        "excluded_anti": lambda t: splits.without_ids(t("documents").select("doc_id", "lang"), t("labels"), ["doc_id"]),
        "dangling_left": lambda t: splits.dangling(t("labels").select((F.col("doc_id") * 2).alias("doc_id")), t("documents").select("doc_id", "lang"), ["doc_id"]),
        "duplicate_keys": lambda t: splits.repeated(t("documents"), ["source", "lang"]),
        "review_order": lambda t: validation.worst_first(t("labels").select("doc_id", "quality", "toxic"), F.col("toxic") == 1, "quality", "doc_id").select("doc_id", "pos"),
        "verdict_counts": lambda t: validation.counts(t("labels"), validation.verdict(F.when(F.col("toxic") == 1, "Reject").when(F.col("quality") == 1, " ok")), "verdict"),
        "label_map_join": lambda t: t("nation").join(t("region").join(splits.slots(t("region"), "r_name", first=1), "r_name"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name", "slot"),
        "unmapped_policy": lambda t: validation.mapped_labels(t("nation"), t("region").where("r_regionkey < 3").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_regionkey").alias("slot")), "n_regionkey", "slot", "ignore").select("n_nationkey", "mapped"),
        "class_histogram_share": lambda t: validation.class_shares(t("lineitem"), ["l_returnflag", "l_linestatus"]),
        "orphan_values": lambda t: validation.orphans(t("lineitem").select("l_linestatus"), "l_linestatus", t("orders").where("o_orderstatus = 'O'").limit(1), "o_orderstatus"),
        "confusion_matrix": lambda t: evaluation.confusion(_judged(t), "truth", "pred"),
        "confusion_by_group": lambda t: evaluation.confusion(_judged(t), "truth", "pred", ["lang"], overall=True),
        "iou_metrics": lambda t: _scores(t),
        "per_group_iou": lambda t: _scores(t, ["lang"]).select("lang", "cls", "iou"),
        "iou_mean": lambda t: evaluation.mean_iou(_scores(t)),
        "degradation_vs_max": _degradation,
        "capped_sampler": lambda t: splits.capped(t("documents").select("lang", "doc_id"), "lang", "doc_id", F.when(F.col("lang") == "en", 50).otherwise(100), 7),
        "systematic_sample": lambda t: splits.every_kth(t("orders"), ["o_orderpriority"], ["o_orderkey"], 10, 500).select("o_orderkey"),
        "leaderboard": lambda t: t("documents").orderBy(F.desc("n_chars"), "doc_id").limit(1).select("source", "n_chars"),
        "top_reasons": lambda t: validation.top(t("events"), "event_type", 5),
        "site_ranges": lambda t: validation.ranges(t("events"), ["user_id"], "value", F.col("event_type") == "error"),
        "size_classes": lambda t: validation.counts(t("documents"), _size_class(F.col("n_chars")), "size_class"),
        "auto_flags": lambda t: t("documents").select("doc_id", F.replace(validation.flag(F.col("n_chars"), F.lit(1.0), F.col("lang") == "en", 100, 20000, 0.5), F.lit("no_debris_seed"), F.lit("low_score")).alias("flag")),
        "config_grid": lambda t: splits.grid(t("nation").select("n_name"), t("region").select("r_name")),
        "entry_partition": _entries,
        "default_weight": lambda t: splits.weighted(t("documents").select("doc_id"), t("labels"), "doc_id", "quality"),
        "resume_anti": lambda t: splits.without_ids(t("documents").select("doc_id"), t("pages").select((F.col("page_id") * 3).alias("doc_id")), ["doc_id"]),
        "cost_accuracy_full": lambda t: splits.cost_with_accuracy(t("labels"), t("pages").withColumnRenamed("page_id", "doc_id"), "doc_id").select("doc_id", "quality", F.col("url").isNotNull().alias("has_page")),
        "latency_nearest_rank": lambda t: ranks.nearest_ranks(t("lineitem"), ["l_returnflag"], "l_extendedprice", {"p50": ranks.upper_middle, "p90": ranks.at_share(0.9)}),
        "upper_median": lambda t: ranks.nearest_ranks(t("events"), ["user_id"], "value", {"med": ranks.upper_middle}).select("user_id", "med"),
        "paint_priority": lambda t: frames.painted(t("lineitem"), ["l_orderkey"], "l_returnflag", ["l_quantity", "l_linenumber", "l_partkey", "l_extendedprice", "l_returnflag"]),
        "polygon_area_validity": lambda t: _points(t).select("vec_id", F.round(masks.polygon_area(F.col("polygon")), 6).alias("area"), masks.valid_polygon(F.transform("polygon", lambda p: F.struct((p["x"] + 0.5).alias("x"), (p["y"] + 0.5).alias("y")))).alias("valid")),
        "mask_overlay": _overlay,
        "lut_gather": lambda t: _classes(t).select("vec_id", F.aggregate(frames.mapped(F.col("px"), frames.composed([0, 1, 2], [0, 5, 9])), F.lit(0), lambda a, x: a + x).alias("total")),
        "argmax_class": lambda t: t("embeddings").select("vec_id", frames.arg_max(F.col("embedding")).alias("cls")),
        "group_key_regex": _group_key,
        "group_members": _group_members,
        "json_path": lambda t: t("events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k")),
        "greedy_split": lambda t: states.greedy_split(t("documents").groupBy("lang", "source").count().withColumnRenamed("count", "n"), "lang", "source", "n"),
    }.items()
}
ORACLES = {k: duck(v.replace("strpos_(url, '/')", "instr(url, '/')")) for k, v in SQL.items()} | {k: duck(v) if k == "iou_mean" else v for k, v in DUCK.items()}
