"""URL filtering by association rules.

Labelled URLs become sets of tokens (host labels, path words, query keys); FP-growth mines combinations that occur
together with a label. Labels are those of the document that a page shows. Rules that lack confidence or support are
pruned, and so is a rule of which a more general one has no less confidence: each rule's subsets are looked up among
the rules. The rules match by an inverted index: a rule stands under its rarest token, a URL's tokens are joined to
these, and a rule fires when all its tokens are met. Rules given by hand (host and path prefix) come first.

Defined results: a null url or one without ``://`` has an empty host and path, matches no given rule and is allowed
unless a mined rule fires; rows that repeat an id are judged on their own; without labels or rules everything is
allowed; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table

#: The given rules as (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: A mined rule needs so many bad URLs, this share of all labelled ones and this confidence.
LEAST, SUPPORT, CONFIDENCE = 5, 0.0005, 0.5
#: Rules, or token sets, that are sent to every task; more are joined by a shuffle, dealt by salt.
SENT, SALTS = 100_000, 16
#: The lower end of the confidence's Wilson interval (three standard errors) must exceed the base rate so many times.
LIFT, Z = 1.5, 3.0
BAD = "label=bad"


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?``, ``#`` or the end; A-Z in lower case."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(host, upper, upper.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def given_rule(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, else null. The rules are tried from the longest host and path on."""
    order = sorted(rules, key=lambda r: (-len(r[1]), -len(r[2])))
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, where, prefix in reversed(order):
        fits = ((host == where) | host.endswith("." + where)) & path.startswith(prefix)
        out = F.when(fits, F.struct(F.lit(where + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def url_tokens(host: Column, path: Column, url: Column) -> Column:
    """Distinct tokens of a URL: ``h:`` labels of the host and its words, ``p:`` letters of the path, ``q:`` query keys."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    words = F.filter(F.split(host, r"[.-]"), lambda x: x != "")
    parts = F.filter(F.split(F.lower(path), "[^a-z]+"), lambda x: x != "")
    keys = F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit(r"[?&]([A-Za-z0-9_]+)="), F.lit(1))
    tag = lambda kind, xs: F.transform(xs, lambda x: F.concat(F.lit(kind), x))
    return F.array_distinct(F.concat(tag("h:", labels), tag("w:", words), tag("p:", parts), tag("q:", keys)))


def parsed(pages: DataFrame) -> DataFrame:
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"), url_tokens(host, path, F.col("url")).alias("tokens"))


def mined_rules(labelled: DataFrame, least: int = LEAST, support: float = SUPPORT, confidence: float = CONFIDENCE, lift: float = LIFT) -> DataFrame:
    """Rules (rule, tokens, confidence) that tell bad URLs from ``labelled`` (tokens, bad)."""
    from pyspark.ml.fpm import FPGrowth

    labelled = staged(labelled.where("bad IS NOT NULL AND size(tokens) > 0"), "labelled-urls")
    spark = labelled.sparkSession
    empty = spark.createDataFrame([], "rule string, tokens array<string>, confidence double")
    n, bad = labelled.agg(F.count(F.lit(1)), F.sum(F.col("bad").cast("long"))).first()
    if not n or not bad:
        return empty
    support = max(support, least / n)
    if support > 1:
        return empty
    # only tokens that can be frequent enter; every set keeps the label it stands with
    frequent = labelled.select(F.explode("tokens").alias("token")).groupBy("token").count().where(F.col("count") >= support * n)
    sets = labelled.withColumn("row", F.monotonically_increasing_id()).select("row", "bad", F.explode("tokens").alias("token")).join(frequent.select("token"), "token")
    sets = sets.groupBy("row", "bad").agg(F.collect_set("token").alias("items")).select(F.when(F.col("bad"), F.concat("items", F.array(F.lit(BAD)))).otherwise(F.col("items")).alias("items"))
    # adaptive execution makes one partition of the short sets; mining and the rules' join need as many as any shuffle
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence, numPartitions=width).fit(sets.repartition(width))
    c, seen = F.col("confidence"), F.col("support") * n / F.col("confidence")
    lower = (c + Z * Z / (2 * seen) - Z * F.sqrt(c * (1 - c) / seen + Z * Z / (4 * seen * seen))) / (1 + Z * Z / seen)
    rules = model.associationRules.where(F.array_contains("consequent", BAD) & (lower >= lift * bad / n))
    rules = staged(rules.select(F.array_join(F.array_sort("antecedent"), "+").alias("rule"), F.array_sort("antecedent").alias("tokens"), "confidence"), "rules")
    # as many subsets as the miner has made of each rule's tokens
    masks = F.explode(F.expr("sequence(1L, shiftleft(1L, size(tokens)) - 2)"))
    parts = rules.where(F.size("tokens") > 1).select("rule", "confidence", "tokens", masks.alias("mask")).select("rule", "confidence", F.expr("array_join(filter(tokens, (x, i) -> pmod(shiftright(mask, i), 2) = 1), '+')").alias("part"))
    general = rules.select(F.col("rule").alias("part"), F.col("confidence").alias("general"))
    covered = parts.join(general, "part").where("general >= confidence").select("rule").distinct()
    return rules.join(covered, "rule", "left_anti")


def dealt(left: DataFrame, right: DataFrame, on: list[str], how: str) -> DataFrame:
    """``left`` joined to the written table ``right``: sent to every task if it is short, else each of its rows in SALTS copies, so that a key that very many rows of ``left`` share is dealt over tasks."""
    if right.count() <= SENT:
        return left.join(F.broadcast(right), on, how)
    salted = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.withColumn("__salt", F.pmod(F.xxhash64("page_id", "tokens"), F.lit(SALTS)).cast("int")).join(salted, [*on, "__salt"], how).drop("__salt")


def fired(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The token sets that hold all tokens of some rule, through an index from each rule's rarest token. Equal sets are matched once."""
    sets = staged(urls.groupBy("tokens").agg(F.min("page_id").alias("page_id"), F.count(F.lit(1)).alias("n")), "token-sets")
    needed = rules.select("rule", "tokens", F.explode("tokens").alias("token"))
    asked = staged(needed.select("token").distinct(), "asked")
    often = dealt(sets.select("page_id", "tokens", "n", F.explode("tokens").alias("token")), asked, ["token"], "inner").groupBy("token").agg(F.sum("n").alias("n"))
    index = needed.join(often, "token").groupBy("rule").agg(F.first("tokens").alias("needed"), F.min_by("token", F.struct("n", "token")).alias("token"))
    index = staged(index.select("token", "needed"), "index")
    keyed = sets.select("page_id", "tokens", F.explode("tokens").alias("token"))
    return dealt(keyed, index, ["token"], "inner").where(F.size(F.array_except("needed", "tokens")) == 0).select("tokens").distinct()


def judged_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Every row of ``pages`` (page_id, url) with host, path, the given rule if one fits, and the verdict."""
    urls = staged(parsed(pages), "urls")
    bad = labels.groupBy(F.col("doc_id").cast("long").alias("page_id")).agg(F.max(F.col("toxic") == 1).alias("bad"))
    rules = staged(mined_rules(urls.join(bad, "page_id").select("tokens", "bad")), "mined")
    made = urls.withColumn("given", given_rule(F.col("host"), F.col("path")))
    if rules.isEmpty():
        hit = F.lit(False)
    else:
        made = dealt(made, staged(fired(urls, rules).withColumn("hit", F.lit(True)), "fired"), ["tokens"], "left")
        hit = F.coalesce("hit", F.lit(False))
    return made.select("page_id", "host", "path", F.col("given.rule").alias("rule"), F.coalesce("given.verdict", F.when(hit, "block").otherwise("allow")).alias("verdict"))


def op6_association_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
