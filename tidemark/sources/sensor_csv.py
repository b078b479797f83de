"""Positional sensor lines: 14 fields, blank and ``nan`` fields are null, malformed lines reject their batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The fields in order with their types.
FIELDS = (
    ("ts_utc", "string"), ("ts_epoch", "bigint"), ("jarak_cm", "double"), ("tinggi_cm", "double"), ("valid", "int"), ("n_sampel", "int"), ("tip_total", "bigint"),
    ("tip_menit", "int"), ("mm_per_jam", "double"), ("level", "string"), ("pompa", "int"), ("time_src", "string"), ("rssi", "int"), ("sms_status", "string"),
)


#: White space around lines and fields.
WHITE = " \t\n\x0b\x0c\r\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def parse(lines: DataFrame, line: str = "csv") -> DataFrame:
    """``lines`` without blank and header lines, with the typed fields and ``ok``.

    A line is well formed if it has all fields, a time as text and as a number, and no number field that is neither
    blank, ``nan`` nor a finite decimal number. Blank and ``nan`` are null. A fraction of a whole-number field is cut.
    """
    white = F.lit(WHITE)
    trimmed = lines.withColumn("__l", F.btrim(F.col(line), white)).where((F.col("__l") != "") & ~F.col("__l").startswith("ts_utc"))
    fields = trimmed.withColumn("__f", F.transform(F.split("__l", ",", -1), lambda x: F.btrim(x, white)))
    number = lambda x: F.when(x.rlike(NUMBER), x.try_cast("double"))
    cast = fields.withColumn("__v", F.transform("__f", number))
    numeric = F.array(*[F.lit(kind != "string") for _, kind in FIELDS])
    finite = lambda v: v.isNotNull() & (F.abs(v) != float("inf"))
    fine = F.zip_with(F.zip_with("__f", "__v", lambda x, v: finite(v) | F.lower(x).isin("", "nan", "-nan")), numeric, lambda good, needed: good | ~needed)
    ok = (F.size("__f") == len(FIELDS)) & (F.get("__f", F.lit(0)) != "") & finite(F.get("__v", F.lit(1))) & F.forall(fine, lambda x: x)
    value = lambda i, kind: F.when(finite(F.get("__v", F.lit(i))), F.get("__v", F.lit(i)).try_cast(kind))
    cols = [(F.nullif(F.get("__f", F.lit(i)), F.lit("")) if kind == "string" else value(i, kind)).alias(name) for i, (name, kind) in enumerate(FIELDS)]
    return cast.select(*lines.columns, F.coalesce(ok, F.lit(False)).alias("ok"), *cols)


def accepted(parsed: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Rows of batches in which every row is well formed; one bad row rejects its whole batch."""
    return parsed.withColumn("__all", F.bool_and("ok").over(Window.partitionBy(batch))).where("__all").drop("__all", "ok")
