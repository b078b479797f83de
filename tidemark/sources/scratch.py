"""Tables that a job writes for itself into the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it in ``spark.checkpoint.dir``.

    Where it names none, a local master, whose only machine is this one, gets a folder of its own; a cluster is refused,
    as no local folder would be seen by all of it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if spark.sparkContext.applicationId not in _LOCAL:
        _LOCAL[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="tidemark-")
    return _LOCAL[spark.sparkContext.applicationId]


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage: a lost executor costs a re-read of the file, not a re-run of what made it.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/tidemark-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows that are sent to every task; a longer table is joined by a shuffle.
SENT_ROWS = 1_000_000


def sent(df: DataFrame, label: str, most: int = SENT_ROWS) -> DataFrame:
    """``df`` written and counted, marked for broadcast if it has at most ``most`` rows."""
    made = staged(df, label)
    return F.broadcast(made) if made.count() <= most else made
