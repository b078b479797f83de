"""Readers of annotated sets by name: each gives the same columns, so that what follows need not know the format.

A reader is a function of (spark, config) decorated with its name; ``samples`` looks it up and checks what it gives.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geometry import last_part
from ..operators.splits import resolved
from .annotations import by_relative_path, coco_instances, voc_boxes

#: What every reader gives: a row per shape, one without a shape for an image that has none.
SCHEMA = "sample_id string, image string, group string, label string, polygon array<double>, box array<double>, mask string, pixels array<int>, mask_height int, mask_width int"
COLUMNS = [x.split()[0] for x in SCHEMA.split(", ")]

_READERS: dict[str, Callable[[SparkSession, dict], DataFrame]] = {}


def reader(name: str) -> Callable:
    """Registers a reader; a name is given once."""

    def put(made: Callable[[SparkSession, dict], DataFrame]) -> Callable[[SparkSession, dict], DataFrame]:
        if name in _READERS:
            raise ValueError(f"reader {name!r} is there already")
        _READERS[name] = made
        return made

    return put


def registered() -> list[str]:
    return sorted(_READERS)


def group_of(path: Column, config: dict) -> Column:
    """The group that a split must not cut: by ``group`` of the config one of parent, stem (without its last _part), constant, or a pattern's first group (no match: the whole stem)."""
    stem = F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)
    how = config.get("group", "parent")
    if how == "parent":
        return F.coalesce(F.nullif(F.regexp_extract(path, r"([^/]+)/[^/]+$", 1), F.lit("")), F.lit(config["dataset"]))
    if how == "stem":
        return F.regexp_replace(stem, r"_[^_]*$", "")
    if how == "constant":
        return F.lit(config["dataset"])
    return F.coalesce(F.nullif(F.regexp_extract(stem, how, 1), F.lit("")), stem)


def samples(spark: SparkSession, name: str, config: dict) -> DataFrame:
    """The rows of a registered reader in the common columns, missing ones null.

    A row that has more than one of polygon, box, mask and pixels fails the query that reads it, and so do two images
    whose paths make one sample id. With ``annotated_only`` in the config images without a shape are left out.
    """
    if name not in _READERS:
        raise KeyError(f"no reader {name!r}; there are: {', '.join(registered())}")
    made = _READERS[name](spark, config)
    kinds = dict(x.split() for x in SCHEMA.split(", "))
    rows = made.select(*[(F.col(c) if c in made.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in COLUMNS if c not in ("sample_id", "group")])
    rows = rows.withColumns({"sample_id": F.replace(F.regexp_replace("image", r"\.[^./]*$", ""), F.lit("/"), F.lit("__")), "group": group_of(F.col("image"), config)})
    shapes = sum((F.col(c).isNotNull().cast("int") for c in ("polygon", "box", "mask", "pixels")), F.lit(0))
    checked = F.when(shapes <= 1, F.col("sample_id")).otherwise(F.raise_error(F.concat(F.lit("more than one kind of shape: "), "sample_id")))
    same = Window.partitionBy("sample_id")  # an image has a row per shape, a sample id one image
    clear = F.when(F.min("image").over(same) == F.max("image").over(same), checked).otherwise(F.raise_error(F.concat(F.lit("two images are "), "sample_id")))
    if config.get("annotated_only"):
        rows = rows.where(shapes > 0)
    return rows.withColumn("sample_id", clear).select(F.lit(config["dataset"]).alias("dataset"), *COLUMNS)


@reader("coco_polygon")
def _coco(spark: SparkSession, config: dict) -> DataFrame:
    """With a folder ``images`` in the config, annotated names are resolved to its files, see ``coco_resolved``; unresolved images are left out."""
    rows = coco_instances(spark, config["annotations"])
    if "images" in config:
        rows = coco_resolved(spark, rows, config["images"], bool(config.get("recursive_images"))).where("image IS NOT NULL")
    else:
        rows = rows.withColumn("image", F.col("file_name"))
    return rows.select("image", "label", "polygon", "pixels", "mask_height", "mask_width")


def coco_resolved(spark: SparkSession, rows: DataFrame, images: str, recursive: bool = False) -> DataFrame:
    """``rows`` (file_name, ...) with ``image``: the file's path below the folder ``images``, null if there is none.

    A name that is no path below the folder is looked up, with ``recursive``, by its last part in all folders below; if
    several files share it, the query fails.
    """
    from .records import listing

    root = images.rstrip("/") + "/"
    files = listing(spark, images).select(F.substring_index("path", root, -1).alias("path")).where(F.lower("path").rlike(r"\.(jpg|jpeg|png|bmp)$")).withColumn("name", last_part(F.col("path")))
    wanted = rows.select("file_name").distinct().select(F.col("file_name").alias("path"), last_part(F.col("file_name")).alias("name"))
    found = resolved(wanted, files if recursive else files.withColumn("name", F.lit(None).cast("string")), "path", "name")
    found = found.select(F.col("path").alias("__wanted"), F.col("resolved").alias("image"))
    return rows.join(found, F.col("file_name") == F.col("__wanted"), "left").drop("__wanted")


@reader("voc_bbox")
def _voc(spark: SparkSession, config: dict) -> DataFrame:
    return voc_boxes(spark, config["annotations"]).select(F.col("filename").alias("image"), "label", F.when(F.col("label").isNotNull(), F.array("xmin", "ymin", "xmax", "ymax")).alias("box"))


@reader("semantic_png")
def _pairs(spark: SparkSession, config: dict) -> DataFrame:
    """Image and mask files that share a path below their folders; only their paths are read, ``png.masks`` reads the masks."""
    listed = lambda key: spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(config[key]).select("path")
    return by_relative_path(listed("images"), listed("masks"), config["images"], config["masks"]).select("image", "mask")
