"""Readers of annotated image sets: instance polygons, box files, line-wise metadata and file pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import kept_box
from ..operators.masks import run_lengths, run_mask

COCO = (
    "images array<struct<id:bigint,file_name:string,width:int,height:int>>, categories array<struct<id:bigint,name:string>>, "
    "annotations array<struct<id:bigint,image_id:bigint,category_id:bigint,segmentation:string>>"
)


def coco_instances(spark: SparkSession, path: str) -> DataFrame:
    """Every image with its shapes (none: nulls): image_id, file_name, label, slot, polygon of x1, y1, x2, ... or pixels.

    ``pixels`` is the mask by rows (0 and 1) of a segmentation given as run lengths, plain or compressed, with its
    ``mask_height`` and ``mask_width``; one whose counts do not fill its size fails the query that reads it. Categories
    that share a name share a slot; polygons of fewer than three points are dropped.
    """
    doc = spark.read.schema(COCO).json(path, multiLine=True)
    images = doc.select(F.inline("images")).select(F.col("id").alias("image_id"), "file_name", "width", "height")
    names = doc.select(F.inline("categories")).select(F.col("id").alias("category_id"), F.col("name").alias("label"))
    slots = names.select("label").distinct().agg(F.array_sort(F.collect_list("label")).alias("all"))
    names = names.crossJoin(F.broadcast(slots)).select("category_id", "label", F.array_position("all", F.col("label")).cast("int").alias("slot"))  # one row of label names
    drawn = doc.select(F.inline("annotations")).select("image_id", "category_id", F.trim("segmentation").alias("text"))
    polygons = drawn.where("text LIKE '[%'").select("image_id", "category_id", F.explode(F.from_json("text", "array<array<double>>")).alias("polygon")).where(F.size("polygon") >= 6)
    # counts are read as text: a list's own text ends with a bracket, after which the compressed form would go on
    runs = drawn.where("text LIKE '{%'").select("image_id", "category_id", F.from_json("text", "counts string, size array<int>").alias("r"))
    counts = F.when(F.col("r.counts").endswith("]"), F.from_json("r.counts", "array<bigint>")).otherwise(run_lengths(F.col("r.counts")))
    runs = runs.select("image_id", "category_id", counts.alias("counts"), F.get("r.size", F.lit(0)).alias("mask_height"), F.get("r.size", F.lit(1)).alias("mask_width"))
    pixels = F.coalesce(run_mask(F.col("counts"), F.col("mask_height"), F.col("mask_width")), F.raise_error(F.concat(F.lit("run lengths do not fill their size in image "), F.col("image_id").cast("string"))).cast("array<int>"))
    shapes = polygons.unionByName(runs.select("image_id", "category_id", pixels.alias("pixels"), "mask_height", "mask_width"), allowMissingColumns=True)
    return images.join(shapes.join(names, "category_id"), "image_id", "left").drop("category_id")


def voc_boxes(spark: SparkSession, path: str) -> DataFrame:
    """Boxes of annotation files, without incomplete or empty ones; an image that keeps no box has one row of nulls."""
    schema = "filename string, object array<struct<name:string,bndbox:struct<xmin:double,ymin:double,xmax:double,ymax:double>>>"
    made = spark.read.schema(schema).option("rowTag", "annotation").format("xml").load(path)
    fine = lambda o: kept_box(o["bndbox"]["xmin"], o["bndbox"]["ymin"], o["bndbox"]["xmax"], o["bndbox"]["ymax"])
    return made.select("filename", F.explode_outer(F.filter("object", fine)).alias("o")).select("filename", F.col("o.name").alias("label"), "o.bndbox.*")


def by_relative_path(images: DataFrame, masks: DataFrame, image_root: str, mask_root: str, path: str = "path", strict: bool = True) -> DataFrame:
    """Images and masks with the same path below their roots but for the ending: stem, image, mask. Unmatched files are left out.

    ``strict``: no pair at all fails the query that reads it, as the folders then do not belong together.
    """
    stem = lambda root: F.regexp_replace(F.substring_index(F.col(path), root.rstrip("/") + "/", -1), r"\.[^./]*$", "")
    pairs = images.select(stem(image_root).alias("stem"), F.col(path).alias("image")).join(masks.select(stem(mask_root).alias("stem"), F.col(path).alias("mask")), "stem")
    if not strict:
        return pairs
    none = pairs.agg((F.count(F.lit(1)) == 0).alias("none")).where(F.when(F.col("none"), F.raise_error(F.lit("no image has a mask")).cast("boolean")).otherwise(F.lit(False)))
    return pairs.unionByName(none.select(*[F.lit(None).cast("string").alias(c) for c in pairs.columns]))  # one row is looked at, none is added


def trimmed_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("id")).where("id <> ''")
