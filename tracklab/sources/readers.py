"""Typed readers for the score, manifest, annotation and topic inputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklab.plans.segments import SEGMENT_ROWS, dense_index
from tracklab.schemas import ANNOTATION_FILE, MANIFEST_FILE, SCORE_CSV


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """Per-frame score CSV: empty numbers become NULL, flags become an array."""
    raw = spark.read.schema(SCORE_CSV).csv(path, header=True, nullValue="", enforceSchema=False, mode="FAILFAST")
    return with_flags(raw)


def with_flags(raw: DataFrame) -> DataFrame:
    parts = F.when(F.coalesce(F.col("flags"), F.lit("")) == "", F.array().cast("array<string>"))
    return raw.withColumn("flags", parts.otherwise(F.split("flags", r"\|")))


def metric_rows(scores: DataFrame) -> DataFrame:
    """Rows entering the metrics: two rows found, with offset and heading."""
    return scores.where((F.col("cls") == "two_row") & F.col("offset").isNotNull() & F.col("heading").isNotNull())


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Frames of manifest JSON documents, one row per frame, tagged by recording."""
    docs = spark.read.schema(MANIFEST_FILE).json(path, multiLine=True)
    return docs.select(F.col("meta.bag").alias("rec"), F.inline("frames"))


def parse_frames(docs: DataFrame, column: str, schema: str) -> DataFrame:
    """The same for JSON held in a column: one row per element of its array."""
    rest = [c for c in docs.columns if c != column]
    return docs.select(*rest, F.inline(F.from_json(column, schema)))


def read_annotations(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Images with their annotations pooled over source splits; a repeated file name is an error."""
    docs = None
    for split, path in paths.items():
        d = spark.read.schema(ANNOTATION_FILE).json(path, multiLine=True).withColumn("orig_split", F.lit(split))
        docs = d if docs is None else docs.unionByName(d)
    images = docs.select("orig_split", F.explode("images").alias("m")).select("orig_split", "m.*")
    anns = docs.select("orig_split", F.explode("annotations").alias("a")).select(
        "orig_split", F.col("a.image_id").alias("id"), F.struct("a.category_id", "a.segmentation", "a.bbox").alias("annotation")
    )
    return join_annotations(images, anns, ["orig_split", "id"])


def join_annotations(images: DataFrame, annotations: DataFrame, on: Sequence[str], name: str = "file_name") -> DataFrame:
    """Left join of images and annotations, failing when a file name occurs twice."""
    twice = images.groupBy(name).agg(F.count(F.lit(1)).alias("_n"))
    fail = F.raise_error(F.concat(F.lit("file name occurs twice: "), F.col(name))).cast("boolean")
    checked = images.join(twice, name).where(F.when(F.col("_n") == 1, F.lit(True)).otherwise(fail)).drop("_n")
    return checked.join(annotations, list(on), "left")


def merge_sources(
    parts: Sequence[DataFrame], keys: Sequence[str], order: Sequence[str], session: str
) -> DataFrame:
    """Consecutive files of one session as one ordered series; files of different sessions are refused."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    span = out.groupBy(*keys).agg(F.min(session).alias("_a"), F.max(session).alias("_b"))
    fail = F.raise_error(F.lit("files belong to different sessions")).cast("boolean")
    span = span.where(F.when(F.col("_a") == F.col("_b"), F.lit(True)).otherwise(fail)).select(*keys)
    return dense_index(out.join(span, list(keys)), keys, order)


def topic(messages: DataFrame, name: str, column: str = "topic") -> DataFrame:
    """Messages of one topic, selected by name (a partition column on disk)."""
    return messages.where(F.col(column) == name)
