"""Helpers shared by the training-data operators: scratch tables, ordered buckets, Arrow passes, the training fold."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklab.session import cut_lineage

__all__ = ["cut_lineage", "free_name", "held_out", "load", "ordered_bucket", "quantile_bounds", "shuffle_width", "with_struct", "written"]


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a temporary one only under a local master (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        import tempfile

        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_folder(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, path: str | None = None, codec: str = "zstd") -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage and outlives lost executors."""
    path = path or new_path(df.sparkSession, label)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held_out(doc_id: str | Column) -> Column:
    """The fold that no model may learn from: crc32 of the id as text, remainder 2 by 4. A null id is not held out."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that the table does not use yet (names compare without case)."""
    used = {c.lower() for c in df.columns}
    while wanted.lower() in used:
        wanted += "_"
    return wanted


def quantile_bounds(df: DataFrame, key: str, buckets: int) -> list[int]:
    """Ascending distinct upper bounds that cut a whole-number key into about equal buckets; every bound is a key of the table."""
    if buckets < 2:
        return []
    shares = [k / buckets for k in range(1, buckets)]
    found = df.select(F.percentile_approx(key, shares, max(10_000, 20 * buckets)).alias("q")).first()["q"]
    return sorted({int(x) for x in found or []})


def ordered_bucket(key: Column, bounds: Sequence[int]) -> Column:
    """Number of bounds below the key, by binary search inside the expression; bucket k holds (bound k-1, bound k]. Null: 0."""
    if not bounds:
        return F.lit(0)
    table = F.array(*[F.lit(b) for b in bounds]) if len(bounds) <= 64 else F.from_json(F.lit(str(list(bounds))), "array<bigint>")
    halving = F.sequence(F.lit(1), F.lit(len(bounds).bit_length()))

    def narrow(span: Column, _: Column) -> Column:
        middle = F.floor((span["lo"] + span["hi"]) / 2).cast("int")
        below = (span["lo"] < span["hi"]) & (F.get(table, middle) < key)
        return F.when(span["lo"] >= span["hi"], span).otherwise(
            F.struct(F.when(below, middle + 1).otherwise(span["lo"]).alias("lo"), F.when(below, span["hi"]).otherwise(middle).alias("hi"))
        )

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))
    return F.when(key.isNull(), F.lit(0)).otherwise(F.aggregate(halving, start, narrow, lambda span: span["lo"]))


def with_struct(
    df: DataFrame,
    inputs: Sequence[str],
    name: str,
    schema: T.StructType,
    work: Callable[[], Callable[..., pa.StructArray]],
) -> DataFrame:
    """Append one struct column computed from Arrow batches; all other columns pass through untouched.

    ``work`` is called once per task (load a model there) and returns a function from the input arrays to a struct array.
    """
    out = T.StructType([*df.schema.fields, T.StructField(name, schema)])
    inputs = list(inputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = work()
        for batch in batches:
            made = apply(*[batch.column(batch.schema.get_field_index(c)) for c in inputs])
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, name])

    return df.mapInArrow(run, out)
