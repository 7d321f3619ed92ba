"""Report sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nest(report: DataFrame, key: str, label: Sequence[str]) -> DataFrame:
    """One document per recording: a sorted list of labelled records (reports hold aggregates, not rows)."""
    rest = [c for c in report.columns if c != key]
    first = [*label, *[c for c in rest if c not in label]]
    return report.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*first))).alias("records"))


def write_report(report: DataFrame, path: str, key: str = "rec", label: Sequence[str] = ()) -> None:
    """Nested JSON, one directory per recording."""
    doc = nest(report, key, label or [c for c in report.columns if c != key][:1])
    doc.repartition(key).write.mode("overwrite").partitionBy(key).json(path)


def write_rows(rows: DataFrame, path: str, key: str, order: Sequence[str]) -> None:
    """CSV per recording in stable row order; range partitioning splits a large recording over files."""
    text = rows.select(*[F.array_join(c, "|").alias(c) if t.startswith("array") else F.col(c) for c, t in rows.dtypes])
    ranged = text.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    ranged.write.mode("overwrite").partitionBy(key).csv(path, header=True)
