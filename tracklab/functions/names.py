"""Column functions on sample names and categories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed value: suffix appended to every augmented version of a sample
AUGMENTATION_SUFFIX = r"_png\.rf\..*"


def group_id(name: Column) -> Column:
    """Name shared by all augmented versions of one sample."""
    return F.regexp_replace(name, AUGMENTATION_SUFFIX, "")


def stratum(name: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """First matching prefix decides; a name that matches none is an error."""
    out = F
    for prefix, label in rules:
        out = out.when(F.lower(name).startswith(prefix), label)
    return out.otherwise(F.raise_error(F.concat(F.lit("no stratum for "), name)).cast("string"))


def collapse_classes(df: DataFrame, column: str, mapping: dict[str, int], out: str = "class_id") -> DataFrame:
    """Keep mapped categories only and rewrite them to their target id."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return df.withColumn(out, F.try_element_at(F.create_map(*pairs), F.col(column))).where(F.col(out).isNotNull())
