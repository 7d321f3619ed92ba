"""Merkle fingerprints of documents, in DataFrame operations only.

A section is a line of the text. A paragraph is a sentence of it, or ``PARAGRAPH`` characters of a longer one. A leaf is the
MD5 of a paragraph; a section's hash is the MD5 of its leaves, the root that of the sections. Roots are equal exactly when the
texts are; where they differ, sections that differ and then their leaves tell where the edits are.

The fingerprint is text: root, ``:``, the sections joined by ``;``, each the first 8 digits of its leaves. The likeness of two
fingerprints is 1 for equal roots, else twice the shared distinct leaves over all distinct leaves of both.

Defined results: a null text is empty and has one section without leaves; texts without shared leaves have likeness 0;
repeated rows and ids are ordered by id and text; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklab.llm.common import ordered_bucket, quantile_bounds, shuffle_width

PARAGRAPH = 120
_CUT = rf"[^.!?]{{1,{PARAGRAPH}}}[.!?]?|[.!?]"


def tree(text: Column) -> Column:
    """Leaves by section: array<array<string>> of MD5 digests."""
    sections = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    return F.transform(sections, lambda s: F.transform(F.regexp_extract_all(s, F.lit(_CUT), F.lit(0)), lambda p: F.md5(p)))


def root(sections: Column) -> Column:
    return F.md5(F.array_join(F.transform(sections, lambda s: F.md5(F.array_join(s, ""))), ""))


def fingerprint(sections: Column) -> Column:
    short = F.array_join(F.transform(sections, lambda s: F.array_join(F.transform(s, lambda x: F.substring(x, 1, 8)), ",")), ";")
    return F.concat(root(sections), F.lit(":"), short)


def leaves(mark: Column) -> Column:
    """Distinct short leaves of a fingerprint."""
    return F.array_remove(F.array_distinct(F.split(F.translate(F.substring(mark, 34, 1 << 30), ";", ","), ",")), "")


def likeness(a: Column, b: Column) -> Column:
    """0 to 1, from two fingerprints alone."""
    x, y = leaves(a), leaves(b)
    both = F.size(F.array_intersect(x, y))
    total = F.size(x) + F.size(y)
    return F.when(F.substring(a, 1, 32) == F.substring(b, 1, 32), F.lit(1.0)).when(total == 0, F.lit(0.0)).otherwise(F.lit(2.0) * both / total)


def changed_sections(a: Column, b: Column) -> Column:
    """Positions (from 0) of the sections in which two fingerprints differ, those of the longer one included."""
    x, y = F.split(F.substring(a, 34, 1 << 30), ";", -1), F.split(F.substring(b, 34, 1 << 30), ";", -1)
    places = F.sequence(F.lit(0), F.greatest(F.size(x), F.size(y)) - 1)
    return F.filter(places, lambda k: ~F.get(x, k).eqNullSafe(F.get(y, k)))


def in_turn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Window]:
    """(rows with bucket and guest mark, window in descending id): a bucket of ids also holds, as guests, the rows that follow its last own one.

    Bounds are ids of the table, so the row after the lowest of a bucket is the highest of the next one, which carries the
    bound; the highest id of all follows the lowest of all.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    bounds = quantile_bounds(base, "doc_id", 4 * shuffle_width(docs.sparkSession))
    top = base.agg(F.max("doc_id")).first()[0]
    bounds = [b for b in bounds if top is None or b < top]
    own = ordered_bucket(F.col("doc_id"), bounds).cast("int")
    stay = F.struct(F.col("own").alias("bucket"), F.lit(0).alias("guest"))
    onward = F.struct((F.col("own") + 1).alias("bucket"), F.lit(1).alias("guest"))
    around = F.struct(F.lit(0).alias("bucket"), F.lit(2).alias("guest"))
    marked = base.withColumn("own", own)
    is_bound = F.get(F.array(*[F.lit(b) for b in bounds]), F.col("own")).eqNullSafe(F.col("doc_id")) if bounds else F.lit(False)
    places = F.array_compact(F.array(stay, F.when(F.col("doc_id").isNotNull() & is_bound, onward), F.when(F.col("doc_id").eqNullSafe(F.lit(top)), around)))
    rows = marked.withColumn("place", F.explode(places)).select("doc_id", "text", "place.bucket", "place.guest")
    return rows, Window.partitionBy("bucket").orderBy("guest", F.desc_nulls_last("doc_id"), "text")


def compare_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint each text and its edited form, whose second half is replaced by the start of the next document."""
    rows, order = in_turn(docs, id_col, text_col)
    seen = rows.withColumn("tree", tree(F.col("text"))).withColumn("fingerprint", fingerprint(F.col("tree"))).drop("tree")
    seen = seen.withColumn("next", F.lead(F.struct("text", "fingerprint")).over(order)).where("guest = 0")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next.text"), F.lit(1), half))
    seen = seen.select("doc_id", "text", "fingerprint", F.col("next.fingerprint").alias("next_fingerprint"), edited.alias("edited"))
    seen = seen.withColumn("tree", tree(F.col("edited"))).withColumn("edited_fingerprint", fingerprint(F.col("tree")))
    return seen.select("doc_id", "text", "edited", "fingerprint", "edited_fingerprint", "next_fingerprint")
