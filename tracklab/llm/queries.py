"""Thin queries over the training-data operators, each on its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklab.llm import decontaminate, fim, language, merkle, mixing, preference, quality, resampling, secrets, simhash, token_output, toxicity, warc
from tracklab.llm.common import held_out, load, written

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
TOXIC_FROM = 0.3
GOOD_FROM = 0.7
COVERAGE = 0.05


def op1_source_mixing(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents")
    got = mixing.with_copies(docs.select("doc_id", "source"), mixing.plan(docs), "mix")
    return got.select("doc_id", "source", F.round("mix.weight", 9).alias("weight"), F.col("mix.full").alias("full_epochs"), "mix.partial", "mix.copies", "mix.place")


def op2_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents")
    got = quality.with_score(docs.select("doc_id", "text"), quality.fit(docs, load(spark, sf, "labels")))
    score = F.col("quality.score")
    return got.select("doc_id", held_out("doc_id").alias("held_out"), score.alias("score"), (score >= GOOD_FROM).cast("int").alias("predicted"))


def op3_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents").select("doc_id", "text")
    got = decontaminate.find_hits(docs, load(spark, sf, "benchmark"), "hits")
    items = F.col("hits")["items"]
    return got.select(
        "doc_id",
        "hits.n_words",
        "hits.n_hit",
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        ((F.col("hits.n_hit") > 0) & (20 * F.col("hits.n_hit") >= F.col("hits.n_words"))).alias("contaminated"),
    )


def op4_merkle_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    got = merkle.compare_edits(load(spark, sf, "documents"))
    own = F.col("fingerprint")
    return got.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        merkle.likeness(own, F.col("edited_fingerprint")).alias("near_edited"),
        merkle.likeness(own, F.col("next_fingerprint")).alias("near_next"),
        F.array_join(merkle.changed_sections(own, F.col("edited_fingerprint")), ",").alias("edited_sections"),
    )


def op5_simhash(spark: SparkSession, sf: str) -> DataFrame:
    got = simhash.near_duplicates(load(spark, sf, "documents"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_token_files(spark: SparkSession, sf: str) -> DataFrame:
    return token_output.token_digest(load(spark, sf, "documents"), public_tokenizers.path(VOCABULARY), END_ID)


def op7_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    got = secrets.scan(load(spark, sf, "documents").select("doc_id", "text"), "found")
    base = F.col("found.base")
    count = lambda kind: F.size(F.filter(base, lambda s: s["rank"] == secrets.KINDS.index(kind))).cast("long")
    return got.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(secrets.joined(base), 256).alias("base_sha256"),
        secrets.joined(F.concat(base, F.col("found.weak"))).alias("spans"),
    )


def op8_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents")
    got = toxicity.with_score(docs.select("doc_id", "text"), toxicity.fit(docs, load(spark, sf, "labels")))
    score = F.col("toxicity.score")
    return got.select("doc_id", held_out("doc_id").alias("held_out"), score.alias("score"), (score >= TOXIC_FROM).cast("int").alias("predicted"))


def op9_language(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents")
    got = language.with_language(docs.select("doc_id", "text"), language.fit(docs))
    return got.select("doc_id", held_out("doc_id").alias("held_out"), F.col("language.lang").alias("lang_pred"), "language.score", "language.rejected")


def op10_preference_format(spark: SparkSession, sf: str) -> DataFrame:
    pairs = preference.pair_by_opening(load(spark, sf, "conversations"))
    made = preference.format_pairs(pairs.withColumn("pair_id", F.struct("pair_id", "chosen_id", "rejected_id")))
    return made.select("pair_id.*", *[c for c in made.columns if c != "pair_id"])


def op11_warc_transactions(spark: SparkSession, sf: str) -> DataFrame:
    folder = warc.write_archives(load(spark, sf, "pages"))
    captures = warc.assemble(written(warc.read_records(spark, folder), "warc-records"))
    own = F.col("metadata")[0]["fields"]
    return captures.select(
        own["page-id"].try_cast("long").alias("page_id"),
        "head.payload_bytes",
        "head.payload_digest",
        F.col("head.type").alias("record_type"),
        own["refers-to-page"].cast("long").alias("refers_to"),
    )


def op12_fill_in_middle(spark: SparkSession, sf: str) -> DataFrame:
    got = fim.with_cut(load(spark, sf, "documents").select("doc_id", "text"))
    output, form = F.col("fim.output"), F.col("fim.form")
    return got.select(
        "doc_id",
        "fim.n",
        "fim.form",
        F.col("fim.prefix_units").alias("prefix_chars"),
        F.col("fim.middle_units").alias("middle_chars"),
        F.sha2(output, 256).alias("output_sha256"),
        F.sha2(fim.restored(output, form), 256).alias("restored_sha256"),
    )


def op13_importance_resampling(spark: SparkSession, sf: str) -> DataFrame:
    got = resampling.resample(load(spark, sf, "documents"), load(spark, sf, "benchmark"))
    return got.select("doc_id", "n_features", "weight", "score", "rank")


def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_source_mixing,
        op2_quality,
        op3_decontamination,
        op4_merkle_fingerprints,
        op5_simhash,
        op6_token_files,
        op7_secret_scan,
        op8_toxicity,
        op9_language,
        op10_preference_format,
        op11_warc_transactions,
        op12_fill_in_middle,
        op13_importance_resampling,
        pipeline,
    )
}
