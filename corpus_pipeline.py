"""From raw documents to token files: toxicity, near-duplicates, benchmark passages, source mixing, token output.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read back as the documents of the next one. All
but the last return the columns of the table they were given. The stages keep the operators' rules for nulls, empty texts,
repeated rows and other columns; an empty table passes through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklab.llm import decontaminate, mixing, near_copies, token_output, toxicity
from tracklab.llm.common import free_name, load, written
from tracklab.llm.queries import COVERAGE, END_ID, TOXIC_FROM, VOCABULARY

#: The stages need SQL-free steps (a trained model, an automaton, a vocabulary); tests restate them by brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below the limit."""
    name = free_name(docs, "toxicity")
    scored = toxicity.with_score(docs, toxicity.fit(docs, load(spark, sf_dir, "labels")), name)
    return scored.where(F.col(f"{name}.score") < TOXIC_FROM).drop(name)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: a similarity of 0.8 or more over shingles of five words."""
    return near_copies.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows cover less than a twentieth, without the passages of more than two windows in them."""
    return decontaminate.decontaminate(docs, load(spark, sf_dir, "benchmark"), COVERAGE, 2 * decontaminate.WINDOW)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once for each of its copies; the budget reads every source at least once, so none is lost."""
    return mixing.realise(docs, mixing.plan(docs))


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) read back from the token files; a copy is a document of its own."""
    return token_output.token_digest(docs, public_tokenizers.path(VOCABULARY), END_ID)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("source_mixing", mix_sources),
    ("token_output", write_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name, codec="snappy")
    return docs
