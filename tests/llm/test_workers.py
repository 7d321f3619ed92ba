"""Python workers and what they hold: each pass of a stage has a worker of its own on every core."""

import public_tokenizers
import pytest

from tracklab.llm import decontaminate, token_output
from tracklab.llm.queries import VOCABULARY


@pytest.mark.parametrize("shard_words", [200_000, 10])
def test_passages_are_cut_in_the_pass_of_the_last_shard(spark, shard_words):
    items = [("a", " ".join(f"a{k}" for k in range(40))), ("b", " ".join(f"b{k}" for k in range(14)))]
    own = " ".join(f"w{k}" for k in range(2000))
    texts = [own, f"{own} {items[0][1]} end", f"{items[1][1]} {own}", f"{own} {items[0][1]}, {items[1][1]}. {own}", items[0][1], None, "", "é " + own]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id string, text string").coalesce(1)
    kept = decontaminate.decontaminate(docs, bench, max_span=26, shard_words=shard_words)
    passes = 1 if shard_words > 100 else 2
    assert kept._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == passes
    want = {0: own, 1: f"{own}  end", 2: texts[2], 3: f"{own} . {own}", 5: None, 6: "", 7: texts[7]}
    assert {r.doc_id: r.text for r in kept.collect()} == want
    assert kept.columns == docs.columns


def test_encoders_are_forgotten():
    token_output.encoder(public_tokenizers.path(VOCABULARY))
    token_output.release()
    assert not token_output._encoders
