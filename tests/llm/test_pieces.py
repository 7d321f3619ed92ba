"""Encoding by pieces against the library's own encoding of whole texts."""

import itertools
import sys

import public_tokenizers

from tracklab.llm import token_output
from tracklab.llm.queries import VOCABULARY


def test_white_space_of_all_kinds():
    own = token_output.PieceEncoder(public_tokenizers.path(VOCABULARY))
    assert token_output.OTHER_SPACE == tuple(c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace() and c not in " \n")
    gaps = ["".join(g) for n in (1, 2, 3) for g in itertools.product(" \n\t ", repeat=n)] + list(token_output.OTHER_SPACE)
    texts = [f"{a}{gap}{b}" for gap in gaps for a, b in (("one", "two"), ("", "word."), ("mark,", ""), ("é", "7x"))]
    texts += [f"same words {gap}again {gap} and again" for gap in gaps]
    for _ in range(3):
        for text in texts:
            assert own.encode(text) == own._plain(text), repr(text)
    assert not {"", "\n"} & (own.memo.keys() | own.new.keys())


def test_words_need_no_look_up_of_the_model():
    own = token_output.PieceEncoder(public_tokenizers.path(VOCABULARY))
    want = own._plain("alpha beta gamma")
    own.whole = None
    assert own.encode("alpha beta gamma") == want


def test_known_words_with_marks_need_no_look_up_of_the_model():
    own = token_output.PieceEncoder(public_tokenizers.path(VOCABULARY))
    text = "one gamma gamma, gamma. gamma"
    want = own._plain(text)
    assert own.encode("one gamma") + own.encode("one gamma") == 2 * own._plain("one gamma")
    assert "gamma" in own.memo
    asked, units = [], own.units
    own.units = lambda word: asked.append(word) or units(word)
    assert own.encode(text) == want
    assert [w for w in asked if "gamma" in w] == []
