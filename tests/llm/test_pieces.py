import itertools
import math
import random

import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from progscan.llm import pieces as P
from tests.llm.helpers import ODD, documents

MODEL = P.read_model()
CODEC = P.Codec(MODEL)
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=P.MODEL)
SMALL = P.Codec(MODEL)

texts = st.text(st.one_of(st.sampled_from("  \n\tthe aeioursn.,!0▁é漢字🎉"), st.characters(exclude_categories=["Cs"])),
                max_size=60)


@settings(max_examples=400, deadline=None)
@given(texts)
def test_same_ids_as_the_library(text):
    assert CODEC.encode(text).tolist() == LIBRARY.encode(text)
    assert CODEC.decode(LIBRARY.encode(text)) == text.replace(P.SPACE, " ")


def test_long_stretch_without_spaces():
    """Nothing converges by construction here: the window has to find where paths meet."""
    rng = random.Random(1)
    text = "".join(rng.choice(["the", "ing", "er", "an", "ation", "x", "q", "0"]) for _ in range(4000))
    commits = []
    got = list(CODEC.viterbi.pieces(text, commits))
    assert "".join(got) == text and LIBRARY.encode(text, out_type=str) == [P.SPACE + got[0], *got[1:]] or \
        LIBRARY.encode(text) == CODEC.encode(text).tolist()
    assert len(commits) > 100 and max(b - a for a, b in itertools.pairwise([0, *commits])) < 40 * CODEC.v.longest
    assert CODEC.encode(" " * 200 + "x" * 500).tolist() == LIBRARY.encode(" " * 200 + "x" * 500)


def test_unigram_scores_are_maximal():
    """A hand-made unigram vocabulary against all segmentations."""
    v = object.__new__(P.Vocabulary)
    words = ["a", "b", "c", "ab", "bc", "abc", "ca", "cab", "bb", "aab"]
    rng = random.Random(3)
    v.kind, v.pieces = "unigram", {w: i for i, w in enumerate(words)}
    v.scores = {w: math.log(rng.random()) for w in words}
    v.longest, v.least = 3, min(v.scores.values()) - P.UNKNOWN_PENALTY

    def best(text):
        if not text:
            return 0.0
        return max(v.scores.get(text[:n], v.least if n == 1 else -math.inf) + best(text[n:])
                   for n in range(1, min(3, len(text)) + 1))

    for _ in range(60):
        text = "".join(rng.choice("abcd") for _ in range(rng.randint(0, 14)))
        got = list(P.StreamingViterbi(v).pieces(text))
        assert "".join(got) == text
        assert abs(sum(v.scores.get(p, v.least) for p in got) - best(text)) < 1e-9


def test_frame(spark):
    d = documents(spark, ODD).withColumn("ids", F.lit("clash")).withColumn("_encoded", F.lit(1))
    rows = P.decode(P.encode(d, round_trip="ok"), text="back").collect()
    assert len(rows) == len(ODD) and all(r.ok and r.back == (r.text or "") for r in rows)
    assert all(list(r.ids) == LIBRARY.encode(r.text or "") for r in rows)
    assert P.encode(d.where("false")).count() == 0


def test_a_walk_over_known_characters_looks_nothing_up():
    """The pieces that end at a boundary come from the automaton, not from a lookup of every substring."""
    v = P.StreamingViterbi(CODEC.v)
    text = "▁the▁interesting▁ñandú▁漢字"
    first = list(v.pieces(text))
    v.table = None
    assert list(v.pieces(text[:-2])) == first[:-2] and first[-2:] == ["漢", "字"]


@settings(max_examples=100, deadline=None)
@given(texts)
def test_same_ids_when_the_automaton_is_forgotten(text):
    codec, items = SMALL, P.CACHE_ITEMS
    P.CACHE_ITEMS = 5
    try:
        assert codec.encode(text * 3).tolist() == LIBRARY.encode(text * 3)
    finally:
        P.CACHE_ITEMS = items
    assert codec.viterbi.steps <= 10
