"""Stupid backoff against counts in plain Python, and against SQL."""

import math
import random
import re
from collections import Counter

import pytest
from compare import same
from llm_tools import plain

from gleaner.llm import lm, queries


def brute(texts, order, backoff=0.4, least=2):
    words = {d: re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for d, t in texts.items()}
    counts = Counter(tuple(w[i : i + n]) for w in words.values() for n in range(1, order + 1) for i in range(len(w) - n + 1))
    total = sum(map(len, words.values()))

    def of(gram):
        if len(gram) == 1:
            return math.log(counts[gram] / total)
        if counts[gram] >= least:
            return math.log(counts[gram] / counts[gram[:-1]])
        return math.log(backoff) + of(gram[1:])

    return {d: (len(w), sum(of(tuple(w[max(0, i - order + 1) : i + 1])) for i in range(len(w)))) for d, w in words.items()}


@pytest.mark.parametrize(("order", "least", "block_words", "parts"), [(1, 1, 10**6, 1), (2, 2, 10**6, 2), (3, 1, 50, 3), (4, 2, 7, 5)])
def test_orders_and_blocks(spark, order, least, block_words, parts):
    rng = random.Random(order)
    vocabulary = ["the", "The", "a", "of", "é", "日本", "x,", *map(str, range(30))]
    texts = {i: " ".join(rng.choices(vocabulary, [9] * 7 + [1] * 30, k=rng.randrange(60))) for i in range(80)} | {100: None, 101: "  \n", 102: "the"}
    want = brute(texts, order, least=least)
    got = lm.score(plain(spark, texts), order, least=least, block_words=block_words, parts=parts).collect()
    assert {r.doc_id: r.n_words for r in got} == {d: n for d, (n, _) in want.items()}
    for r in got:
        n, s = want[r.doc_id]
        assert r.log_score == pytest.approx(s, rel=1e-9, abs=1e-9)
        assert r.mean_log_score == (pytest.approx(s / n) if n else None)


def test_query_matches_sql(spark, sf):
    same(spark, queries.op4_stupid_backoff, queries.oracle_sql()["op4_stupid_backoff"], sf)


def test_counts_are_of_the_whole_corpus(spark):
    """A score changes with the counts of other documents."""
    one = {1: "a b a b c"}
    alone = lm.score(plain(spark, one), parts=2).first().log_score
    more = {r.doc_id: r.log_score for r in lm.score(plain(spark, one | {2: "a c a c a c"}), parts=2).collect()}
    assert more[1] != alone
