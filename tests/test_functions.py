"""Tokenizers, stems, hashes, primes and codecs."""

import random
import unicodedata
import uuid
from collections import Counter

import pytest
import regex
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleaner.functions import codecs, tokens, vectors
from gleaner.functions.stem import stem


def one(spark, text, expression):
    return spark.createDataFrame([(text,)], "t string").select(expression(F.col("t")).alias("x")).first().x


def test_words(spark):
    assert one(spark, "The CAT's 42nd é, a b日 - x1", tokens.words) == ["the", "cat", "42nd", "é", "b日", "x1"]
    assert one(spark, "", tokens.words) == []
    assert one(spark, None, tokens.words) is None
    assert one(spark, "Ab cD", tokens.legacy_words) == ["ab", "cd"]


def test_stemmed(spark):
    assert one(spark, "Running ponies 3rds relational", tokens.stemmed_words) == ["run", "poni", "3rds", "relat"]


@pytest.mark.parametrize(("word", "root"), [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("sing", "sing"), ("conflated", "conflat"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("conditional", "condit"), ("vietnamization", "vietnam"), ("triplicate", "triplic"), ("goodness", "good"), ("revival", "reviv"), ("adoption", "adopt"), ("probate", "probat"), ("rate", "rate"), ("controll", "control"), ("roll", "roll"), ("is", "is")])
def test_published_stems(word, root):
    assert stem(word) == root


def test_ngrams(spark):
    assert one(spark, "AbCd", lambda t: tokens.ngrams(t, 2)) == ["ab", "bc", "cd"]
    assert one(spark, "AbCd", lambda t: tokens.plain_ngrams(t, 3)) == ["abc", "bcd"]
    assert one(spark, "a", lambda t: tokens.plain_ngrams(t, 2)) == []
    assert one(spark, "éﬁx", lambda t: tokens.ngrams(t, 2)) == ["éf", "fi", "ix"]
    with pytest.raises(ValueError):
        tokens.ngrams(F.lit("x"), 0)


def test_tokenizer_names(spark):
    assert one(spark, "abc", tokens.tokenizer("ngram.3")) == ["abc"]
    assert len(one(spark, "abc", tokens.tokenizer("nghash.2.1000"))) == 2
    with pytest.raises(ValueError):
        tokens.tokenizer("nonsense")
    with pytest.raises(ValueError):
        tokens.tokenizer("ngram.x")
    assert tokens.tokenizer("nonsense", strict=False) is tokens.stemmed_words


def test_djb(spark):
    def plain(s, m):
        h = 5381
        for b in s.encode():
            h = ((h << 5) & (2**64 - 1)) ^ (h >> 2) ^ b
        return h % m

    texts = ["", "a", "ab", "日本語", "a much longer text that overflows 64 bits"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tokens.djb(F.col("t"), 1009).alias("h")).collect()
    assert {r.t: r.h for r in got} == {t: plain(t, 1009) for t in texts}


def test_primes():
    assert [n for n in range(30) if tokens.is_prime(n)] == [2, 3, 5, 7, 11, 13, 17, 19, 23, 29]
    assert [tokens.next_odd_prime(n) for n in (2, 3, 8, 1000)] == [3, 3, 11, 1009]


@given(st.integers(0, 2**32 - 1))
def test_numbers(value):
    assert codecs.decode_number(codecs.encode_number(value)) == (value, len(codecs.encode_number(value)))


@given(st.integers(1, 2**20), st.integers(1, 2**20))
def test_pairs(gap, tf):
    assert codecs.decode_pair(codecs.encode_pair(gap, tf))[:2] == (gap, tf)


@given(st.dictionaries(st.integers(1, 10**6), st.integers(1, 99), max_size=50))
def test_lists(postings):
    assert codecs.decode_list(codecs.encode_list(list(postings.items()))) == sorted(postings.items())


def test_list_errors():
    with pytest.raises(ValueError):
        codecs.encode_list([(1, 2), (1, 3)])
    with pytest.raises(ValueError):
        codecs.decode_number(b"\x80")


def test_sizes(spark):
    pairs = [(1, 1), (31, 3), (32, 3), (33, 3), (5000, 4), (1, 200), (2**21, 1)]
    got = spark.createDataFrame(pairs, "g bigint, t bigint").select("g", "t", codecs.pair_size(F.col("g"), F.col("t")).alias("n")).collect()
    assert all(r.n == len(codecs.encode_pair(r.g, r.t)) for r in got)


def test_uuids(spark):
    rng = random.Random(1)
    ids = [str(uuid.UUID(int=rng.getrandbits(128), version=4)) for _ in range(500)]
    df = spark.createDataFrame([(u,) for u in [*ids, "xyz", None]], "u string").select("u", codecs.uuid_bits(F.col("u")).alias("b"))
    got = {r.u: r.t for r in df.select("u", codecs.uuid_text(F.col("b")).alias("t")).collect()}
    assert all(got[u] == u for u in ids)
    assert got["xyz"] is None and got[None] is None
    codes = list(codecs.UUID_CODES.values())
    assert len(codes) == 17 and not any(a != b and b.startswith(a) for a in codes for b in codes)


@pytest.mark.parametrize("values", [[], [0.0], [1.5, 0.0, -2.0, 0.0], [0.0, 0.25], None])
def test_vectors(spark, values):
    df = spark.createDataFrame([(values,)], "v array<float>").select(vectors.sparse(F.col("v")).alias("s"))
    r = df.select("s", vectors.dense(F.col("s")).alias("d")).first()
    if values is None:
        assert r.s is None and r.d is None
    else:
        assert r.s.idx == [i for i, v in enumerate(values) if v] and r.s.val == [v for v in values if v]
        assert r.s.length == len(values) and r.d == values


def test_pieces(spark):
    public = pytest.importorskip("public_tokenizers")
    path = str(public.path("piece_bpe_32k.model"))
    got = one(spark, "Hello world", tokens.tokenizer(f"pieces:{path}"))
    assert "".join(got).replace("\u2581", " ").strip() == "Hello world" and len(got) > 1
    assert one(spark, None, tokens.tokenizer(f"pieces:{path}")) is None


def test_counted_ngrams_are_those_of_all_texts_in_bounded_memory(spark, monkeypatch):
    texts = ["abc\r\nab", "ééx", "\U0001f1e9\U0001f1ea\U0001f468‍\U0001f469", "각각 가", "ﬁx Ⅷ", "", "a", None, "क्षि", "ab̈" * 9, "xyz" * 50]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for piece, most in ((1 << 16, 200_000), (4, 3)):  # both also where parts and counts are given out often
        monkeypatch.setattr(tokens, "PIECE", piece)
        monkeypatch.setattr(tokens, "MOST_GRAMS", most)
        for t in filter(None, texts):
            whole = unicodedata.normalize("NFKC", t.lower())
            assert [c for part in tokens.clusters(t) for c in part] == regex.findall(r"\X", whole)
        for n in (1, 2, 3):
            want = Counter(g for (gs,) in df.select(tokens.ngrams(F.col("text"), n)).collect() for g in gs or [])
            assert {r.gram: r.n for r in tokens.ngram_counts(df, n).collect()} == want


def test_lists_as_arrays_are_the_plain_codec(spark):
    import numpy as np
    import pandas as pd

    r = random.Random(3)
    for _ in range(300):
        lists = [None if r.random() < 0.1 else [(d, r.choice([1, 2, 3, 4, 7, 8, 11, 100, 20000])) for d in sorted(r.sample(range(1, r.choice([50, 2**33])), r.randint(0, 40)))] for _ in range(5)]
        columns = [pd.Series([None if x is None else np.array([p[k] for p in x], np.int64) for x in lists], dtype=object) for k in (0, 1)]
        data = list(codecs._encoded(*columns))
        assert data == [None if x is None else codecs.encode_list(x) for x in lists]
        for x, b in zip(lists, data, strict=True):
            if x is not None:
                assert list(zip(*(a.tolist() for a in codecs.decode_arrays(b)), strict=True)) == x
                if len(b) > 1:
                    with pytest.raises(ValueError):
                        codecs.decode_arrays(b[:-1])
    rows = [(1, [(3, 1), (90, 400)]), (2, []), (3, None), (4, [(i, 4 + i % 3) for i in range(1, 200)])]
    df = spark.createDataFrame(rows, "k int, p array<struct<doc_int:bigint,tf:bigint>>")
    back = df.withColumn("q", codecs.decoded_list(codecs.encoded_list(F.col("p.doc_int"), F.col("p.tf")))).collect()
    assert all(x.p == x.q for x in back)


def test_plain_ngrams_are_counted_before_they_are_rows(spark, monkeypatch):
    from gleaner.plans import queries

    texts = ["AbCabc", "", None, "a", "ab", "\u00e9\U0001f468\u200d\U0001f469 \U0001f468", "a\0b\0", "\0\0\0", "\u0130I", "xyz" * 50, "".join(map(chr, range(0x4E00, 0x5E00)))]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for n in (1, 2, 3, 6):
        want = Counter(g for (gs,) in df.select(tokens.plain_ngrams(F.col("text"), n)).collect() for g in gs or [])
        assert {r.gram: r.n for r in tokens.plain_ngram_counts(df, n).collect()} == want
        lower = [r.t or "" for r in df.select(F.lower("text").alias("t")).collect()]
        for run, bins in ((1 << 20, 1 << 22), (3, 1 << 22), (3, 1)):  # over the ends of parts, with and without bins
            monkeypatch.setattr(tokens, "RUN", run)
            monkeypatch.setattr(tokens, "MOST_BINS", bins)
            assert sum((Counter(c) for c in tokens.windows(lower, n)), Counter()) == want
    monkeypatch.setattr(tokens, "TEXTS", 2)
    monkeypatch.setattr(tokens, "MOST_GRAMS", 3)
    assert {r.gram: r.n for r in tokens.plain_ngram_counts(df, 6).collect()} == want
    plan = queries.nghash_counts(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Generate" not in plan
