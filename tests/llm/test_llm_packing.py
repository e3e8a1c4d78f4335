"""Packing: an exact round trip of token ids."""

import random
import zlib

import numpy as np
import pytest
from llm_tools import plain
from tokenizers import Tokenizer

from gleaner.llm import packing
from gleaner.llm.queries import bpe_path, op5_packing


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(bpe_path())


def check(rows, ids, size):
    """Every id of every document lies in exactly one piece, and sequences are gapless and full but for one."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == ids.keys()
    for doc, pieces in by_doc.items():
        at, own = 0, np.array(ids[doc], "<u4")
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(own)
            assert r.ids_crc32 == zlib.crc32(own[at : at + r.length].tobytes())
            at += r.length
        assert at == len(own)
    short = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
        short += at < size
    assert short <= 1
    return len(by_sequence)


def test_query_on_whole_table(spark, sf, tokenizer):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = {d: [*tokenizer.encode(t, add_special_tokens=False).ids, 0] for d, t in texts.items()}
    check(op5_packing(spark, sf).collect(), ids, 1024)


@pytest.mark.parametrize(("size", "windows", "parts", "fan_in"), [(16, 1, 1, 64), (16, 3, 7, 2), (64, 8, 9, 3), (1024, 64, 4, 64)])
def test_round_trip(spark, monkeypatch, tokenizer, size, windows, parts, fan_in):
    monkeypatch.setattr(packing, "FAN_IN", fan_in)
    rng = random.Random(size)
    texts = {i: " ".join(rng.choice(["the", "été", "x  y", "日本語", "<|endoftext|>", "\n\n", "#!", "naïve"]) for _ in range(rng.randrange(80))) for i in range(60)} | {100: None, 101: "", 102: "word " * 900}
    ids = {d: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for d, t in texts.items()}
    n = check(packing.pack(plain(spark, texts).repartition(parts), bpe_path(), size, windows).collect(), ids, size)
    assert n == -(-sum(map(len, ids.values())) // size)


def test_encoder_equals_the_tokenizer(tokenizer):
    rng = random.Random(5)
    alphabet = ["a", "B", "é", "日", "\U0001f600", " ", "  ", "\n", "\t", "1", "12345", "'s", "’", "!", "<|endoftext|>", "\u00a0", "\u2003", "\r\n", "_", "don't", "́"]
    own = packing.encoder(bpe_path())
    for _ in range(2000):
        text = "".join(rng.choices(alphabet, k=rng.randrange(20)))
        assert np.frombuffer(own.ids(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_windows_fill_best():
    out = []
    w = packing.Windows(10, 2, out.append)
    for doc, n in ((1, 7), (2, 4), (3, 3), (4, 6)):
        w.add(doc, bytes(4 * n))
    # 3 ids fit the window of document 1 exactly and 6 that of document 2
    assert [[p[0] for p in x] for x in out] == [[1, 3], [2, 4]]
    w.add(5, bytes(4 * 9))
    w.add(6, bytes(4 * 8))
    w.add(7, bytes(4 * 5))  # fits nowhere: the fullest goes out with the head of it
    assert [p[0] for p in out[-1]] == [5, 7] and len(out) == 3


#: Letters, digits, marks, emoji and contractions, and all that some library takes for white space.
PARTS = [*"abcZ's\u00e9\u4e2d\u0663\u00b2\u2167#!\u2026\U0001f642\u0301\u0903\u200d\U0001d7d8\u01c5", "<|endoftext|>", "'ll", "don't", "123"]
SPACES = [" ", " ", " ", "\n", *(chr(c) for c in (9, 11, 12, 13, 0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0xA0, 0x1680, 0x180E, 0x2000, 0x2009, 0x200B, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF, 0))]


def test_ids_are_the_tokenizer_s(tokenizer):
    """On random white space, scripts, contractions and added tokens; a text's ids are those of the unaltered library."""
    rng, enc = random.Random(5), packing.Encoder(bpe_path())
    texts = ["<|endoftext|>", "a <|endoftext|> b", "<|endoftext|", " \xa0 \xa0", "a \xa0 \xa0 b", "a \x85 b", "a\u2028 b", " a", "a ", " ", "a  b c"]
    texts += ["".join(rng.choice(SPACES if rng.random() < 0.5 else PARTS) for _ in range(rng.randint(1, 12))) for _ in range(20_000)]
    for text in texts:
        assert np.frombuffer(enc.ids(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_added_tokens_in_documents(spark, tokenizer):
    texts = ["<|endoftext|>", "one <|endoftext|> two", "a \xa0 \xa0 b", "", None]
    ids = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for i, t in enumerate(texts)}
    check(packing.pack(plain(spark, dict(enumerate(texts))), bpe_path(), 8).collect(), ids, 8)
