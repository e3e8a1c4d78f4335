"""Near-duplicates against all pairs of exact shingle sets."""

import random
import re

import pytest
from llm_tools import plain
from test_llm_components import union_find

from gleaner.llm import neardup
from gleaner.llm.queries import op10_near_duplicates


def shingles(text, k):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute(texts, k, percent=80):
    sets = {d: shingles(t, k) for d, t in texts.items()}
    by_shingle = {}
    for d, s in sets.items():
        for x in s:
            by_shingle.setdefault(x, []).append(d)
    pairs = {(a, b) for ds in by_shingle.values() for a in ds for b in ds if a < b}
    links = [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    component = union_find(links)
    return {d: (len(s), component.get(d, d)) for d, s in sets.items()}


def got(rows):
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in rows}


def test_query_on_whole_table(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert got(op10_near_duplicates(spark, sf).collect()) == brute(texts, 4)


def family(rng, start, n, words, changes):
    """Texts that differ in a few words from one another, from slightly to much."""
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    out = {}
    for i in range(n):
        own = list(base)
        for _ in range(rng.choice(changes)):
            own[rng.randrange(words)] = f"x{rng.randrange(5000)}"
        out[start + i] = " ".join(own)
    return out


@pytest.fixture(scope="module")
def families():
    rng = random.Random(11)
    texts = {}
    for f in range(8):
        texts |= family(rng, 1000 * f, 25, 60 + 20 * f, (0, 1, 2, 3, 6))
    shared = " ".join(f"s{i}" for i in range(60))  # a passage that unrelated texts have
    for i in range(40):
        texts[90_000 + i] = shared + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 40)))
    for i in range(60):  # a group of copies, and one of a short text
        texts[95_000 + i], texts[96_000 + i] = "copy " * 3 + shared[:80], "two words"
    texts |= {99_001: "Two WORDS", 99_002: "two words\n", 99_003: "", 99_004: None, 99_005: "É tu", 99_006: "é tu"}
    return texts


@pytest.mark.parametrize(("k", "percent", "block", "weight"), [(4, 80, neardup.BLOCK, neardup.WEIGHT), (5, 80, 7, 1 << 21), (4, 80, 5, 300)])
def test_families(spark, families, k, percent, block, weight):
    rows = neardup.near_duplicates(plain(spark, families), k, percent, block=block, weight=weight).collect()
    assert got(rows) == brute(families, k, percent)


def test_at_the_threshold(spark):
    """Sets of exactly 0.8 link; one shingle less does not."""
    base = [f"b{i}" for i in range(21)]
    texts = {1: " ".join(base), 2: " ".join(base[:-2] + ["x", "y"]), 3: " ".join(base[:-3] + ["p", "q", "r"])}
    want = brute(texts, 4)
    assert want[2][1] == 1 and want[3][1] == 3  # 16 of 20, and 15 of 21 and less
    assert got(neardup.near_duplicates(plain(spark, texts), 4).collect()) == want


def test_an_id_of_several_texts_is_one_node(spark):
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (2, "h i j k l m n"), (3, "h i j k l m n")]
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.component_id for r in out} == {1}
