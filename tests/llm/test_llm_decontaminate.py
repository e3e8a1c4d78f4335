"""Overlaps against every offset of every pair, and planted substitutions."""

import itertools
import random
import re

import pyarrow as pa
import pytest
from llm_tools import plain

from gleaner.llm import decontaminate as D
from gleaner.llm.queries import op3_decontamination


def words(text):
    return re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def segment(same):
    """The best segment by 1 a match and -MISMATCH a substitution: (matches, length)."""
    best, at, score = (0, 0, 0), 0, 0
    for i, s in enumerate(same):
        if score <= 0:
            at, score = i, 0
        score += 1 if s else -D.MISMATCH
        if score > best[0]:
            best = (score, sum(same[at : i + 1]), i + 1 - at)
    return best[1:]


def seeded(doc, item, shift):
    """Whether a mask's ones agree somewhere at this offset."""
    for mask in D.MASKS:
        for p in range(max(0, -shift), min(len(item), len(doc) - shift) - len(mask) + 1):
            if all(m == "0" or doc[p + shift + i] == item[p + i] for i, m in enumerate(mask)):
                return True
    return False


def brute(texts, items):
    out = {}
    for d, text in texts.items():
        doc = words(text)
        for b, own_text in items.items():
            own = words(own_text)
            if len(own) < D.SHORTEST:
                if own and own == doc:
                    out[d, b] = len(own)
                continue
            if not set(own) & set(doc):
                continue
            best = 0
            for shift in range(-len(own), len(doc)):
                lo, hi = max(0, -shift), min(len(own), len(doc) - shift)
                same = [own[i] == doc[i + shift] for i in range(lo, hi)]
                if sum(same) < min(D.LEAST, len(own)):
                    continue
                matches, n = segment(same)
                whole = len(own) >= D.LEAST or matches == n == len(own)
                if matches >= min(D.LEAST, len(own)) and 100 * matches >= D.PERCENT * n and whole and (len(own) < D.LEAST or seeded(doc, own, shift)):
                    best = max(best, matches)
            if best:
                out[d, b] = best
    return out


def test_query_on_whole_table(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    # documents without a common run of four words have no seed of six ones in ten
    got = {(r.doc_id, r.item_id): r.matched for r in op3_decontamination(spark, sf).collect()}
    some = {d: t for d, t in texts.items() if len(words(t)) < 300 or any(k[0] == d for k in got)}
    some = dict(sorted(some.items(), key=lambda x: len(x[1] or ""))[:60])
    assert {k: v for k, v in got.items() if k[0] in some} == brute(some, items)
    assert got


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(7)
    pool = [f"w{i}" for i in range(4000)]
    items = {i: " ".join(rng.sample(pool, n)) for i, n in enumerate((40, 30, 12, 11, 8, 5, 4, 60))}
    texts = {}

    def within(words):
        return " ".join([*rng.sample(pool, 30), *words, *rng.sample(pool, 30)])

    for i, item in items.items():
        own = item.split()
        texts[100 * i] = within(own)
        texts[100 * i + 1] = within([w.upper() + "," for w in own])
        texts[100 * i + 2] = within([w if k % 8 != 5 else "other" for k, w in enumerate(own)])
        texts[100 * i + 3] = within(own[: len(own) // 2])
        texts[100 * i + 4] = within(own[::2])
        texts[100 * i + 5] = within(rng.sample(own, len(own)))
    return texts | {9000: None, 9001: "", 9002: within([])}, items


def test_planted(spark, planted):
    texts, items = planted
    rows = D.overlaps(plain(spark, texts), spark.createDataFrame(list(items.items()), "item_id bigint, text string")).collect()
    got = {(r.doc_id, r.item_id): r.matched for r in rows}
    assert got == brute(texts, items)
    for i in (0, 1, 2, 3, 4, 5, 7):
        assert (100 * i, i) in got and (100 * i + 1, i) in got
    for i in (0, 1, 7):  # a substitution every eight words
        assert (100 * i + 2, i) in got
    assert not any(d // 100 == 6 or d >= 9000 for d, _ in got)
    for r in rows:
        doc, own = words(texts[r.doc_id]), words(items[r.item_id])
        pairs = [(doc[r.doc_word + k], own[r.item_word + k]) for k in range(r.aligned)]
        assert sum(a == b for a, b in pairs) == r.matched and r.item_words == len(own)


def test_blocks_of_a_large_benchmark(spark, planted, monkeypatch):
    texts, items = planted
    own, bench = plain(spark, texts), spark.createDataFrame(list(items.items()), "item_id bigint, text string")
    want = sorted(map(tuple, D.overlaps(own, bench).collect()))
    left = sorted(r.doc_id for r in D.clean(own, bench).collect())
    monkeypatch.setattr(D, "BLOCK_BYTES", 200)
    assert sorted(map(tuple, D.overlaps(own, bench).collect())) == want
    assert sorted(r.doc_id for r in D.clean(own, bench).collect()) == left == sorted(texts.keys() - {r[0] for r in want})


def test_every_substitution_in_short_items():
    """At most a quarter of an item's words substituted, at every combination of places, and one more."""
    for n in range(5, 17):
        item = [f"w{i}" for i in range(n)]
        index = D.Index([1], [" ".join(item)], whole=D.PERCENT)
        for count in range(n // 4 + 2):
            places = list(itertools.combinations(range(n), count))
            texts = [" ".join(["before", *("other" if i in gone else w for i, w in enumerate(item)), "after"]) for gone in places]
            got = {row: (matched, aligned) for row, _, matched, aligned, _, _ in index.search(pa.array(texts))}
            assert len(got) == (len(texts) if count <= n // 4 else 0), (n, count)


def test_query_finds_short_items_with_substitutions(spark, tmp_path):
    item = "one two three four five six seven eight nine ten eleven twelve"
    plain(spark, {1: f"x {item.replace('four', 'vier')} y", 2: "one two three"}).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(5, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [(r.doc_id, r.item_id, r.matched, r.aligned) for r in op3_decontamination(spark, str(tmp_path)).collect()] == [(1, 5, 11, 12)]


def test_scripts_without_spaces_and_marks_beyond_ascii():
    """A planted sentence of each script, whole and with characters replaced."""
    items = ["人工知能の研究は二十世紀の半ばに始まり今も続いている", "机器学习是人工智能的一个重要分支它研究如何从数据中学习规律", "ประเทศไทยมีเมืองหลวงชื่อกรุงเทพมหานคร", "the—quick “brown” fox…jumps over«the»lazy　dog¿today"]
    index = D.Index(list(range(4)), items, whole=D.PERCENT)
    swapped = items[1][:4] + "乙" + items[1][5:13] + "丙" + items[1][14:]
    texts = [f"前置き。{items[0]}。そして", f"以前的文字，{swapped}！以后", f"ข้อความ{items[2]}จบ", "so: the quick brown fox jumps over the lazy dog today", "全く別の話をここに書いておく", None, ""]
    assert {r[:2] for r in index.search(pa.array(texts))} == {(i, i) for i in range(4)}
    assert [len(x) for x in index.items] == [*map(len, items[:3]), 10]


def test_items_of_few_words_count_as_whole_documents(spark):
    """And not inside other texts; several blocks of items find the same."""
    texts = {1: "Yes", 2: "yes, of course", 3: "say yes", 4: "New York City!", 5: "to new york city", 6: "", 7: None}
    items = {1: "yes", 2: "new york city", 3: "", 4: None, 5: "one two three four five six seven eight nine ten eleven twelve thirteen"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    benchmark = spark.createDataFrame(list(items.items()), "item_id bigint, text string")
    assert {(r.doc_id, r.item_id): r.matched for r in D.overlaps(docs, benchmark).collect()} == {(1, 1): 1, (4, 2): 3}
    assert {r.doc_id for r in D.clean(docs, benchmark).collect()} == {2, 3, 5, 6, 7}


def test_blocks_of_items(spark, monkeypatch):
    """Each block's table is dropped before the next is sent; the result is that of one block."""
    monkeypatch.setattr(D, "BLOCK_BYTES", 60)
    passage = "one two three four five six seven eight nine ten eleven twelve thirteen"
    texts = {i: f"{w} {passage.replace('seven', w)} {w}" for i, w in enumerate(["seven", "other", "red", "blue"])} | {9: "clean"}
    items = {i: passage.replace("ten", w) for i, w in enumerate(["ten", "x", "y", "z"])}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    benchmark = spark.createDataFrame(list(items.items()), "item_id bigint, text string")
    found = {(r.doc_id, r.item_id) for r in D.overlaps(docs, benchmark, whole=75).collect()}
    assert found == {(d, i) for d in range(4) for i in range(4)}
    assert [r.doc_id for r in D.clean(docs, benchmark, whole=75).collect()] == [9]
