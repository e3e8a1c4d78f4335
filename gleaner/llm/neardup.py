"""MinHash near-duplicates: an inverted join of signature coordinates, confirmed on full shingle sets.

1. One pass makes each text's shingle set: its size, a 128-bit fingerprint and ``COORDINATES`` minima.  Texts of
   equal sets form a class and go on as its smallest doc_id.
2. A representative is posted under each (coordinate, value) key.  Two sets of similarity s agree on a
   coordinate with probability s; a pair is a candidate if it agrees on ``AGREE`` of them, which a pair at 0.8
   misses with a probability of 3e-7.
3. Prefix: with keys ordered by how many share them, two candidates share a key among the first
   COORDINATES - AGREE + 1 of each.  Only those are kept, so keys of common passages are skipped as long as a
   text has rarer ones; keys of one text alone need no list at all.
4. Each text is paired with the smallest of each of its lists; pairs are merged over lists, counted on all coordinates,
   compared by size and confirmed on full sets.  Lists whose texts these links already join are skipped.
5. What is left are lists that still hold several components, such as families of texts at 0.7 and the groups of
   copies among them.  A list is cut into blocks, and each pair of blocks is a cell: one task looks through its
   signatures for candidates across components and gives out no pairs, only the texts that have any.  Their full
   sets then meet in the cell, where every pair across components is counted exactly and a link goes out only if
   it joins two components, so rows grow with texts and not with pairs.  These links then join the first
   components.

Only texts of candidates are read again for their sets.  Hot lists are counted by map-side aggregation and joined
with skew splitting; nothing about documents reaches the driver.

Defined results: a null or empty text, or one without words, has an empty set and is linked with nothing; with
fewer words than a shingle the whole sequence is one; rows that repeat a doc_id are one node, whatever their
texts; a null doc_id gives a null component and is kept; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _spark as S
from . import _words as W
from .components import components

COORDINATES, AGREE = 64, 34
PREFIX = COORDINATES - AGREE + 1
#: Texts, and shingles, of a block of a list whose components are compared with each other.
BLOCK, WEIGHT = 4096, 1 << 21
#: Rows of ids up to which they are broadcast: 8 bytes an id, some 40 in a hash table.
MOST_BROADCAST = 250_000

_A = W.mix(np.arange(1, COORDINATES + 1, dtype=W.U) * W.U(0xD1342543DE82EF95)) | W.U(1)
_B = W.mix(np.arange(1, COORDINATES + 1, dtype=W.U) * W.U(0x2545F4914F6CDD1D))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, ascending by row and hash, and the n + 1 edges of the rows."""
    words = W.split(data, offsets, fold=True)
    at, hashes = W.grams(words, k)
    rows = words.row[at]
    few = np.flatnonzero((words.count > 0) & (words.count < k))
    if len(few):
        whole = np.zeros(len(few), W.U)
        for i, r in enumerate(few):
            for at_word in range(words.first[r], words.first[r + 1]):
                whole[i : i + 1] = whole[i : i + 1] * W.U(W._R) + words.hash[at_word]
        hashes, rows = np.concatenate([hashes, W.mix(whole + W.U(1))]), np.concatenate([rows, few])
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    hashes, rows = hashes[new], rows[new]
    return hashes, np.searchsorted(rows, np.arange(len(offsets)))


def _signatures(hashes: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """(rows, COORDINATES): the 31 leading bits of each coordinate's minimum; rows without a shingle: 0."""
    out = np.zeros((len(edges) - 1, COORDINATES), np.int32)
    full = np.flatnonzero(np.diff(edges))
    if len(full):
        for i in range(COORDINATES):
            out[full, i] = (np.minimum.reduceat(hashes * _A[i] + _B[i], edges[:-1][full]) >> W.U(33)).astype(np.int32)
    return out


def signatures(docs: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n, f1, f2 (fingerprint), minima (one per coordinate; none for an empty set)."""

    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = batch.column("doc_id")
        for lo, hi, data, offsets in W.blocks(batch.column("text")):
            hashes, edges = shingle_sets(data, offsets, k)
            n = np.diff(edges)
            keys = _signatures(hashes, edges)[n > 0]
            lengths = np.concatenate([[0], np.cumsum(np.where(n > 0, COORDINATES, 0))])
            sums = [np.zeros(len(hashes) + 1, W.U) for _ in range(2)]
            np.cumsum(W.mix(hashes + W.U(7)), out=sums[0][1:])
            np.cumsum(W.mix(hashes ^ W.U(0xABCDEF0123456789)), out=sums[1][1:])
            prints = [(s[edges[1:]] - s[edges[:-1]]).view(np.int64) for s in sums]
            yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(prints[0]), pa.array(prints[1]), pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(keys.ravel()))], ["doc_id", "n", "f1", "f2", "minima"])

    return S.map_arrow(S.documents(docs, id_col, text_col), step, "doc_id bigint, n bigint, f1 bigint, f2 bigint, minima array<int>")


def _sets(docs: DataFrame, wanted: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, shingles) of the documents in ``wanted``: broadcast up to ``MOST_BROADCAST`` ids, else joined by a shuffle."""
    wanted, seen = S.counted(wanted.distinct())
    wanted = F.broadcast(wanted) if seen["rows"] <= MOST_BROADCAST else wanted.hint("shuffle_hash")

    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = batch.column("doc_id")
        for lo, hi, data, offsets in W.blocks(batch.column("text")):
            hashes, edges = shingle_sets(data, offsets, k)
            yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(hashes.view(np.int64)))], ["doc_id", "shingles"])

    return S.map_arrow(S.documents(docs, id_col, text_col).join(wanted, "doc_id", "left_semi"), step, "doc_id bigint, shingles array<bigint>")


def _confirm(pairs: DataFrame, classes: DataFrame, docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) of representatives that are candidates by all coordinates and size and pass on full sets."""
    own = lambda c: classes.select(F.col("rep").alias(c), F.col("n").alias(f"n_{c}"), F.col("minima").alias(f"minima_{c}"))
    sized = pairs.join(own("b"), "b").join(own("a"), "a").where((100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")) & (F.size(F.array_intersect("minima_a", "minima_b")) >= AGREE))
    likely, seen = S.counted(sized.select("a", "b"))
    sets = S.kept(_sets(docs, likely.select(F.explode(F.array("a", "b")).alias("doc_id")), k, id_col, text_col))
    own = lambda c: sets.select(F.col("doc_id").alias(c), F.col("shingles").alias(f"set_{c}"))
    full = own("b").join(S.broadcast_if(likely, seen["rows"] <= MOST_BROADCAST), "b").join(own("a"), "a")
    same = F.size(F.array_intersect("set_a", "set_b"))
    return full.where((100 + percent) * same >= percent * (F.size("set_a") + F.size("set_b"))).select("a", "b")


def _prefixes(classes: DataFrame) -> DataFrame:
    """(doc_id, n, lists) of each representative: size, key and smallest text of those of its PREFIX rarest keys that others share."""
    posts = classes.select("rep", "n", F.posexplode("minima").alias("i", "least")).select("rep", "n", (F.shiftleft(F.col("i").cast("bigint"), 32) + F.col("least")).alias("key"))
    shared = posts.groupBy("key").agg(F.count("*").alias("size"), F.min("rep").alias("first")).where("size > 1")
    own = posts.join(shared, "key").groupBy("rep", "n").agg(F.array_sort(F.collect_list(F.struct("size", "key", "first"))).alias("own"))  # at most COORDINATES
    stays = F.slice("own", F.lit(1), F.greatest(F.lit(0), F.size("own") - (COORDINATES - PREFIX)))
    return own.select(F.col("rep").alias("doc_id"), "n", stays.alias("lists")).where(F.size("lists") > 0)


def _across(own: DataFrame, parts: DataFrame, classes: DataFrame, docs: DataFrame, k: int, percent: int, id_col: str, text_col: str, block: int, weight: int) -> DataFrame | None:
    """Links (a, b) of components that share a list and hold texts which are linked; None if no list holds two components."""
    stays = F.aggregate("lists", F.lit(0).cast("bigint"), lambda bits, x: bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftright(x["key"], 32).cast("int"))))
    in_parts = own.join(parts, own["doc_id"] == parts["node"], "left").select("doc_id", "n", F.coalesce("component", "doc_id").alias("component"), stays.alias("stays"), F.explode("lists").alias("list"))
    in_parts = in_parts.select("doc_id", "n", "component", "stays", "list.key")
    mixed = in_parts.groupBy("key").agg(F.count("*").alias("size"), F.sum("n").alias("weight"), F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    blocks = F.ceil(F.greatest(F.col("size") / block, F.col("weight") / weight)).cast("int")
    left, seen = S.counted(in_parts.join(mixed.select("key", blocks.alias("blocks")), "key"), cells=F.sum("blocks"))
    if not seen["rows"]:
        return None
    mine = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    cells = left.withColumn("own", mine).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("key", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "own", "doc_id", "component", "stays")
    looked = S.broadcast_if(cells, seen["cells"] <= MOST_BROADCAST).join(classes.select(F.col("rep").alias("doc_id"), "minima"), "doc_id")
    near, seen = S.counted(_by_cell(looked.select(*_CELL, "minima", "stays"), _candidates, ", ".join(f"{c} bigint" for c in _CELL)))
    sets = _sets(docs, near.select("doc_id"), k, id_col, text_col)
    met = S.broadcast_if(near, seen["rows"] <= MOST_BROADCAST).join(sets, "doc_id")
    return _by_cell(met.select(*_CELL, "shingles"), lambda rows: _links(rows, percent), "a bigint, b bigint")


_CELL = ["key", "i", "j", "own", "doc_id", "component"]


def _by_cell(rows: DataFrame, work, schema: str) -> DataFrame:
    """``work`` on the rows of each cell, one cell held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            tags = np.stack([batch.column(c).to_numpy() for c in ("key", "i", "j")], 1)
            cuts = np.flatnonzero((tags[1:] != tags[:-1]).any(1)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(tags)], strict=True):
                tag = tuple(tags[lo])
                if held and tag != last:
                    yield work(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(lo, hi - lo))
                last = tag
        if held:
            yield work(pa.Table.from_batches(held))

    rows = rows.withColumn("cell", F.xxhash64("key", "i", "j"))
    return rows.repartition("cell").sortWithinPartitions("cell", "key", "i", "j").drop("cell").mapInArrow(run, schema)


def _candidates(rows: pa.Table) -> pa.RecordBatch:
    """The rows of a cell whose text has a candidate of another component across the cell's blocks.

    A pair is looked at only in the list of the first coordinate that both keep and agree on.
    """
    here, i, j = rows["key"][0].as_py() >> 32, rows["i"][0].as_py(), rows["j"][0].as_py()
    own, part = rows["own"].to_numpy(), rows["component"].to_numpy()
    minima = rows["minima"].combine_chunks().flatten().to_numpy().reshape(-1, COORDINATES)
    stays = (rows["stays"].to_numpy()[:, None] >> np.arange(COORDINATES)) & 1 == 1
    left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
    theirs, their_stays, their_part = minima[right], stays[right], part[right]
    chosen = np.zeros(len(own), bool)
    for x in left:
        y = np.flatnonzero(their_part != part[x])
        same = theirs[y] == minima[x]
        enough = same.sum(1) >= AGREE
        y, same = y[enough], same[enough]
        y = right[y[(same & their_stays[y] & stays[x]).argmax(1) == here]]
        chosen[y] = True
        chosen[x] |= len(y) > 0
    at = np.flatnonzero(chosen)
    return pa.RecordBatch.from_arrays([pa.array(rows[c].to_numpy()[at].astype(np.int64)) for c in _CELL], _CELL)


def _links(rows: pa.Table, percent: int) -> pa.RecordBatch:
    """Components across a cell's blocks that links join, exact on full sets; none between what is joined already."""
    i, j = rows["i"][0].as_py(), rows["j"][0].as_py()
    own, ids = rows["own"].to_numpy(), rows["component"].to_numpy()
    part = np.unique(ids, return_inverse=True)[1]
    sets = rows["shingles"].combine_chunks()
    sizes = sets.value_lengths().to_numpy().astype(np.int64)
    edges = np.concatenate([[0], np.cumsum(sizes)])
    terms = np.unique(sets.flatten().to_numpy(), return_inverse=True)[1]
    left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
    flag = np.zeros(int(terms.max(initial=-1)) + 1, np.int32)
    starts = edges[:-1]
    a, b = [], []
    for x in left:
        if (part[right] == part[x]).all():
            continue
        mine = terms[edges[x] : edges[x + 1]]
        flag[mine] = 1
        same = np.add.reduceat(flag[terms], starts)[right]  # no set is empty
        flag[mine] = 0
        for y in right[100 * same >= percent * (sizes[x] + sizes[right] - same)]:
            if part[y] != part[x]:
                part[part == part[y]] = part[x]
                a.append(ids[x])
                b.append(ids[y])
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _same_ids(signed: DataFrame, classes: DataFrame) -> DataFrame | None:
    """Links (a, b) of the classes in which a doc_id is repeated with other texts; None if there are none."""
    prints = F.xxhash64("n", "f1", "f2")
    repeated, seen = S.counted(signed.where("n > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(prints).alias("low"), F.max(prints).alias("high")).where("low <> high").select("doc_id"))
    if not seen["rows"]:
        return None
    nodes = signed.where("n > 0").join(repeated, "doc_id").join(classes.select("n", "f1", "f2", "rep"), ["n", "f1", "f2"])
    least = nodes.groupBy("doc_id").agg(F.min("rep").alias("a"))
    return nodes.join(least, "doc_id").select("a", F.col("rep").alias("b")).where("a <> b")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, weight: int = WEIGHT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row.  ``percent``: least similarity of a link."""
    signed = S.kept(signatures(docs, k, id_col, text_col))
    classes = S.kept(signed.where("n > 0 AND doc_id IS NOT NULL").groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep"), F.first("minima").alias("minima")))
    own = S.kept(_prefixes(classes))
    # all lists of a text are in its row, so the pairs are distinct
    stars = own.select(F.explode(F.array_distinct(F.col("lists.first"))).alias("a"), F.col("doc_id").alias("b")).where("a <> b")
    first, same = _confirm(stars, classes, docs, k, percent, id_col, text_col), _same_ids(signed, classes)
    parts = components(first if same is None else first.unionByName(same))
    more = _across(own, parts, classes, docs, k, percent, id_col, text_col, block, weight)
    owners = classes.select("n", "f1", "f2", "rep").join(parts, F.col("rep") == F.col("node"), "left").select("n", "f1", "f2", F.coalesce("component", "rep").alias("component"))
    if more is not None:
        over = components(more).select("node", F.col("component").alias("over"))
        owners = owners.join(over, F.col("component") == F.col("node"), "left").select("n", "f1", "f2", F.coalesce("over", "component").alias("component"))
    out = signed.drop("minima").join(owners, ["n", "f1", "f2"], "left")
    # a doc_id without a class of its own is its own component
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
