"""From documents to term frequencies, dictionaries, postings and vectors.

The central table is tf(doc_id, token, tf); everything else is an aggregation of it.  Aggregations combine on the
map side, so a frequent token costs its tasks no more than any other.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codecs, tokens
from ..session import looked_up, placed, stored

#: Consecutive documents whose postings of one token make a row.
SEGMENT = 1 << 16


def term_frequencies(docs: DataFrame, tokenize: Callable[[Column], Column] = tokens.words, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, token, tf)."""
    return docs.select(F.col(id_col).alias("doc_id"), F.explode(tokenize(F.col(text_col))).alias("token")).groupBy("doc_id", "token").agg(F.count("*").alias("tf"))


#: Words that a worker counts at once, those of one text at least, and rows that it gives to Arrow at once.
WORDS, ROWS = 1 << 20, 1 << 16


def stemmed_frequencies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``term_frequencies`` by ``tokens.stemmed_words``.

    Texts are dealt and sorted by id, so a worker meets the rows of an id one after another and gives out its counts:
    words are neither shuffled nor hashed as rows.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def rows(ids: pa.Array, terms: pa.Array, tf: pa.Array) -> Iterator[pa.RecordBatch]:
            out = pa.RecordBatch.from_arrays([ids, terms, tf], ["doc_id", "token", "tf"])
            for i in range(0, out.num_rows, ROWS):
                yield out.slice(i, ROWS)

        def last() -> Iterator[pa.RecordBatch]:
            return rows(pa.array([held_id] * len(held), id_type), pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64()))

        held: Counter = Counter()  # of the id met last, which the next texts may have too
        held_id = id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            lengths = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy()
            ends, stop = np.cumsum(lengths, dtype="int64"), 0
            while stop < batch.num_rows:
                start, stop = stop, max(stop + 1, int(np.searchsorted(ends, (ends[stop - 1] if stop else 0) + WORDS, "right")))
                part = batch.slice(start, stop - start)
                each = pc.run_end_encode(part.column(0))
                ids = each.values
                row_of = np.repeat(np.arange(len(ids)), np.diff(each.run_ends.to_numpy(), prepend=0))
                words = part.column(1)
                stems = tokens.roots(words.flatten())
                size = max(len(stems.dictionary), 1)
                row = np.repeat(row_of, lengths[start:stop])
                key, tf = np.unique(row * size + stems.indices.to_numpy(), return_counts=True)
                row, term = np.divmod(key, size)
                terms = stems.dictionary.take(pa.array(term))
                first = 0
                if ids[0].as_py() == held_id:
                    first = int(np.searchsorted(row, 1))
                    held.update(dict(zip(terms[:first].to_pylist(), tf[:first].tolist(), strict=True)))
                    if len(ids) == 1:
                        continue
                yield from last()
                end = int(np.searchsorted(row, len(ids) - 1))
                yield from rows(ids.take(pa.array(row[first:end])), terms[first:end], pa.array(tf[first:end], pa.int64()))
                held, held_id = Counter(dict(zip(terms[end:].to_pylist(), tf[end:].tolist(), strict=True))), ids[-1].as_py()
        if held:
            yield from last()

    texts = placed(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "doc_id").sortWithinPartitions("doc_id")
    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.select("doc_id", tokens.words(F.col("text")).alias("words")).mapInArrow(run, f"doc_id {kind}, token string, tf bigint")


def numbered_frequencies(docs: DataFrame, ids: DataFrame, tokenize: Callable[[Column], Column] = tokens.words) -> DataFrame:
    """(doc_id, doc_int, token, tf): ``docs`` (doc_id, text) get their numbers from ``ids`` (``docmap``) before they are exploded.

    Where ``docs`` are ``placed`` by doc_id, texts are shuffled once and their tokens not at all.
    """
    words = docs.join(looked_up(ids), "doc_id").select("doc_id", "doc_int", F.explode(tokenize(F.col("text"))).alias("token"))
    return words.groupBy("doc_id", "doc_int", "token").agg(F.count("*").alias("tf"))


def token_map(tf: DataFrame) -> DataFrame:
    """(doc_id, tokens: map of token to frequency)."""
    return tf.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("token", "tf")))).alias("tokens"))


def corpus_stats(docs: DataFrame, tf: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row: num_rows (lines), num_docs (distinct ids), num_features, num_postings, num_tokens."""
    a = docs.agg(F.count("*").alias("num_rows"), F.count_distinct(id_col).alias("num_docs"))
    b = tf.groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).agg(F.count("*").alias("num_features"), F.coalesce(F.sum("df"), F.lit(0)).alias("num_postings"), F.coalesce(F.sum("cf"), F.lit(0)).alias("num_tokens"))
    one = F.lit(1).alias("one")
    return a.select("*", one).join(b.select("*", one), "one").drop("one")


def document_frequencies(tf: DataFrame) -> DataFrame:
    """(token, df, cf)."""
    return tf.groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def dense_ids(values: DataFrame, column: str, id_col: str) -> DataFrame:
    """Distinct values numbered from 1 in their order, without a single-partition sort.

    Values are sorted by range; a partition's rows follow those of the partitions before it.  Only row counts,
    one per partition, come to the driver.
    """
    return numbered(values.select(column).where(F.col(column).isNotNull()).distinct().repartitionByRange(column).sortWithinPartitions(column), id_col)


def numbered(in_order: DataFrame, id_col: str) -> DataFrame:
    """``in_order``, which is sorted over its partitions and in each, numbered from 1.

    A number is looked up in an array by partition, so its cost does not grow with their count.
    """
    ordered = stored(in_order.withColumn("m", F.monotonically_increasing_id()))
    counts = {r.p: r.n for r in ordered.groupBy(F.shiftright("m", 33).alias("p")).agg(F.count("*").alias("n")).collect()}
    before, offsets = 0, []
    for p in range(max(counts, default=-1) + 1):
        offsets.append(before)
        before += counts.get(p, 0)
    start = F.element_at(F.array(*(F.lit(x).cast("bigint") for x in offsets or [0])), (F.shiftright("m", 33) + 1).cast("int"))
    return ordered.select(*in_order.columns, (start + F.col("m").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias(id_col))


def vocabulary(tf: DataFrame) -> DataFrame:
    """(token, tok_id)."""
    return dense_ids(tf, "token", "tok_id")


def docmap(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, doc_int) of every document, those without a token too."""
    return dense_ids(docs.select(F.col(id_col).alias("doc_id")), "doc_id", "doc_int")


def reject_duplicates(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs``; raises if an id occurs twice."""
    twice = docs.groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"document id {twice[0][0]!r} occurs {twice[0]['n']} times")
    return docs


def encoded(tf: DataFrame, vocab: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """(tok_id, doc_int, tf); without ``docs``, ``tf`` has doc_int (``numbered_frequencies``).

    Dictionaries are the hashed sides: postings, of which there are many more, are not sorted by token.
    """
    known = tf if docs is None else tf.join(looked_up(docs), "doc_id")
    return known.join(looked_up(vocab), "token").select("tok_id", "doc_int", "tf")


def sorted_tuples(encoded_tf: DataFrame) -> DataFrame:
    """Ordered by token, document, frequency; an external sort by range."""
    return encoded_tf.orderBy("tok_id", "doc_int", "tf")


def segment_of(doc_int: Column) -> Column:
    """The segment of a list that a document belongs to; none holds more than ``SEGMENT`` documents."""
    return F.floor((doc_int - 1) / SEGMENT).cast("bigint")


def posting_lists(encoded_tf: DataFrame) -> DataFrame:
    """(tok_id, segment, df, postings): an array per token and segment, so the list of a token that is everywhere is many rows."""
    return encoded_tf.groupBy("tok_id", segment_of(F.col("doc_int")).alias("segment")).agg(F.count("*").alias("df"), F.array_sort(F.collect_list(F.struct("doc_int", "tf"))).alias("postings"))


def gaps(encoded_tf: DataFrame) -> DataFrame:
    """(tok_id, doc_int, gap, tf): the distance to the document before it in the token's list, the first from 0.

    By a window within a segment, to which the last document of the segments before it is added as a row without
    tf; only tokens of several segments have such rows.
    """
    rows = stored(encoded_tf).withColumn("segment", segment_of(F.col("doc_int")))
    ends = rows.groupBy("tok_id", "segment").agg(F.max("doc_int").alias("last"))
    starts = ends.select("tok_id", F.lag("last").over(Window.partitionBy("tok_id").orderBy("segment")).alias("doc_int"), F.lit(None).cast("bigint").alias("tf"), "segment").where("doc_int IS NOT NULL")
    before = F.lag("doc_int", 1, 0).over(Window.partitionBy("tok_id", "segment").orderBy("doc_int"))
    found = rows.select("tok_id", "doc_int", "tf", "segment").unionByName(starts).withColumn("gap", F.col("doc_int") - before)
    return found.where("tf IS NOT NULL").select("tok_id", "doc_int", "gap", "tf")


def posting_bytes(encoded_tf: DataFrame) -> DataFrame:
    """(tok_id, df, bytes): the size of each list's serialised form, count included."""
    return gaps(encoded_tf).groupBy("tok_id").agg(F.count("*").alias("df"), F.sum(codecs.pair_size(F.col("gap"), F.col("tf"))).alias("pairs")).select("tok_id", "df", (F.col("pairs") + codecs.vbyte_size(F.col("df"))).alias("bytes"))


def serialised(encoded_tf: DataFrame) -> DataFrame:
    """(tok_id, segment, data): the byte form of each list, segment by segment, each from document 0."""
    p = posting_lists(encoded_tf)
    return p.select("tok_id", "segment", codecs.encoded_list(F.col("postings.doc_int"), F.col("postings.tf")).alias("data"))


def feature_vectors(encoded_tf: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, features: array of (id, value) by id, norm); a document without tokens has an empty vector."""
    v = encoded_tf.groupBy("doc_int").agg(F.array_sort(F.collect_list(F.struct(F.col("tok_id").alias("id"), F.col("tf").cast("float").alias("value")))).alias("features"), F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("norm"))
    empty = F.array().cast("array<struct<id:bigint,value:float>>")
    return docs.join(v, "doc_int", "left").select("doc_id", "doc_int", F.coalesce("features", empty).alias("features"), F.coalesce("norm", F.lit(0.0)).alias("norm"))


def norms(tf: DataFrame) -> DataFrame:
    """(doc_id, num_features, norm)."""
    return tf.groupBy("doc_id").agg(F.count("*").alias("num_features"), F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("norm"))


def document_idf(tf: DataFrame, num_docs: int) -> DataFrame:
    """(doc_id, idf): log10 of documents over the document's distinct tokens."""
    return tf.groupBy("doc_id").agg(F.log10(F.lit(num_docs) / F.count("*")).alias("idf"))


def term_ratios(tf: DataFrame, num_docs: int) -> DataFrame:
    """(token, ratio): documents over document frequency."""
    return tf.groupBy("token").agg((F.lit(num_docs) / F.count("*")).alias("ratio"))
