"""A collection on disk: tf by token and by document, dictionaries, norms and counts, as Parquet tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tokens
from ..operators import index, scoring
from ..session import MOST_NUMBERS, looked_up, placed, stored


@dataclass
class Collection:
    """Tables are read lazily; Spark prunes row groups by the sort column of each layout."""

    spark: SparkSession
    path: str

    @classmethod
    def build(cls, docs: DataFrame, path: str, tokenize: Callable[[Column], Column] = tokens.stemmed_words, id_col: str = "doc_id", text_col: str = "text") -> Collection:
        """Writes the tables; a document id that occurs twice is an error."""
        own = index.reject_duplicates(docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text")))
        self = cls(docs.sparkSession, path)
        self._save(index.docmap(own), "docmap")
        tf = stored(index.numbered_frequencies(placed(own, "doc_id"), self.docmap, tokenize))
        self._save(index.vocabulary(tf), "vocab")
        encoded = index.encoded(tf, self.vocab)
        self._save(encoded.repartitionByRange("tok_id", "doc_int").sortWithinPartitions("tok_id", "doc_int"), "tf_by_token")
        self._save(self.table("tf_by_token").repartitionByRange("doc_int").sortWithinPartitions("doc_int", "tok_id"), "tf_by_document")
        self._save(index.norms(tf), "norms")
        stats = index.corpus_stats(own, tf)
        self._save(stats, "stats")
        self._save(self.norms.select("doc_id", F.log10(F.lit(own.count()) / F.col("num_features")).alias("idf")), "idf")
        return self

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Collection:
        return cls(spark, path)

    def _save(self, df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").option("compression", "lz4_raw" if name in ("vocab", "docmap") else "zstd").parquet(f"{self.path}/{name}")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    @property
    def vocab(self) -> DataFrame:
        return self.table("vocab")

    @property
    def docmap(self) -> DataFrame:
        return self.table("docmap")

    @property
    def stats(self) -> DataFrame:
        return self.table("stats")

    @property
    def idf(self) -> DataFrame:
        """(doc_id, idf), by the number of a document's distinct tokens."""
        return self.table("idf")

    @property
    def norms(self) -> DataFrame:
        return self.table("norms")

    def token_id(self, token: str) -> int | None:
        row = self.vocab.where(F.col("token") == token).first()
        return row and row.tok_id

    def document_int(self, doc_id: str) -> int | None:
        row = self.docmap.where(F.col("doc_id") == doc_id).first()
        return row and row.doc_int

    def document_id(self, doc_int: int) -> str | None:
        row = self.docmap.where(F.col("doc_int") == doc_int).first()
        return row and row.doc_id

    def posting_list(self, tok_id: int) -> DataFrame:
        """(doc_int, tf) of one token, by a scan of its row groups."""
        return self.table("tf_by_token").where(F.col("tok_id") == tok_id).select("doc_int", "tf")

    def feature_vector(self, doc_int: int) -> DataFrame:
        """(tok_id, tf) of one document, in order of token; empty without tokens."""
        return self.table("tf_by_document").where(F.col("doc_int") == doc_int).orderBy("tok_id").select("tok_id", "tf")

    def feature_vectors(self) -> DataFrame:
        return index.feature_vectors(self.table("tf_by_document"), self.docmap)

    def tf(self) -> DataFrame:
        """(doc_id, token, tf)."""
        return self.table("tf_by_token").join(looked_up(self.vocab), "tok_id").join(looked_up(self.docmap), "doc_int").select("doc_id", "token", "tf")

    def centroid_model(self, judged: DataFrame) -> DataFrame:
        """(token, w) by ``judged`` (doc_id, rel): lists meet the judged documents by number, and only weights get their tokens."""
        known = judged.join(self.docmap, "doc_id", "left").select("doc_int", "rel")  # judgments of unknown documents count for their side
        weights = scoring.centroid_model(self.table("tf_by_token"), known, "tok_id", "doc_int", MOST_NUMBERS)
        return weights.join(self.vocab, "tok_id").select("token", "w")

    def save_model(self, model: DataFrame, name: str) -> None:
        """``model``: topic, token, w, and step if there are several."""
        model.where("w <> 0").write.mode("overwrite").partitionBy("topic", *(["step"] if "step" in model.columns else [])).parquet(f"{self.path}/models/{name}")

    def model(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/models/{name}")
