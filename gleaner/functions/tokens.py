"""Tokenizers as column functions: text to an array of tokens.

Built-in expressions wherever Spark has them; Arrow-batched Python for stems and for n-grams of arbitrary text
(NFKC and extended grapheme clusters).  A null text gives null, an empty one no token.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SEPARATOR = r"[^\p{IsAlphabetic}\p{N}]"


def is_alpha(token: Column) -> Column:
    """Whether every character is alphabetic; true for an empty token."""
    return token.rlike(r"^\p{IsAlphabetic}*$")


def _long(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: F.octet_length(t) >= 2)


def words(text: Column) -> Column:
    """Lower-cased runs of letters and numbers of at least two bytes, unstemmed."""
    return _long(F.split(F.lower(text), _SEPARATOR))


def legacy_words(text: Column) -> Column:
    """The same, split before lower-casing."""
    return F.transform(_long(F.split(text, _SEPARATOR)), F.lower)


def roots(tokens: pa.Array) -> pa.DictionaryArray:
    """Each token's stem; a distinct token is stemmed once."""
    from .stem import stem

    known = tokens.dictionary_encode()
    stems = pa.array([stem(t) if t.isalpha() else t for t in known.dictionary.to_pylist()], pa.string()).dictionary_encode()
    return pa.DictionaryArray.from_arrays(stems.indices.take(known.indices), stems.dictionary)


def _stems(tokens: pa.Array) -> pa.Array:
    import numpy as np
    import pyarrow.compute as pc

    offsets = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(), dtype="int64")])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), roots(tokens.flatten()).cast(pa.string()), mask=tokens.is_null())


def stemmed_words(text: Column) -> Column:
    return F.arrow_udf(_stems, "array<string>")(words(text))


def plain_ngrams(text: Column, n: int) -> Column:
    """Sliding n-grams of lower-cased code points, built in; equal to ``ngrams`` where the lower-cased text is
    stable under NFKC and has no cluster of several code points."""
    _positive(n)
    chars = F.filter(F.split(F.lower(text), ""), lambda c: c != "")
    count = F.greatest(F.size(chars) - (n - 1), F.lit(0))
    out = F.slice(chars, F.lit(1), count)
    for i in range(1, n):
        out = F.zip_with(out, F.slice(chars, F.lit(1 + i), count), lambda a, b: F.concat(a, b))
    return out


def _positive(n: int) -> None:
    if n < 1:
        raise ValueError("an n-gram has at least one grapheme")


#: Distinct n-grams that a worker holds before it gives out their counts, and code points of a text that it cuts at once.
MOST_GRAMS, PIECE = 200_000, 1 << 16
#: Of each character met, whether it is a cluster by itself wherever it stands; a worker's memory of them.
_ALONE: dict[str, bool] = {}


def clusters(text: str) -> Iterator[str | list[str]]:
    """The lower-cased, NFKC-normalised text's grapheme clusters, in parts of about ``PIECE``: a string where each is one code point, else a list."""
    import unicodedata

    import regex

    t = unicodedata.normalize("NFKC", text.lower())
    new = set(t).difference(_ALONE)
    if new:
        if len(_ALONE) > 1 << 17:
            _ALONE.clear()
            new = set(t)
        joins = r"[\r\p{GCB=Extend}\p{GCB=ZWJ}\p{GCB=SpacingMark}\p{GCB=Prepend}\p{GCB=RI}\p{GCB=L}\p{GCB=V}\p{GCB=T}\p{GCB=LV}\p{GCB=LVT}]"
        _ALONE.update((c, regex.match(joins, c) is None) for c in new)
    if all(_ALONE[c] for c in set(t)):
        for i in range(0, len(t), PIECE):
            yield t[i : i + PIECE]
        return
    part: list[str] = []
    for m in regex.finditer(r"\X", t):
        part.append(m[0])
        if len(part) == PIECE:
            yield part
            part = []
    yield part


def _given_out(held: Counter) -> pa.RecordBatch:
    """The counts held by a worker, which holds none then."""
    rows = pa.RecordBatch.from_arrays([pa.array(["".join(g) for g in held], pa.string()), pa.array(list(held.values()), pa.int64())], ["gram", "n"])
    held.clear()
    return rows


def ngram_counts(docs: DataFrame, n: int, text_col: str = "text") -> DataFrame:
    """(gram, n): how often each of ``ngrams`` occurs in all texts.

    A worker counts text by text and gives out counts whenever it holds ``MOST_GRAMS`` of them, so that neither it nor
    Arrow holds the n-grams of many texts at once.
    """
    _positive(n)

    def run(batches):
        held: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                before: str | list[str] = []
                for part in clusters(text.as_py() or ""):
                    own = [*before, *part] if before else part
                    held.update(zip(*(own[i:] for i in range(n)), strict=False))
                    before = own[len(own) - min(n - 1, len(own)) :]
                    if len(held) >= MOST_GRAMS:
                        yield _given_out(held)
        yield _given_out(held)

    return docs.select(text_col).mapInArrow(run, "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))


#: Texts joined, and code points of them counted, at once.
TEXTS, RUN = 256, 1 << 20
#: Bins up to which n-grams are counted without sorting them.
MOST_BINS = 1 << 22


def windows(texts: list[str], n: int) -> Iterator[dict[str, int]]:
    """Counts of the n-grams of code points of ``texts``, in parts of ``RUN`` of them: as numbers in base of the part's alphabet."""
    import numpy as np

    points = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
    within = np.ones(len(points), bool)  # where an n-gram starts that ends in the same text
    ends = np.cumsum([len(t) for t in texts], dtype="int64")
    for i in range(1, n):
        within[ends[ends >= i] - i] = False
    for start in range(0, len(points) - n + 1, RUN):
        part = points[start : start + RUN + n - 1]
        m = len(part) - n + 1
        met = np.zeros(0x110000, bool)
        met[part] = True
        alphabet = np.flatnonzero(met)
        size = len(alphabet)
        if size**n >= 1 << 63:
            whole = part.tobytes().decode("utf-32-le")
            yield Counter(whole[i : i + n] for i in np.flatnonzero(within[start : start + m]).tolist())
            continue
        place = np.zeros(0x110000, "int64")
        place[alphabet] = np.arange(size)
        digits = place[part]
        key = digits[:m]
        for i in range(1, n):
            key = key * size + digits[i : i + m]
        key = key[within[start : start + m]]
        if size**n <= MOST_BINS:
            bins = np.bincount(key, minlength=1)
            key = np.flatnonzero(bins)
            counts = bins[key]
        else:
            key, counts = np.unique(key, return_counts=True)
        grams = np.empty((len(key), n), "<u4")
        for i in range(n - 1, -1, -1):
            key, digit = np.divmod(key, size)
            grams[:, i] = alphabet[digit]
        joined = grams.tobytes().decode("utf-32-le")
        yield dict(zip((joined[i : i + n] for i in range(0, len(joined), n)), counts.tolist(), strict=True))


def plain_ngram_counts(docs: DataFrame, n: int, text_col: str = "text") -> DataFrame:
    """(gram, n): how often each of ``plain_ngrams`` occurs in all texts; no n-gram becomes a row before it is counted."""
    _positive(n)

    def run(batches):
        held: Counter = Counter()
        for batch in batches:
            for i in range(0, batch.num_rows, TEXTS):
                for counts in windows([t or "" for t in batch.column(0).slice(i, TEXTS).to_pylist()], n):
                    held.update(counts)
                    if len(held) >= MOST_GRAMS:
                        yield _given_out(held)
        yield _given_out(held)

    return docs.select(F.lower(text_col)).mapInArrow(run, "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))


def ngrams(text: Column, n: int) -> Column:
    """Sliding n-grams of grapheme clusters of the lower-cased, NFKC-normalised text."""
    _positive(n)

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        import unicodedata

        import regex

        def of(t: str) -> list[str]:
            g = regex.findall(r"\X", unicodedata.normalize("NFKC", t.lower()))
            return ["".join(g[i : i + n]) for i in range(len(g) - n + 1)]

        return texts.map(of, na_action="ignore")

    return run(text)


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, math.isqrt(n) + 1))


def next_odd_prime(n: int) -> int:
    """The least prime that is odd and not below ``n``."""
    n += n % 2 == 0
    while not is_prime(n):
        n += 2
    return n


def djb(token: Column, modulus: int) -> Column:
    """The xor variant of Bernstein's string hash over UTF-8 bytes in unsigned 64-bit arithmetic, modulo ``modulus``."""
    digits = F.hex(F.encode(token, "utf-8"))
    values = F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1)), F.lit(2)), lambda i: i <= F.length(digits)), lambda i: F.conv(F.substring(digits, i, F.lit(2)), 16, 10).cast("bigint"))
    h = F.aggregate(values, F.lit(5381).cast("bigint"), lambda h, b: F.shiftleft(h, 5).bitwiseXOR(F.shiftrightunsigned(h, 2)).bitwiseXOR(b))
    unsigned = F.when(h < 0, h.cast("decimal(20,0)") + F.lit(str(2**64)).cast("decimal(20,0)")).otherwise(h.cast("decimal(20,0)"))
    return (unsigned % F.lit(modulus).cast("decimal(20,0)")).cast("bigint")


def hashed(grams: Column, modulus: int) -> Column:
    """Each gram's hash as a decimal string, modulo the next odd prime of ``modulus``."""
    prime = next_odd_prime(modulus)
    return F.transform(grams, lambda g: djb(g, prime).cast("string"))


_MODELS: dict = {}


def pieces(text: Column, path: str) -> Column:
    """SentencePiece pieces of the text by the model file at ``path``, which every worker reads once."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        import sentencepiece

        if path not in _MODELS:
            _MODELS[path] = sentencepiece.SentencePieceProcessor(model_file=path)
        return texts.map(lambda t: _MODELS[path].encode(t, out_type=str, num_threads=1), na_action="ignore")

    return run(text)


def tokenizer(name: str, strict: bool = True) -> Callable[[Column], Column]:
    """By name: englishstemlower, words, legacy, ngram.N, nghash.N.H, pieces:FILE.

    An unknown name raises; with ``strict`` false it falls back to englishstemlower.
    """
    if name.startswith("pieces:"):
        return lambda text: pieces(text, name.removeprefix("pieces:"))
    head, *args = name.split(".")
    try:
        if head == "ngram":
            n = int(args[0])
            return lambda text: ngrams(text, n)
        if head == "nghash":
            n, modulus = int(args[0]), int(args[1])
            return lambda text: hashed(ngrams(text, n), modulus)
    except (IndexError, ValueError) as e:
        raise ValueError(f"not a tokenizer: {name!r}") from e
    known = {"englishstemlower": stemmed_words, "words": words, "legacy": legacy_words}
    if name not in known and strict:
        raise ValueError(f"not a tokenizer: {name!r}")
    return known.get(name, stemmed_words)
