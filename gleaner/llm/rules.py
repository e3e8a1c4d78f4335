"""Quality rules: exact base counts, then robust multivariate outliers per language and source.

Base counts are made in one pass without a shuffle.  Their transformed ratios (logarithm of the mean word
length, arcsine roots of shares, Herdan's lexical diversity) are then fitted by minimum covariance determinant.
``STARTS`` fits begin each group: medians and quartile ranges of the coordinates, means and deviations of all rows,
and of the rows whose hash is even or odd.  From each, a concentration step takes the ``share`` of a group's rows that lie
nearest by Mahalanobis distance and fits mean and covariance to them; after ``steps`` of them the start whose fit
has the least determinant is kept.  A step is one aggregation by group, start and bin of distance: Spark sums counts,
values and products in each bin on the map side, so a hot group costs no more than any other, and the sums up to the
bin that completes the share give the next fit.  Nothing is sampled; the nearest share is exact up to whole bins
(``BINS`` an octave).

Groups are language and source.  A row's squared distance is the mean of that to its group's fit, with the weight of
the group's rows, and that to the wider one, with the weight of ``PRIOR`` rows; the wider one is in the same way that of
its language and of all rows.  So a group of any size is treated alike: one of few rows is judged much like its
language, even if most of them are outliers, and one of many by itself.  A standard deviation is at
least ``FLOOR`` per coordinate, so ratios that are zero in most texts don't make a fit singular, and covariances
are shrunk towards their diagonal by as many rows as there are coordinates.

Defined results: a null text has no words; a null lang or source is a group of its own; repeated rows count each
for itself; with no rows the result is empty.  A text fails the base rule below 10 words or if over 20 % of its
words are in repeated windows; such texts take no part in the fits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _spark as S
from . import _words as W

#: Rows that a wider group's fit counts for in a group's own, and beginnings of a fit.
PRIOR, STARTS = 200, 4
#: Bins of squared distance an octave.
BINS = 8
#: Groups up to which fits are broadcast; beyond, they are joined by a shuffle.
MOST_BROADCAST = 20_000
#: Median and 0.9999 quantile of chi-squared with 7 degrees of freedom.
MEDIAN, CUT = 6.3458, 29.8775

FEATURES = ("word_length", "symbols", "dup_lines", "repeats", "upper", "diversity", "bare")
#: Least standard deviation of each; wide where it is a share of few lines, so that a repeated title alone is no outlier.
FLOOR = np.array([0.1, 0.08, 0.3, 0.2, 0.08, 0.08, 0.08])
_D = len(FEATURES)
_PAIRS = [(i, j) for i in range(_D) for j in range(i, _D)]

_SYMBOL, _UPPER, _LETTER = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_distinct", "n_bare")


def _by_row(flags: np.ndarray, edges: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[edges[1:]] - sums[edges[:-1]]


def _lines(text: str | None) -> tuple[int, int]:
    """(lines with a word, those equal to an earlier one)."""
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\v\f\r")]
    return len(lines), len(lines) - len(set(lines))


def counts(column: pa.Array) -> dict[str, np.ndarray]:
    """``COUNTS`` of each text of a string column."""
    out: dict[str, list[np.ndarray]] = {c: [] for c in COUNTS}
    for lo, hi, data, offsets in W.blocks(column):
        words, n = W.split(data, offsets), hi - lo
        inside = ~W.SPACE[data] & ((data & 0xC0) != 0x80)
        upper = _UPPER[data]
        if len(data) > 1:
            upper[:-1] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
        at, hashes = W.grams(words, 5)
        _, which, times = np.unique(W.mix(hashes + words.row[at].astype(W.U) * W.U(W._R)), return_inverse=True, return_counts=True)
        again, covered = at[times[which] > 1], np.zeros(len(words.hash), bool)
        for k in range(5):
            covered[again + k] = True
        bare = np.ones(len(words.hash), bool)
        letter = np.zeros(len(data) + 1, np.int64)
        np.cumsum(_LETTER[data], out=letter[1:])
        bare &= letter[words.end] == letter[words.start]
        own = np.unique(W.mix(words.hash + words.row.astype(W.U) * W.U(W._R)), return_index=True)[1]
        lines = np.array([_lines(t) for t in column.slice(lo, n).to_pylist()], np.int64).reshape(n, 2)
        for c, v in zip(COUNTS, (words.count, _by_row(inside, offsets), _by_row(_SYMBOL[data], offsets), lines[:, 1], _by_row(covered, words.first), lines[:, 0], _by_row(upper, offsets), np.bincount(words.row[own], minlength=n), _by_row(bare, words.first)), strict=True):
            out[c].append(v)
    return {c: np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64) for c, v in out.items()}


def transformed(c: dict[str, np.ndarray]) -> np.ndarray:
    """(rows, features)."""
    share = lambda a, b: np.arcsin(np.sqrt(np.clip(a / np.maximum(b, 1), 0, 1)))
    words, chars = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1)
    return np.stack([np.log(chars / words), share(c["n_symbols"], chars), share(c["n_dup_lines"], c["n_lines"]), share(c["n_repeat_words"], words), share(c["n_upper"], chars), np.log1p(c["n_distinct"]) / np.log1p(words), share(c["n_bare"], words)], 1)


_SCHEMA = "doc_id bigint, lang string, source string, " + ", ".join(f"{c} bigint" for c in COUNTS[:5]) + ", base_failed boolean, x array<double>"


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Counts, base verdict and transformed vector of every row; no shuffle."""

    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        c = counts(batch.column("text"))
        failed = (c["n_words"] < 10) | (100 * c["n_repeat_words"] > 20 * c["n_words"])
        x = transformed(c)
        vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, _D), pa.int32()), pa.array(x.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column(k) for k in ("doc_id", "lang", "source")] + [pa.array(c[k]) for k in COUNTS[:5]] + [pa.array(failed), vectors], ["doc_id", "lang", "source", *COUNTS[:5], "base_failed", "x"])

    chosen = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"))
    return S.map_arrow(chosen, step, _SCHEMA)


def _key(level: int):
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.hex(F.col(c))), F.lit("~"))
    return F.concat_ws("\n", F.lit(str(level)), *([part("lang")] if level else []), *([part("source")] if level > 1 else []))


def _squared(x: str = "x"):
    """Squared Mahalanobis distance of array column ``x`` to array columns ``mean`` and ``inverse`` (upper triangle)."""
    diff = [F.col(x)[i] - F.col("mean")[i] for i in range(_D)]
    return sum((F.col("inverse")[k] * diff[i] * diff[j] * (1 if i == j else 2) for k, (i, j) in enumerate(_PAIRS)), F.lit(0.0))


def _bin(d2):
    return F.floor(F.log2(d2 + F.lit(1e-9)) * BINS)


_FIT = "key string, start int, n bigint, mean array<double>, cov array<double>, inverse array<double>, scale double"


def _upper(m: np.ndarray) -> list[float]:
    return [float(m[i, j]) for i, j in _PAIRS]


def _full(upper: np.ndarray) -> np.ndarray:
    out = np.zeros((_D, _D))
    for x, (i, j) in zip(upper, _PAIRS, strict=True):
        out[i, j] = out[j, i] = x
    return out


def widened(cov: np.ndarray, n: int) -> np.ndarray:
    """``cov`` of a group of ``n`` rows with a standard deviation of at least ``FLOOR`` in each coordinate.

    It is shrunk towards its diagonal as if that were known from as many rows as there are coordinates, so that few
    rows, or coordinates that go together, don't make it singular.
    """
    var = np.maximum(np.diag(cov), 0)
    away = cov - np.diag(np.diag(cov))
    return away * (n / (n + _D)) + np.diag(np.maximum(np.sqrt(var), FLOOR) ** 2)


def _row(key: str, start: int, n: int, mean: np.ndarray, cov: np.ndarray, scale: float = 1.0) -> tuple:
    cov = widened(cov, n)
    return (key, start, n, mean.tolist(), _upper(cov), _upper(np.linalg.inv(cov)), scale)


def _table(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[x.split()[0] for x in _FIT.split(", ")])


def _moments(sums: pd.DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, mean and covariance from sums of values (s) and products (p)."""
    n = int(sums["n"].sum())
    mean = np.array([sums[f"s{i}"].sum() for i in range(_D)]) / n
    return n, mean, _full(np.array([sums[f"p{i}_{j}"].sum() for i, j in _PAIRS]) / n) - np.outer(mean, mean)


def _sums() -> list:
    return [F.count(F.lit(1)).alias("n"), *(F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(_D)), *(F.sum(F.col("x")[i] * F.col("x")[j]).alias(f"p{i}_{j}") for i, j in _PAIRS)]


def medians(keyed: DataFrame) -> DataFrame:
    """The first start: medians and quartile ranges of each coordinate, from counts by bins of 1/256."""

    def fit(bins: pd.DataFrame) -> pd.DataFrame:
        mean, sd, n = [], [], 0
        for i in range(_D):
            b = bins[bins["i"] == i].sort_values("b")
            total, n = b["n"].cumsum(), int(b["n"].sum())
            q1, q2, q3 = (float(b["b"].iloc[int(np.searchsorted(total, q * n))]) + 0.5 for q in (0.25, 0.5, 0.75))
            mean.append(q2 / 256)
            sd.append((q3 - q1) / 256 / 1.349)
        return _table([_row(bins["key"].iloc[0], 0, n, np.array(mean), np.diag(np.square(sd)))])

    bins = keyed.select("key", F.posexplode("x").alias("i", "v")).groupBy("key", "i", F.floor(F.col("v") * 256).alias("b")).agg(F.count("*").alias("n"))
    return bins.groupBy("key").applyInPandas(fit, _FIT)


def means(keyed: DataFrame) -> DataFrame:
    """The other starts: moments of all rows, and of the halves by hash of the row; a half without rows takes the other's."""

    def fit(halves: pd.DataFrame) -> pd.DataFrame:
        key, n = halves["key"].iloc[0], int(halves["n"].sum())
        parts = [halves, *(h if len(h) else halves for h in (halves[halves["half"] == 0], halves[halves["half"] == 1]))]
        return _table([_row(key, start, n, *_moments(part)[1:]) for start, part in enumerate(parts, 1)])

    halves = keyed.groupBy("key", F.pmod(F.hash("x"), F.lit(2)).alias("half")).agg(*_sums())
    return halves.groupBy("key").applyInPandas(fit, _FIT)


def next_fit(keyed: DataFrame, fits: DataFrame, few: bool, share: float) -> DataFrame:
    """One concentration step of every start, and the scale by which the new distances' median fits chi-squared's."""

    def fit(bins: pd.DataFrame) -> pd.DataFrame:
        bins = bins.sort_values("b")
        total, h = bins["n"].cumsum().to_numpy(), math.ceil(share * bins["n"].sum())
        _, mean, cov = _moments(bins.iloc[: int(np.searchsorted(total, h)) + 1])
        half = bins["b"].iloc[int(np.searchsorted(total, total[-1] / 2))]
        return _table([_row(bins["key"].iloc[0], int(bins["start"].iloc[0]), int(total[-1]), mean, cov, max(1.0, 2 ** ((half + 0.5) / BINS) / MEDIAN))])

    rows = keyed.join(S.broadcast_if(fits.select("key", "start", "mean", "inverse"), few), "key").withColumn("b", _bin(_squared()))
    return rows.groupBy("key", "start", "b").agg(*_sums()).groupBy("key", "start").applyInPandas(fit, _FIT)


def fitted(stats: DataFrame, share: float = 0.75, steps: int = 4) -> tuple[DataFrame, bool]:
    """(key, n, mean, cov, scale) of every language and source, every language and all rows; and whether these are few."""
    good = stats.where("NOT base_failed")
    keyed = good.select("x", F.explode(F.array(_key(0), _key(1), _key(2))).alias("key"))
    fits, seen = S.counted(medians(keyed).unionByName(means(keyed)))
    few = seen["rows"] <= MOST_BROADCAST
    for _ in range(steps):
        fits = S.kept(next_fit(keyed, fits, few, share))

    def best(starts: pd.DataFrame) -> pd.DataFrame:
        size = [np.linalg.slogdet(_full(np.array(c)))[1] for c in starts["cov"]]
        return starts.assign(size=np.round(size, 9)).sort_values(["size", "start"]).head(1).drop(columns=["size", "start", "inverse"])

    return S.kept(fits.groupBy("key").applyInPandas(best, "key string, n bigint, mean array<double>, cov array<double>, scale double")), few


def weights(n: int, n1: int, prior: float = PRIOR) -> tuple[float, float, float]:
    """Of the fits of a group of ``n`` rows, of its language with ``n1``, and of all rows."""
    own, language = n / (n + prior), n1 / (n1 + prior)
    return own, (1 - own) * language, (1 - own) * (1 - language)


def together(fits: list[tuple[float, np.ndarray, np.ndarray, float]]) -> tuple[np.ndarray, np.ndarray, float]:
    """The weighted mean of squared distances as one: center, inverse, and what is added.  ``fits``: weight, mean, covariance, scale."""
    inverses = [w / scale * np.linalg.inv(cov) for w, _, cov, scale in fits]
    inverse = sum(inverses)
    center = np.linalg.solve(inverse, sum(p @ mean for p, (_, mean, _, _) in zip(inverses, fits, strict=True)))
    return center, inverse, float(sum((mean - center) @ p @ (mean - center) for p, (_, mean, _, _) in zip(inverses, fits, strict=True)))


def _judging(fits: DataFrame, few: bool) -> DataFrame:
    """(key2, mean, inverse, added) of every language and source, together with its language and all rows."""

    of_all = fits.where("key = '0'").first()  # one row, or none without rows
    widest = (of_all["mean"], of_all["cov"], of_all["scale"]) if of_all else ()

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for r in rows.itertuples():
                mean, cov, scale = widest
                own = zip(weights(r.n, r.n1), (r.mean, r.mean1, mean), (r.cov, r.cov1, cov), (r.scale, r.scale1, scale), strict=True)
                center, inverse, added = together([(w, np.array(mean), _full(np.array(cov)), scale) for w, mean, cov, scale in own])
                out.append((r.key, center.tolist(), _upper(inverse), added))
            yield pd.DataFrame(out, columns=["key2", "mean", "inverse", "added"])

    language = fits.select(F.col("key").alias("key1"), *(F.col(c).alias(f"{c}1") for c in ("n", "mean", "cov", "scale")))
    # a key is its level and its parts by lines; that of the language is level 1 and the first part
    own = fits.where("key LIKE '2%'").withColumn("key1", F.concat(F.lit("1\n"), F.split("key", "\n")[1]))
    return own.join(S.broadcast_if(language, few), "key1").mapInPandas(each, "key2 string, mean array<double>, inverse array<double>, added double")


def judge(docs: DataFrame, share: float = 0.75, steps: int = 4, cut: float = CUT, **columns: str) -> DataFrame:
    """Counts, base verdict, robust squared distance (null if no group has a fit) and ``kept`` of every row."""
    stats = S.kept(statistics(docs, **columns))
    fits, few = fitted(stats, share, steps)
    rows = stats.withColumn("key2", _key(2)).join(S.broadcast_if(S.kept(_judging(fits, few)), few), "key2", "left")
    rows = rows.withColumn("distance", _squared() + F.col("added"))
    return rows.select("doc_id", *COUNTS[:5], "base_failed", (~F.col("base_failed") & F.coalesce(F.col("distance") <= cut, F.lit(True))).alias("kept"), "distance")
