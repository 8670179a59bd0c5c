"""Quality classifier on document statistics.

Random Fourier features approximate a Gaussian kernel over standardised statistics of a text; normal equations, summed over the
partitions, fit ridge scores; isotonic regression on held-out labelled rows turns a score into the probability that a document is good.
Some of the statistics need a lexicon: the log-odds with which words and beginnings of words occur in toxic texts, learned from the same labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..arrow import slices
from ..storage import cut
from . import words
from .common import col
from .near import folded

_U = np.uint64
#: At most so many labelled rows are used, those with the least hashes of their ids. It bounds all that the fit collects and broadcasts.
FIT_ROWS = 20_000
#: One labelled row in so many is held out for the calibration.
HELD_OUT = 4
FEATURES, RIDGE, SEED = 256, 1.0, 4711
#: Standardised statistics beyond so many deviations count as so many, in the fit and in scoring, so that one outlying figure can't outweigh all others.
CLIP = 6.0
#: A word, or a beginning of one with so many bytes, enters the lexicon if so many labelled texts have it, with log-odds of at least so much.
LEAST_DOCS, LEAST_ODDS, PREFIXES = 8, 1.0, (4, 5, 6, 7, 8)
THRESHOLD = 0.5

STATISTICS = (
    "words", "mean_word", "deviation_word", "upper", "punctuation", "digits", "beyond_ascii", "distinct", "most_frequent", "repeats_previous",
    "words_a_line", "doubled_bytes", "ends_in_punctuation", "distinct_lines", "toxic_mean", "toxic_most", "toxic_share",
)

_CLASS = np.zeros((4, 256), bool)
_CLASS[0, 65:91] = True
_CLASS[1, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_CLASS[2, 48:58] = True
_CLASS[3, 128:] = True


@dataclass
class Lexicon:
    """Sorted hashes of folded words and beginnings of words, and their log-odds."""

    code: np.ndarray
    weight: np.ndarray

    def of(self, code: np.ndarray) -> np.ndarray:
        if not len(self.code):
            return np.zeros(len(code))
        at = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
        return np.where(self.code[at] == code, self.weight[at], 0.0)


def lexical_codes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Hashes of the whole words, then of their beginnings of each length (of a shorter word: of all of it)."""
    parts = [(0, end)] + [(n, np.minimum(start + n, end)) for n in PREFIXES]
    return [words.mix(words.hash_spans(raw, start, stop) + _U(n)) for n, stop in parts]


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values between successive bounds."""
    total = np.zeros(len(values) + 1, np.float64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def _distinct(row: np.ndarray, code: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row: how many distinct codes, and how often the most frequent one occurs."""
    if not len(code):
        return np.zeros(n), np.zeros(n)
    pair = words.mix(code + words.mix(row.astype(_U)))  # equal pairs of row and code
    order = np.argsort(pair)
    pair = pair[order]
    begin = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
    owner = row[order[begin]]
    most = np.zeros(n)
    np.maximum.at(most, owner, np.diff(np.append(begin, len(pair))))
    return np.bincount(owner, minlength=n).astype(float), most


def statistics(column: pa.Array, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """A row of STATISTICS for each text, and whether it has a word."""
    raw, offsets = words.text_buffer(column)
    n = len(offsets) - 1
    start, end, first = words.word_spans(raw, offsets)
    code = words.hash_spans(raw, start, end)
    count = np.diff(first).astype(float)
    some = np.maximum(count, 1)
    row = np.repeat(np.arange(n), np.diff(first))
    length = (end - start).astype(float)
    solid = np.maximum(_sums(length, first), 1)
    mean = _sums(length, first) / some
    out = np.zeros((n, len(STATISTICS)))
    out[:, 0] = np.log1p(count)
    out[:, 1] = np.log1p(mean)
    out[:, 2] = np.sqrt(np.maximum(_sums(length**2, first) / some - mean**2, 0))
    for k in range(4):
        out[:, 3 + k] = _sums(_CLASS[k][raw], offsets) / solid
    distinct, most = _distinct(row, code, n)
    out[:, 7], out[:, 8] = distinct / some, most / some
    if len(code):
        same = np.concatenate([[False], (code[1:] == code[:-1]) & (row[1:] == row[:-1])])
        out[:, 9] = _sums(same, first) / some
        out[:, 12] = _sums(_CLASS[1][raw[end - 1]], first) / some
    newline = raw == 10
    out[:, 10] = np.log1p(count / (_sums(newline, offsets) + 1))
    if len(raw):
        out[:, 11] = _sums(np.concatenate([[False], raw[1:] == raw[:-1]]), offsets) / solid
    breaks = np.flatnonzero(newline)
    cuts = np.union1d(offsets[:-1], breaks + 1)
    cuts = cuts[cuts < len(raw)]
    if len(cuts):
        stops = np.append(cuts[1:], len(raw))
        lines = words.hash_spans(raw, cuts, stops)
        owner = np.searchsorted(offsets, cuts, "right") - 1
        kinds, _ = _distinct(owner, lines, n)
        out[:, 13] = kinds / np.maximum(np.bincount(owner, minlength=n), 1)
    soft = folded(raw)
    start, end, first = words.word_spans(soft, offsets)
    weight = np.max([lexicon.of(code) for code in lexical_codes(soft, start, end)], axis=0)
    some = np.maximum(np.diff(first), 1)
    out[:, 14] = _sums(weight, first) / some
    out[:, 16] = np.sqrt(_sums(weight > 2, first) / some)
    filled = np.flatnonzero(np.diff(first))
    if len(filled):
        out[filled, 15] = np.maximum.reduceat(weight, first[filled])
    return out, count > 0


def word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, toxic) to (lexical code, toxic texts with it, other texts with it), summed over the partition."""
    codes, toxics = [np.zeros(0, _U)], [np.zeros(0, bool)]
    for batch in (part for whole in batches for part in slices(whole, 0)):
        raw, offsets = words.text_buffer(batch.column(0))
        soft = folded(raw)
        start, end, first = words.word_spans(soft, offsets)
        rows = np.repeat(np.arange(batch.num_rows), np.diff(first))
        toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        for code in lexical_codes(soft, start, end):
            order = np.lexsort((code, rows))
            code, row = code[order], rows[order]
            new = np.ones(len(code), bool)
            new[1:] = (code[1:] != code[:-1]) | (row[1:] != row[:-1])
            codes.append(code[new])
            toxics.append(toxic[row[new]])
    code, toxic = np.concatenate(codes), np.concatenate(toxics)
    kinds, at = np.unique(code, return_inverse=True)
    bad = np.bincount(at, weights=toxic, minlength=len(kinds)).astype(np.int64)
    good = np.bincount(at, weights=~toxic, minlength=len(kinds)).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64)), pa.array(bad), pa.array(good)], ["code", "bad", "good"])


@dataclass
class Model:
    """A fitted classifier; knots of the calibration are scores and the probabilities there."""

    lexicon: Lexicon
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    scores: np.ndarray
    probabilities: np.ndarray

    def probability(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(fourier((stats - self.mean) / self.scale) @ self.weights, self.scores, self.probabilities)


def fourier(x: np.ndarray, features: int = FEATURES) -> np.ndarray:
    """Random Fourier features of standardised rows, for a Gaussian kernel of width sqrt(number of columns), and a constant."""
    r = np.random.default_rng(SEED)
    w = r.normal(size=(x.shape[1], features)) / np.sqrt(x.shape[1])
    phase = r.uniform(0, 2 * np.pi, features)
    wave = np.sqrt(2 / features) * np.cos(np.clip(x, -CLIP, CLIP) @ w + phase)
    return np.hstack([wave, np.ones((len(x), 1))])


def isotonic(score: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing step function of least squares (pool adjacent violators); scores that tie are pooled first."""
    at, inverse = np.unique(score, return_inverse=True)
    size = np.bincount(inverse).astype(float)
    total = np.bincount(inverse, weights=good)
    blocks: list[list[float]] = []  # sum, size, first, last
    for i in range(len(at)):
        blocks.append([total[i], size[i], at[i], at[i]])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, n, _, last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2], last]
    knots = [(x, b[0] / b[1]) for b in blocks for x in ((b[2], b[3]) if b[3] > b[2] else (b[2],))]
    return np.array([x for x, _ in knots]), np.array([y for _, y in knots])


def _normal_equations(mean: np.ndarray, scale: np.ndarray):
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for batch in batches:
            x = np.array(batch.column(0).flatten()).reshape(-1, len(STATISTICS))
            phi = fourier((x - mean) / scale)
            total += phi.T @ np.hstack([phi, batch.column(1).to_numpy(zero_copy_only=False).astype(float)[:, None]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(list(total), pa.list_(pa.float64()))], ["row", "sums"])

    return sums


def _add(table: pa.Table) -> pa.Table:
    total = np.array(table["sums"].combine_chunks().flatten()).reshape(table.num_rows, -1).sum(axis=0)
    return pa.table({"row": table["row"].slice(0, 1), "sums": pa.array([total], pa.list_(pa.float64()))})


def _statistics_of(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0):
                stats, filled = statistics(part.column(0), lexicon)
                yield pa.RecordBatch.from_arrays([pa.array(list(stats), pa.list_(pa.float64())), part.column(1), part.column(2)], ["stats", "good", "held"]).filter(pa.array(filled))

    return run


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(text, good, toxic, held) of at most fit_rows labelled documents; good: quality 1 and not toxic.

    Labels without id or quality are left out, a missing toxicity counts as 0, and of several labels of one id the worse holds.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("label_id"))
    known = known.agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    order = F.xxhash64("label_id")
    sample = known.orderBy(order, "label_id").limit(fit_rows)
    held = F.pmod(F.xxhash64("label_id", F.lit(SEED)), F.lit(HELD_OUT)) == 0
    sample = cut(sample.select("label_id", ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"), (F.col("toxic") == 1).alias("toxic"), held.alias("held")))
    plain = docs.select(col(docs, id_col).cast("long").alias("id"), col(docs, text_col).cast("string").alias("text")).where("text is not null")
    # bounded by fit_rows, so its broadcast doesn't grow with the data
    return plain.join(F.broadcast(sample), F.col("id") == F.col("label_id")).select("text", "good", "toxic", "held")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> Model | None:
    """A model from at most fit_rows labelled documents, or None if these have no good or no bad one."""
    sample = cut(labelled(docs, labels, id_col, text_col, fit_rows))
    counts = sample.where("not held").select("text", "toxic").mapInArrow(word_counts, "code long, bad long, good long")
    kinds = counts.groupBy("code").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).where(f"bad + good >= {LEAST_DOCS}").toArrow()
    n_bad, n_good = (sample.where("not held").agg(F.count_if("toxic"), F.count_if(~F.col("toxic"))).first())
    bad, good = kinds["bad"].to_numpy(), kinds["good"].to_numpy()
    # relative document frequencies, smoothed by the frequency over all, so that rare words count little
    share = (bad + good) / max(1, n_bad + n_good)
    weight = np.log((bad + 8 * share) / (max(n_bad, 1) + 8)) - np.log((good + 8 * share) / (max(n_good, 1) + 8))
    code = kinds["code"].to_numpy().astype(np.int64).view(_U)
    telling = weight >= LEAST_ODDS
    code, weight = code[telling], weight[telling]
    order = np.argsort(code)
    lexicon = Lexicon(code[order], np.round(weight[order], 9))
    stats = cut(sample.select("text", "good", "held").mapInArrow(_statistics_of(lexicon), "stats array<double>, good boolean, held boolean").coalesce(8))
    both = {(r.held, r.good) for r in stats.select("held", "good").distinct().collect()}
    if not {(False, True), (False, False)} <= both:
        return None
    width = len(STATISTICS)
    fitted = stats.where("not held")
    moments = fitted.agg(*[f(F.get("stats", F.lit(i))) for i in range(width) for f in (F.avg, F.stddev_pop)]).first()
    mean, scale = np.array(moments[0::2]), np.array(moments[1::2])
    scale = np.where(scale > 1e-9, scale, 1.0)
    rows = fitted.select("stats", "good").mapInArrow(_normal_equations(mean, scale), "row long, sums array<double>")
    total = np.array([r.sums for r in rows.groupBy("row").applyInArrow(_add, "row long, sums array<double>").orderBy("row").collect()])
    gram, target = total[:, :-1], total[:, -1]
    penalty = RIDGE * np.eye(len(gram))
    penalty[-1, -1] = 1e-9
    weights = np.linalg.solve(gram + penalty, target)
    held = stats.where("held").select("stats", "good").toArrow()
    x = np.array(held["stats"].combine_chunks().flatten()).reshape(-1, width) if held.num_rows else np.zeros((0, width))
    if held.num_rows:
        scores, chances = isotonic(np.round(fourier((x - mean) / scale) @ weights, 9), held["good"].to_numpy().astype(float))
    else:
        scores, chances = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return Model(lexicon, mean, scale, weights, scores, chances)


def _score(model: Model | None, text_at: int, threshold: float, keep_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_at):
                stats, filled = statistics(part.column(text_at).cast(pa.string()), model.lexicon if model else Lexicon(np.zeros(0, _U), np.zeros(0)))
                chance = np.round(model.probability(stats), 6) if model else np.full(len(stats), np.nan)
                keep = filled & ((chance >= threshold) if model else True)
                if keep_only:
                    yield part.filter(pa.array(keep))
                else:
                    chance = pa.array(np.where(filled, chance, 0.0), mask=np.isnan(chance) & filled)
                    yield pa.RecordBatch.from_arrays([part.column(0), chance, pa.array(keep)], ["doc_id", "probability", "keep"])

    return run


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """For each row (doc_id, probability, keep): how probably the document is good, and whether that reaches threshold.

    A null text, or one without a word, has probability 0. A text may be of any length; statistics beyond CLIP deviations count as CLIP. Each row is scored by itself, so repeated rows agree and null ids do no harm. If the
    labelled documents are all good or all bad (or there are none), nothing is learned: probabilities are null and each text with a word is kept.
    An empty table gives no rows.
    """
    model = fit(docs, labels, id_col, text_col)
    plain = docs.select(col(docs, id_col).cast("long").alias("doc_id"), col(docs, text_col).cast("string").alias("text"))
    return plain.mapInArrow(_score(model, 1, threshold, False), "doc_id long, probability double, keep boolean")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score() keeps, with all their columns."""
    model = fit(docs, labels, id_col, text_col)
    at = next(i for i, c in enumerate(docs.columns) if c.lower() == text_col.lower())
    return docs.mapInArrow(_score(model, at, threshold, True), docs.schema)
