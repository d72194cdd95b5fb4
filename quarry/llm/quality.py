"""Quality by kernel ridge regression over document statistics.

Statistics of a whole text (shares of kinds of letters, words and line ends, repetition of neighbouring words and within blocks
of words) are standardised by their means and deviations over all documents. Random Fourier features approximate a Gaussian
kernel over them. Every partition of the labelled training rows sums its part of the normal equations, by fold; the sums are
added level by level, and the driver solves systems of FEATURES unknowns: one for each fold left out, one for all. Isotonic
regression of the labels on the scores that rows get from the other folds calibrates them: scores are rounded to a grid,
counted in Spark, and adjacent violators are pooled on the grid's counts, so it is exact for any number of rows.

All labelled rows that aren't held out take part, whatever their number. Labels, languages, sources and ids are never inputs
of a score.

Defined cases: null and empty texts have statistics of zero and are scored like any other; without training rows every score is
0.5; labels that are null are no labels, and a document labelled twice is good only if both say so; each row with a labelled
doc_id is a training row; rows with equal texts get equal scores; null doc_ids are scored and held out; texts of any length are
read in pieces of PIECE bytes, where a word that is cut counts as two; an empty table gives no rows; other columns pass,
whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from .staging import carried, stored
from .sums import rows_of, summed
from .tokens import release
from .toxicity import held_out

#: Fourier features, the kernel's width in standard deviations, the ridge for each row, folds, points of the calibration grid in a unit.
FEATURES, WIDTH, RIDGE, FOLDS, GRID = 256, 3.0, 1e-4, 4, 2_048
#: Scores outside this range lie at its ends on the grid.
LEAST, MOST = -1.0, 2.0
#: What the raw score adds to the calibrated one, so that equal calibrated scores keep an order.
ORDER = 0.01
#: Bytes of a text, and of several texts, that are looked at together; words of a block.
PIECE, TOGETHER, BLOCK = 1 << 20, 2 << 20, 64

#: Kinds of bytes.
SPACE, LINE, UPPER, LOWER, DIGIT, STOP, MARK, HIGH, INNER = range(9)


def _kinds() -> np.ndarray:
    kinds = np.full(256, MARK, np.uint8)
    kinds[[9, 11, 12, 13, 32]] = SPACE
    kinds[10] = LINE
    kinds[65:91], kinds[97:123], kinds[48:58] = UPPER, LOWER, DIGIT
    kinds[[ord(c) for c in ".,;:!?'\"()-"]] = STOP
    kinds[128:192], kinds[192:] = INNER, HIGH  # of a letter outside ASCII: its first byte and the others
    return kinds


KINDS = _kinds()
LOWERED = np.arange(256, dtype=np.uint64)
LOWERED[65:91] += 32
#: Counts of a text, by which the statistics are made.
COUNTED = 8 + 11
#: Statistics of a text.
NUMBERS = 17


def counted(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Counts of each piece of data; pieces start at starts, none is empty."""
    kind, n = KINDS[data], len(data)
    out = np.zeros((len(starts), COUNTED))
    for k in range(8):
        out[:, k] = np.add.reduceat(kind == k, starts, dtype=np.int64)
    first = np.zeros(n, bool)
    first[starts] = True
    blank = kind <= LINE
    opens = ~blank & (first | np.concatenate(([True], blank[:-1])))
    begin = np.flatnonzero(opens)
    if not len(begin):
        return out
    piece = np.searchsorted(starts, begin, "right") - 1
    # a word ends before the next blank or the next piece
    stops = np.append(np.flatnonzero(blank | first), n)
    end = stops[np.searchsorted(stops, begin, "right")]
    size = end - begin
    tally = lambda flags: np.bincount(piece, flags, len(starts))

    def within(k: int) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(kind == k)))
        return total[end] - total[begin]

    upper, lower, high = within(UPPER), within(LOWER), within(HIGH)
    last, last_but_one = kind[end - 1], kind[np.maximum(end - 2, 0)]
    marked = lambda x: (x == STOP) | (x == MARK)
    # a word's polynomial hash, by prefix sums modulo 2^64
    odd, back = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(n, odd))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(LOWERED[data] * power)))
        undo = np.cumprod(np.full(n, back))
        word = (sums[end] - sums[begin]) * undo[begin]
    again = np.zeros(len(begin), bool)
    again[1:] = (word[1:] == word[:-1]) & (piece[1:] == piece[:-1])
    number = np.arange(len(begin)) - np.searchsorted(piece, piece, "left")
    block = np.cumsum((number % BLOCK == 0).astype(np.int64))
    order = np.lexsort((word, block))
    new = np.ones(len(begin), bool)
    new[1:] = (word[order][1:] != word[order][:-1]) | (block[order][1:] != block[order][:-1])
    flags = (
        np.ones(len(begin)), size, kind[begin] == UPPER, (upper > 1) & (lower == 0), (upper + lower + high) == 0,
        (size > 2) & marked(last) & marked(last_but_one), last == STOP, last == MARK, again, size > 12,
    )
    for i, f in enumerate(flags):
        out[:, 8 + i] = tally(np.asarray(f, float))
    out[:, 18] = np.bincount(piece[order], new, len(starts))
    return out


def numbers(counts: np.ndarray) -> np.ndarray:
    """Statistics of texts by their counts: sizes on a logarithmic scale, all else as shares."""
    space, line, upper, lower, digit, stop, mark, high = counts[:, :8].T
    words, size, capital, shout, bare, marks, stopped, marked, again, long, distinct = counts[:, 8:].T
    share = lambda a, b: a / np.maximum(b, 1)
    seen, letters = upper + lower + digit + stop + mark + high, upper + lower
    columns = (
        np.log1p(seen + space + line) / 5, np.log1p(words) / 5, np.log1p(share(size, words)), share(upper, letters), share(digit, seen),
        share(stop, seen), share(mark, seen), share(high, seen), share(capital, words), share(shout, words), share(bare, words),
        share(marks, words), share(stopped, words), share(marked, words), share(again, words), share(distinct, words), share(long, words) + share(line, words),
    )
    return np.stack(columns, 1)


def statistics(texts: pa.Array) -> np.ndarray:
    """NUMBERS statistics of each text."""
    counts = np.zeros((len(texts), COUNTED))
    waiting: list[tuple[int, np.ndarray]] = []
    held = 0

    def flush() -> None:
        if waiting:
            starts = np.concatenate(([0], np.cumsum([len(d) for _, d in waiting])[:-1]))
            np.add.at(counts, [i for i, _ in waiting], counted(np.concatenate([d for _, d in waiting]), starts))
            waiting.clear()

    for i in range(len(texts)):
        data = texts[i].as_buffer() if texts[i].is_valid else None
        if data is None or not data.size:
            continue
        data = np.frombuffer(data, np.uint8)
        for at in range(0, len(data), PIECE):
            waiting.append((i, data[at : at + PIECE]))
            held += len(waiting[-1][1])
            if held >= TOGETHER:
                flush()
                held = 0
    flush()
    return numbers(counts)


def measured(texts: pa.Array) -> pa.Array:
    return pa.array(list(statistics(texts)), pa.list_(pa.float64()))


def pooled(score: np.ndarray, count: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression by pooling adjacent violators: mean score and rate of good rows of each block, from the counts at ascending scores."""
    blocks: list[list[float]] = []
    for s, c, g in zip(score.tolist(), count.tolist(), good.tolist(), strict=True):
        blocks.append([s * c, c, g])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            s2, c2, g2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s2, blocks[-1][1] + c2, blocks[-1][2] + g2]
    table = np.array(blocks).reshape(-1, 3)
    return table[:, 0] / table[:, 1], table[:, 2] / table[:, 1]


@dataclass
class Model:
    mean: np.ndarray
    deviation: np.ndarray
    waves: np.ndarray  # statistics by features
    phase: np.ndarray
    weights: np.ndarray | None = None  # of each fold left out, and of all
    scores: np.ndarray | None = None
    rates: np.ndarray | None = None

    def features(self, x: np.ndarray) -> np.ndarray:
        """The Fourier features of statistics, and a constant."""
        z = np.clip((x - self.mean) / self.deviation, -5, 5)
        out = np.empty((len(x), len(self.phase) + 1))
        out[:, :-1] = np.cos(z @ self.waves + self.phase) * np.sqrt(2 / len(self.phase))
        out[:, -1] = 1
        return out

    def raw(self, x: np.ndarray, fold: np.ndarray | None = None) -> np.ndarray:
        f = self.features(x)
        return f @ self.weights[-1] if fold is None else np.einsum("ij,ij->i", f, self.weights[fold])

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), 0.5)
        raw = np.clip(self.raw(x), LEAST, MOST)
        rate = np.interp(raw, self.scores, self.rates)
        return (1 - ORDER) * rate + ORDER * (raw - LEAST) / (MOST - LEAST)


def solved(sums: np.ndarray, ridge: float) -> np.ndarray:
    """Ridge weights from the normal equations: the Gram matrix, beside the products with the labels. The constant isn't shrunk."""
    gram, right = sums[:, :-1], sums[:, -1]
    shrink = np.full(len(gram), max(ridge * gram[-1, -1], 1e-9))
    shrink[-1] = 1e-9
    return np.linalg.solve(gram + np.diag(shrink), right)


def fit(stats: DataFrame, labels: DataFrame, features: int = FEATURES, seed: int = 11) -> Model:
    """The model of a table of doc_id and statistics."""
    moments = stats.agg(*(f(F.col("stats")[i]).alias(f"{name}{i}") for i in range(NUMBERS) for name, f in (("m", F.avg), ("d", F.stddev_pop)))).head()
    mean, deviation = (np.array([moments[f"{name}{i}"] or 0.0 for i in range(NUMBERS)]) for name in "md")
    rng = np.random.default_rng(seed)
    model = Model(mean, np.maximum(deviation, 1e-6), rng.normal(size=(NUMBERS, features)) / WIDTH, rng.uniform(0, 2 * np.pi, features))
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.min("quality") > 0).cast("int").alias("good"))
    known = known.where(~held_out(F.col("doc_id")))
    rows = stats.select(F.col("doc_id").cast("long").alias("doc_id"), "stats").join(known, "doc_id")
    fold = F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(FOLDS)).cast("int").alias("fold")
    rows = stored(rows.select("stats", "good", fold), "quality-training")
    wide = features + 1

    def equations(batches):
        total = None
        for batch in batches:
            total = np.zeros((FOLDS * wide, wide + 1)) if total is None else total
            for at in range(0, batch.num_rows, 4096):
                some = batch.slice(at, 4096)
                f, y, fold = model.features(rows_of(some.column(0))), some.column(1).to_numpy(), some.column(2).to_numpy()
                for k in range(FOLDS):
                    z = f[fold == k]
                    total[k * wide : (k + 1) * wide, :-1] += z.T @ z
                    total[k * wide : (k + 1) * wide, -1] += z.T @ y[fold == k]
        return total

    sums = summed(rows, equations, (FOLDS * wide, wide + 1)).reshape(FOLDS, wide, wide + 1)
    every = sums.sum(0)
    if not every[-1, -2]:
        return model
    model.weights = np.stack([solved(every - s if every[-1, -2] > s[-1, -2] else every, RIDGE) for s in sums] + [solved(every, RIDGE)])

    def out_of_fold(batches):
        release()
        for batch in batches:
            raw = np.clip(model.raw(rows_of(batch.column(0)), batch.column(2).to_numpy()), LEAST, MOST) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(np.rint(raw * GRID).astype(np.int64)), batch.column(1)], names=["point", "good"])

    points = rows.mapInArrow(out_of_fold, "point long, good int").groupBy("point").agg(F.count("*").alias("n"), F.sum("good").alias("good"))
    table = points.toArrow().sort_by("point")  # at most as many as the grid has points
    point, n, good = (table.column(i).to_numpy().astype(float) for i in range(3))
    model.scores, model.rates = pooled(point / GRID, n, good)
    return model


def statistics_of(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of each whole text, stored."""

    def run(batches):
        release()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), measured(batch.column(1))], names=["doc_id", "stats"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return stored(rows.mapInArrow(run, rows.select("doc_id").schema.add("stats", ArrayType(DoubleType()))), "quality-statistics")


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: whether it was held out, its score and the prediction."""
    stats = statistics_of(docs)
    model = fit(stats, labels)

    def run(batches):
        release()
        for batch in batches:
            score = model.score(rows_of(batch.column(1))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["doc_id", "score"])

    rows = stats.mapInArrow(run, stats.select("doc_id").schema.add("score", "double"))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """row (all columns of docs) and the score of its whole text."""
    model = fit(statistics_of(docs), labels)
    rows = carried(docs)

    def run(batches):
        release()
        for batch in batches:
            score = model.score(statistics(batch.column(1))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["row", "score"])

    return rows.withColumn("text", F.col("row.text").cast("string")).mapInArrow(run, rows.schema.add("score", "double"))


def with_quality(docs: DataFrame, labels: DataFrame, least: float = 0.3) -> DataFrame:
    """The documents whose score is at least so high."""
    return scored(docs, labels).where(F.col("score") >= least).select("row.*")
