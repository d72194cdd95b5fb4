"""Toxicity by weak supervision.

Voters are term lists and patterns: terms (words, word beginnings, and beginnings that several words share) that stand out among
the toxic of the labelled training rows, dealt into disjoint lists, a fixed list, patterns of tone, and voters for the absence
of any term. The sample has FOLDS parts, and lists mined from the others vote on each, so no row's own label reaches its votes;
the annotation itself is no voter. A generative model (two classes with means and a shared covariance of the votes, fitted by
expectation-maximisation) estimates each voter's accuracy and the voters' correlations and gives posterior labels; a linear
classifier over terms and voters is trained on these posteriors, never on the labels, and scores every document's whole text.

The model is fitted on a sample of labelled rows that is bounded by SAMPLE, whatever the input; everything else is a
single scan. Labels, languages, sources and ids are never inputs of a score.

Defined cases: null and empty texts have no terms and get the score of the bias and of the absence of terms; without training
rows every score is 0; labels that are null are no labels, and a document labelled twice counts as toxic if either says so; of
several texts with a labelled doc_id the least one is in the sample; repeated rows get equal scores; null doc_ids are scored and held
out; an empty table gives no rows; other columns pass, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import carried, stored
from .tokens import release, sliced

#: Labelled rows that the model is fitted on, at most.
SAMPLE = 12_000
#: Documents of the sample that must have a term.
LEAST = 3
#: Parts of the sample, each voted on by lists from the others.
FOLDS = 4
#: Standard deviations by which a term is more frequent among the toxic, for the classifier and for lists. Terms of clean texts aren't counted: they would add up in long texts.
STANDS_OUT, LISTED = 6, 3
#: Letters of word beginnings.
HEADS = (4, 5, 7)
#: Disjoint lists of mined terms.
LISTS = 12
#: Words that are insults in common use. Fixed values.
INSULTS = frozenset("idiot moron stupid loser scum trash pathetic worthless disgusting clown dumb fool imbecile dummkopf trottel abschaum arschloch crétin connard ordure imbécile estúpido basura asqueroso escoria".split())
WORD = re.compile(r"[^\W\d_]+")
SHOUT = re.compile(r"\b[A-Z]{4,}\b")
BANGS = re.compile(r"[!?]{2,}")
NAMED = re.compile(r"\byou(?:'re| are)\b", re.I)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def training(docs: DataFrame, labels: DataFrame, bound: int) -> DataFrame:
    """doc_id, text, toxic, fold of a bounded sample of the labelled rows that aren't held out, by a hash of the id."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    some = known.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    of_id = texts.join(F.broadcast(some), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))  # at most SAMPLE ids are broadcast
    return stored(of_id.withColumn("fold", F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(FOLDS)).cast("int")), "toxic-sample")


def terms_in(text: str) -> set[str]:
    """Distinct words, word beginnings (^), and beginnings of two words and more (2^)."""
    words = set(WORD.findall(text.lower()))
    heads = Counter(w[:n] for w in words for n in HEADS if len(w) >= n)
    return words | {"^" + h for h in heads} | {"2^" + h for h, n in heads.items() if n > 1}


def mined(sample: DataFrame) -> list[tuple[str, list[bool]]]:
    """(term, whether lists for each fold have it) of the terms that stand out among the toxic of the sample, or of all folds but that."""

    def run(batches):
        release()
        for batch in batches:
            for at, texts in sliced(batch.column(0)):
                counts: Counter = Counter()
                kinds = (batch.column(i).slice(at, len(texts)).to_pylist() for i in (1, 2))
                for text, toxic, fold in zip(texts, *kinds, strict=True):
                    counts.update((t, 2 * fold + int(toxic > 0)) for t in terms_in(text))
                rows = list(counts.items())
                yield pa.RecordBatch.from_arrays([pa.array([r[0][0] for r in rows], pa.string()), pa.array([r[0][1] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64())], names=["term", "kind", "n"])

    rows = sample.select("text", "toxic", "fold").mapInArrow(run, "term string, kind int, n long")
    counts = rows.groupBy("term").agg(*(F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(2 * FOLDS)), F.sum("n").alias("every")).where(F.col("every") >= LEAST)
    sizes = {(r[0], r[1]): r[2] for r in sample.groupBy("fold", (F.col("toxic") > 0).cast("int")).count().collect()}

    def tells(folds: list[int]) -> tuple[Column, Column, Column]:
        """Standard deviations above the rate of the folds, toxic and other documents there."""
        positive, others = (sum(sizes.get((f, k), 0) for f in folds) for k in (1, 0))
        rate = (positive + 0.5) / (positive + others + 1)
        toxic, other = (reduce(Column.__add__, (F.col(f"n{2 * f + k}") for f in folds)) for k in (1, 0))
        n = toxic + other
        return (toxic - n * rate) / F.sqrt(F.greatest(n, F.lit(1)) * rate * (1 - rate)), toxic, other

    of_all = list(range(FOLDS))
    strong = [(z >= LISTED) & (toxic >= LEAST) & (toxic > 4 * other) for z, toxic, other in (tells([f for f in of_all if f != g]) for g in of_all)]
    found = counts.select("term", F.array(*strong).alias("strong"), (tells(of_all)[0] >= STANDS_OUT).alias("out")).where(F.col("out") | F.array_contains("strong", True))
    return sorted((r[0], r[1]) for r in found.collect())  # as many as a bounded sample has


@dataclass
class Model:
    terms: dict[str, int] = field(default_factory=dict)
    lists: list[dict[int, int]] = field(default_factory=list)  # for rows of each fold: term number to list of toxic terms
    insults: set[int] = field(default_factory=set)  # numbers of the fixed list's terms
    weights: np.ndarray | None = None
    bias: float = 0.0
    accuracies: list[float] = field(default_factory=list)
    correlations: np.ndarray | None = None

    def terms_of(self, text: str, memo: dict[str, tuple]) -> list[int]:
        """Numbers of the known terms in a text."""
        found, once = set(), set()
        for w in set(WORD.findall(text.lower())):
            known = memo.get(w)
            if known is None:
                heads = [w[:n] for n in HEADS if len(w) >= n]
                known = tuple(self.terms[t] for t in (w, *("^" + h for h in heads)) if t in self.terms), tuple(self.terms["2^" + h] for h in heads if "2^" + h in self.terms)
                if len(memo) > 50_000:
                    memo.clear()
                memo[w] = known = known if known[0] or known[1] else ()
            if known:
                found.update(known[0])
                for t in known[1]:
                    (found if t in once else once).add(t)
        return sorted(found)

    def list_votes(self, found: list[int], fold: int) -> list[int]:
        """1 toxic, -1 clean, 0 no opinion, of the lists for rows of a fold and of the absence of their terms."""
        hits, of = [0] * LISTS, self.lists[fold]
        for t in found:
            if t in of:
                hits[of[t]] += 1
        even, odd = sum(hits[::2]), sum(hits[1::2])
        return [*(int(h > 0) for h in hits), int(even > 1), int(odd > 1), -int(even == 0), -int(odd == 0)]

    def text_votes(self, text: str, found: list[int]) -> list[int]:
        """The same of the fixed list and of patterns of tone."""
        fixed = any(t in self.insults for t in found)
        return [int(fixed), int(len(SHOUT.findall(text)) > 2), int(BANGS.search(text) is not None), int(fixed and NAMED.search(text) is not None)]

    def votes(self, text: str, found: list[int], fold: int) -> list[int]:
        return self.list_votes(found, fold) + self.text_votes(text, found)

    def score(self, text: str | None, memo: dict) -> float:
        if self.weights is None:
            return 0.0
        text = text or ""
        found = self.terms_of(text, memo)
        own = self.weights[len(self.terms) :]
        z = self.bias + float(self.weights[found].sum()) + float(own[-4:] @ self.text_votes(text, found))
        # the lists of all folds, equally; where none has a term of the text they agree
        listed = any(t in of for of in self.lists for t in found)
        folds = range(FOLDS if listed else 1)
        z += sum(float(own[:-4] @ self.list_votes(found, f)) for f in folds) / len(folds)
        return float(1 / (1 + np.exp(-min(max(z, -30.0), 30.0))))


def label_model(votes: np.ndarray, prior: float, rounds: int = 4) -> tuple[np.ndarray, list[float], np.ndarray]:
    """Posterior labels, accuracies and correlations of voters: EM for two classes of votes with one covariance.

    It starts from a vote in which voters that say the same share one voice, and takes few rounds, so that a clique of
    voters doesn't become the class.
    """
    v = votes.astype(float)
    alike = np.nan_to_num(np.cov(v.T) / np.sqrt(np.outer(v.var(0) + 1e-9, v.var(0) + 1e-9)))
    np.fill_diagonal(alike, 1)
    voice = 1 / (alike**4).sum(1)
    q = 1 / (1 + np.exp(-2 * (v @ voice + 0.25)))
    prior = min(max(prior, 0.01), 0.99)
    for _ in range(rounds):
        one, two = q.sum() + 1e-6, (1 - q).sum() + 1e-6
        m1, m0 = q @ v / one, (1 - q) @ v / two
        d1, d0 = v - m1, v - m0
        cov = ((d1 * q[:, None]).T @ d1 + (d0 * (1 - q)[:, None]).T @ d0) / len(v)
        cov += 0.02 * np.eye(v.shape[1])  # rare voters have little variance of their own
        w = np.linalg.solve(cov, m1 - m0)
        q = 1 / (1 + np.exp(-np.clip(v @ w - (m1 + m0) @ w / 2 + np.log(prior / (1 - prior)), -30, 30)))
    right = ((v > 0) * q[:, None] + (v < 0) * (1 - q)[:, None]).sum(0) / np.maximum(1, (v != 0).sum(0))
    spread = np.sqrt(np.diag(cov))
    return q, right.tolist(), cov / spread[:, None] / spread[None, :]


def logistic(index: np.ndarray, starts: np.ndarray, dense: np.ndarray, y: np.ndarray, n_terms: int, rounds: int = 120, ridge: float = 2e-5) -> tuple[np.ndarray, float]:
    """Weights of terms and voters, and the bias, by full-batch AdaGrad on soft labels."""
    lengths = np.diff(starts)
    w, b = np.zeros(n_terms + dense.shape[1]), 0.0
    squares, sb, n = np.full(len(w), 1e-8), 1e-8, len(y)
    for _ in range(rounds):
        sums = np.concatenate(([0.0], np.cumsum(w[index])))
        z = sums[starts[1:]] - sums[starts[:-1]] + dense @ w[n_terms:] + b
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        g = np.concatenate((np.bincount(index, np.repeat(error, lengths), n_terms), dense.T @ error)) + ridge * w
        squares += g * g
        sb += error.sum() ** 2
        w -= 0.3 * g / np.sqrt(squares)
        b -= 0.3 * error.sum() / np.sqrt(sb)
    return w, b


def fit(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> Model:
    sample = training(docs, labels, bound)
    known = mined(sample)
    model = Model(terms={t: i for i, (t, _) in enumerate(known)})
    for t in sorted(INSULTS):
        model.insults.add(model.terms.setdefault(t, len(model.terms)))
    model.lists = [{i: i % LISTS for i, (_, strong) in enumerate(known) if strong[f]} for f in range(FOLDS)]

    def run(batches):
        release()
        memo: dict = {}
        for batch in batches:
            for at, texts in sliced(batch.column(0)):
                found = [model.terms_of(t, memo) for t in texts]
                votes = [model.votes(t, f, h) for t, f, h in zip(texts, found, batch.column(2).slice(at, len(texts)).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), pa.array(votes, pa.list_(pa.int8())), batch.column(1).slice(at, len(texts))], names=["terms", "votes", "toxic"])

    table = sample.orderBy("doc_id").select("text", "toxic", "fold").mapInArrow(run, "terms array<int>, votes array<byte>, toxic int").toArrow()  # numbers of a bounded sample
    if not table.num_rows:
        return model
    prior = float(((table.column("toxic").to_numpy() > 0).sum() + 0.5) / (table.num_rows + 2))  # a few labels alone reject nothing
    votes = np.array(table.column("votes").to_pylist(), np.int8)
    posterior, model.accuracies, model.correlations = label_model(votes, prior)
    found = table.column("terms").combine_chunks()
    starts = found.offsets.to_numpy().astype(np.int64)
    model.weights, model.bias = logistic(found.values.to_numpy(), starts, votes.astype(float), posterior, len(model.terms))
    return model


def scored(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> DataFrame:
    """row (all columns of docs) and the score of its whole text."""
    model = fit(docs, labels, bound)

    def run(batches):
        release()
        memo: dict = {}
        for batch in batches:
            for at, texts in sliced(batch.column(1)):
                scores = [model.score(t, memo) for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(scores, pa.float64())], names=["row", "score"])

    rows = carried(docs)
    return rows.withColumn("text", F.col("row.text").cast("string")).mapInArrow(run, rows.schema.add("score", "double"))


def judged(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> DataFrame:
    """Per document: whether it was held out, its score and the prediction."""
    rows = scored(docs.select("doc_id", "text"), labels, bound).select("row.doc_id", "score")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> DataFrame:
    """The documents that aren't predicted toxic."""
    return scored(docs, labels, bound).where("score < 0.5").select("row.*")
