"""Toxic passages as maximum-scoring segments.

A word has the log-odds of its share of the words of toxic documents to its share of the words of clean ones, both smoothed
by a Dirichlet prior in proportion to its share of all. It stands for itself and for its proper prefixes of the lengths
``PREFIXES``; of these the one that most documents speak for gives its score, above or below zero. Words of which nothing is
known share one negative score, set so that the expectation of exp(score) over clean words is 1. A linear scan then
finds every maximal scoring segment of a text (the all-maximal-segments problem).

The highest segment of a clean text of n words follows an extreme-value law, P(S <= s) = exp(-K n exp(-lambda s)). K and lambda are
fitted by maximum likelihood to clean training texts that the words were not counted in, so that a segment has the number of such segments to
expect by chance. That judges the best and the significant segments, and a logistic curve fitted on the same part turns both into the probability of the label.

The model is fitted on at most ``SAMPLE`` labelled rows (the first by a hash of the id), of which a
quarter only calibrates; scores use the text alone.

Where a significant passage stands is told in code points of the text itself. Defined cases: a null or empty text has no words and gets the probability of no evidence; ids with
several labels are toxic if one of the labels is; null ids or labels train nothing; repeated rows
are scored each; a very long text is scanned whole, in time linear in its words; an empty table gives no rows; without training rows of both kinds every score is 0.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, text_slices

#: Labelled rows that the model is fitted on at most, which bounds its entries too.
SAMPLE = 16_000
PREFIXES = range(3, 13)
#: Total weight of the prior, in words; least root of the likelihood ratio of the documents that speak for an entry.
PRIOR, LEAST_Z = 20_000.0, 4.0
#: Segments of a clean text of the same length as good, that a significant one may have on average.
E_VALUE = 0.05
_WORD = re.compile(r"[^\W\d_]+")
words_of = _WORD.findall
#: Bounds of what a task keeps: words and their length in a cache, entries between two parts of its counts.
WORDS_KEPT, LONGEST_KEPT, COUNTED_AT_ONCE = 50_000, 40, 150_000


def entries_of(word: str) -> list[str]:
    """The word, marked as whole, and its proper prefixes."""
    return [word + "$", *[word[:n] for n in PREFIXES if n < len(word)]]


@dataclass
class Segments:
    """What a text shows: words, and (score, first word, last word) of its maximal segments."""

    n_words: int
    found: list[tuple[float, int, int]]


def maximal_segments(places: list[int], scores: list[float], between: float) -> list[tuple[float, int, int]]:
    """All maximal scoring segments, in one pass over the words that have scores of their own.

    ``between`` is the (negative) score of every other word. Candidates are kept as (sum before,
    sum with, first, last, link); a new one swallows back to the latest whose sum before is lower, as long as
    that makes it higher. The link leads to the latest candidate of lower sum before, so that none is passed twice.
    """
    kept: list[tuple[float, float, int, int, int]] = []
    total, last = 0.0, -1
    for at, score in zip(places, scores):
        low = total + between * (at - last - 1)
        total, last = low + score, at
        if score <= 0:
            continue
        high, first, j = total, at, len(kept) - 1
        while True:
            while j >= 0 and kept[j][0] >= low:
                j = kept[j][4]
            if j < 0 or kept[j][1] >= high:
                break
            low, _, first, _, link = kept[j]
            del kept[j:]
            j = link
        kept.append((low, high, first, at, j))
    return [(high - low, first, end) for low, high, first, end, _ in kept]


@dataclass(frozen=True)
class ChanceLaw:
    """Extreme-value law of the highest segment of a clean text."""

    k: float = 1.0
    rate: float = 1.0

    def surprise(self, score: float, n_words: int) -> float:
        """Minus the logarithm of how many such segments a clean text of this length has by chance."""
        return self.rate * score - math.log(self.k * (n_words + 1))


def fit_law(seen: list[tuple[float, int]]) -> ChanceLaw:
    """Maximum likelihood of (highest score, words) of clean texts; those without any segment count as below the least score there is.

    For a given rate the best K is in closed form; the rate is found by thirds between bounds that no log-odds scale leaves.
    """
    scores, sizes = np.array([s for s, _ in seen], float), np.array([n + 1 for _, n in seen], float)
    some = scores > 0
    if some.sum() < 5:
        return ChanceLaw()
    shown = np.where(some, scores, scores[some].min())

    def fitted(rate: float) -> tuple[float, float]:
        k = some.sum() / float((sizes * np.exp(-rate * shown)).sum())
        return some.sum() * (math.log(rate) + math.log(k)) - rate * float(scores[some].sum()), k

    low, high = 0.02, 5.0
    for _ in range(80):
        a, b = low + (high - low) / 3, high - (high - low) / 3
        low, high = (a, high) if fitted(a)[0] < fitted(b)[0] else (low, b)
    return ChanceLaw(float(fitted(low)[1]), low)


class Model:
    def __init__(self, scores: dict[str, float], support: dict[str, float], between: float, curve: tuple[float, float, float] | None = None, law: ChanceLaw = ChanceLaw()):
        self.scores, self.support, self.between, self.curve, self.law = scores, support, between, curve, law
        self._words: dict[str, float] = {}

    def __getstate__(self):
        return (self.scores, self.support, self.between, self.curve, self.law)

    def __setstate__(self, state):
        self.__init__(*state)

    def word(self, word: str) -> float:
        """Score of a word in any case; 0 stands for the shared negative score."""
        got = self._words.get(word)
        if got is None:
            if len(self._words) >= WORDS_KEPT:
                self._words.clear()
            best = max((e for e in entries_of(word.lower()) if e in self.scores), key=self.support.__getitem__, default=None)
            got = self.scores[best] if best is not None else 0.0
            if len(word) <= LONGEST_KEPT:
                self._words[word] = got
        return got

    def segments(self, text: str) -> Segments:
        found = words_of(text)
        known, word = self._words.get, self.word
        scored = [s if (s := known(w)) is not None else word(w) for w in found]
        places = [i for i, s in enumerate(scored) if s]
        return Segments(len(found), maximal_segments(places, [scored[i] for i in places], self.between))

    def evidence(self, seen: Segments) -> tuple[float, float]:
        """(surprise of the best segment, sum of the surprises above zero)."""
        over = [self.law.surprise(s, seen.n_words) for s, _, _ in seen.found]
        return max(over, default=self.law.surprise(0.0, seen.n_words)), sum(x for x in over if x > 0)

    def probability(self, seen: Segments) -> float:
        if self.curve is None:
            return 0.0
        z = sum(w * x for w, x in zip(self.curve, features(*self.evidence(seen))))
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(z, 30.0))))

    def score(self, text: str) -> float:
        return self.probability(self.segments(text))

    def significant(self, seen: Segments, e_value: float = E_VALUE) -> list[tuple[float, int, int]]:
        """Segments of which a clean text of this length holds at most ``e_value`` by chance."""
        return [x for x in seen.found if self.law.surprise(x[0], seen.n_words) >= -math.log(e_value)]


def features(best: float, total: float) -> tuple[float, float, float]:
    """What the logistic curve weighs: both surprises, on a scale on which no single passage outgrows all others."""
    return 1.0, math.asinh(best), math.log1p(total)


def places(text: str, segments: list[tuple[float, int, int]]) -> str:
    """start:end of each segment in code points, the end exclusive, comma-joined in order."""
    if not segments:
        return ""
    spans = [m.span() for m in _WORD.finditer(text)]
    return ",".join(f"{spans[a][0]}:{spans[z][1]}" for _, a, z in sorted(segments, key=lambda x: x[1]))


def held_out():
    """Column: rows that must not be learned from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(text, toxic, part) of the sample; part 3 calibrates. The sample is small enough to broadcast."""
    some = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = some.withColumn("h", F.xxhash64("doc_id", F.lit(3))).orderBy("h", "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")
    return rows.select(F.coalesce("text", F.lit("")).alias("text"), F.col("toxic").cast("int").alias("toxic"), F.pmod("h", F.lit(4)).cast("int").alias("part"))


COUNTS = "entry string, t1 bigint, t0 bigint, n1 bigint, n0 bigint"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one task's rows, in parts: how often an entry occurs in toxic and clean documents (t1, t0) and in how many (n1, n0); '' holds the totals."""
    times: tuple[Counter, Counter] = (Counter(), Counter())
    docs: tuple[Counter, Counter] = (Counter(), Counter())

    def part() -> pa.RecordBatch:
        keys = list(docs[0].keys() | docs[1].keys())
        columns = [pa.array(keys, pa.string()), *[pa.array([c[k] for k in keys], pa.int64()) for c in (times[1], times[0], docs[1], docs[0])]]
        for c in (*times, *docs):
            c.clear()
        return pa.RecordBatch.from_arrays(columns, ["entry", "t1", "t0", "n1", "n0"])

    for b in text_slices(batches):
        for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            words = Counter(w.lower() for w in words_of(text))
            here: Counter = Counter()
            for w, n in words.items():
                for e in entries_of(w):
                    here[e] += n
            here[""] = words.total()
            times[toxic].update(here)
            docs[toxic].update(here.keys())
            if len(docs[0]) + len(docs[1]) > COUNTED_AT_ONCE:
                yield part()
    yield part()


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit entries, law and curve. What reaches the driver is bounded by the sample's words."""
    rows = training_rows(docs, labels, sample).cache()
    try:
        counted = map_texts(rows.where("part < 3").select("text", "toxic"), _count, COUNTS)
        summed = counted.groupBy("entry").agg(*[F.sum(c).alias(c) for c in ("t1", "t0", "n1", "n0")]).cache()
        total = summed.where("entry = ''").first()
        if total is None or not total["n1"] or not total["n0"]:
            return Model({}, {}, -1.0)
        t1, t0, n1, n0 = (float(total[c]) for c in ("t1", "t0", "n1", "n0"))
        prior = PRIOR * (F.col("t1") + F.col("t0")) / max(1.0, t1 + t0)
        odds = F.log((F.col("t1") + prior) / (t1 + PRIOR)) - F.log((F.col("t0") + prior) / (t0 + PRIOR))
        share = (F.col("n1") + F.col("n0")) / (n1 + n0)
        told = lambda n, all_: F.when(F.col(n) > 0, F.col(n) * F.log(F.col(n) / (share * all_))).otherwise(0.0)
        scored = summed.where("entry <> '' AND n1 + n0 >= 2").select("entry", odds.alias("score"), (F.col("n1") / n1 > F.col("n0") / n0).alias("up"), F.sqrt(2 * F.greatest(told("n1", n1) + told("n0", n0), F.lit(0.0))).alias("z"))
        best = scored.where((F.col("z") >= LEAST_Z) & (F.col("up") == (F.col("score") > 0))).orderBy(F.desc("z"), "entry").collect()
        summed.unpersist()
        scores, support = {r["entry"]: r["score"] for r in best}, {r["entry"]: r["z"] for r in best}
        draft = Model(scores, support, -1.0)

        def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in text_slices(batches):
                found = Counter(round(draft.word(w), 6) for t in b.column(0).to_pylist() for w in words_of(t))
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.float64()), pa.array(list(found.values()), pa.int64())], ["s", "n"])

        drawn = map_texts(rows.where("part < 3 AND toxic = 0").select("text"), clean, "s double, n bigint").groupBy("s").agg(F.sum("n").alias("n")).collect()
        everything = sum(r["n"] for r in drawn) or 1
        zero = sum(r["n"] for r in drawn if r["s"] == 0) / everything
        risen = sum(r["n"] * math.exp(r["s"]) for r in drawn if r["s"] != 0) / everything
        between = math.log(max(1e-3, (1 - min(risen, 0.5)) / max(zero, 1e-9)))
        model = Model(scores, support, min(between, -0.05))

        def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in text_slices(batches):
                found = [model.segments(t) for t in b.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([x.n_words for x in found], pa.int64()), pa.array([[s for s, _, _ in x.found] for x in found], pa.list_(pa.float64())), b.column(1)], ["n", "found", "toxic"])

        shown = map_texts(rows.where("part = 3").select("text", "toxic"), seen, "n bigint, found array<double>, toxic int").orderBy("n", "found", "toxic").collect()
        model.law = fit_law([(max(r["found"], default=0.0), r["n"]) for r in shown if not r["toxic"]])
        points = [features(*model.evidence(Segments(r["n"], [(s, 0, 0) for s in r["found"]]))) for r in shown]
        model.curve = _logistic(points, [r["toxic"] for r in shown])
        return model
    finally:
        rows.unpersist()


def _logistic(x: list[tuple[float, float, float]], y: list[int], ridge: float = 0.1, steps: int = 50) -> tuple[float, float, float]:
    """Newton steps of ridge-penalised logistic regression."""
    if not x:
        return (-2.0, 1.0, 1.0)
    a, t, w = np.array(x), np.array(y, float), np.zeros(3)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(3), a.T @ (t - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in w)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_segments, segments) of every whole text; map-only.

    ``segments`` has the places of every significant passage, whatever the score of the whole text.
    """
    source = docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches):
            scores, counts, spans = [], [], []
            for text in b.column(2).to_pylist():
                seen = model.segments(text)
                found = model.significant(seen)
                scores.append(model.probability(seen))
                counts.append(len(found))
                spans.append(places(text, found))
            columns = [b.column(0), b.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(counts, pa.int32()), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted", "n_segments", "segments"])

    return map_texts(source, run, f"doc_id {kind}, held_out boolean, score double, predicted int, n_segments int, segments string")
