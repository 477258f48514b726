"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

The examples are at most ``EXAMPLES`` labelled rows in hash order, a documented bound. Terms are those
whose document counts differ between the two labels by more than chance among so many terms allows
(G statistic), at least ``LEAST_TERMS`` and at most ``MOST_TERMS``. The index keeps every term's postings
in blocks of examples with the block's highest weight; blocks are scored in order of their bound and
the search stops once no block can hold a nearer example, so the neighbours are exact.

Terms are whole words and beginnings of words; a word counts for the one of its terms that tells the
labels apart best. Term frequency enters as its square root, so that the cosine compares shares of a
text whatever its length, and one more dimension holds the words without a term.

The score is the neighbours' distance-weighted vote, pulled to the base rate, then calibrated on
leave-one-out votes of the examples. A text without any known term has the examples' rate among such.

Null text is empty. A label that is null teaches nothing; of several labels of a row the highest counts;
of several rows with one id the smallest text does. Without any example every score is 0. A null
doc_id is not held out. Labels, lang, source and doc_id are no input of a score.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import forget, text_bytes, tidy, written

EXAMPLES = 8000
LEAST_TERMS, MOST_TERMS = 8, 4096
#: Lengths in bytes of the word beginnings that are terms beside whole words.
BEGINNINGS = (4, 5, 6, 7, 8)
#: Words whose term a worker remembers.
REMEMBERED = 100_000
#: Weight of the one dimension that stands for all words without a term.
OTHER = 0.3
NEIGHBOURS, BLOCK = 15, 64
#: Bytes that are part of a term once A-Z are lower-cased: letters, and all of non-ASCII characters.
LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.lower().translate(LETTERS).split()


def terms(word: bytes) -> list[bytes]:
    """The word itself, marked by a final space, and its beginnings."""
    return [word + b" ", *(word[:n] for n in BEGINNINGS if n <= len(word))]


def g_statistic(a: float, b: float, n1: int, n0: int) -> float:
    """Twice the log-likelihood ratio of a term's document counts ``a`` of ``n1`` and ``b`` of ``n0``."""
    n = n1 + n0
    cells = ((a, (a + b) * n1 / n), (b, (a + b) * n0 / n), (n1 - a, (n - a - b) * n1 / n), (n0 - b, (n - a - b) * n0 / n))
    return 2 * sum(o * math.log(o / e) for o, e in cells if o > 0 and e > 0)


class BlockMaxIndex:
    """Unit vectors of examples by term, in blocks of ``BLOCK`` examples with each block's highest weight."""

    def __init__(self, vectors: list[dict[int, float]], n_terms: int):
        self.n = len(vectors)
        n_blocks = -(-self.n // BLOCK)
        entries = sorted((t, k, w) for k, v in enumerate(vectors) for t, w in v.items())
        self.example = np.array([k for _, k, _ in entries], np.int32)
        self.weight = np.array([w for _, _, w in entries], np.float64)
        slot = np.array([t * n_blocks + k // BLOCK for t, k, _ in entries], np.int64)
        self.at = np.searchsorted(slot, np.arange(n_terms * n_blocks + 1)).reshape(-1)
        self.bound = np.zeros((n_terms, n_blocks))
        np.maximum.at(self.bound.reshape(-1), slot, self.weight)
        self.n_blocks = n_blocks

    def nearest(self, query: dict[int, float], k: int, without: int = -1) -> list[tuple[float, int]]:
        """The ``k`` examples of highest cosine above 0: (cosine, example), ties by number."""
        if not query or not self.n:
            return []
        own = np.fromiter(query, np.int64, len(query))
        weights = np.fromiter(query.values(), np.float64, len(query))
        bounds = weights @ self.bound[own]
        best: list[tuple[float, int]] = []
        for block in np.argsort(-bounds, kind="stable"):
            if bounds[block] <= 0 or (len(best) == k and bounds[block] < -best[-1][0] - 1e-12):
                break
            score = np.zeros(BLOCK)
            for t, w in zip(own, weights):
                a, b = self.at[t * self.n_blocks + block], self.at[t * self.n_blocks + block + 1]
                score[self.example[a:b] - block * BLOCK] += w * self.weight[a:b]
            found = [(-float(score[i]), int(block) * BLOCK + int(i)) for i in np.flatnonzero(score > 0)]
            best = sorted(best + [x for x in found if x[1] != without])[:k]
        return [(-s, e) for s, e in best]


@dataclass
class Model:
    ids: list
    labels: np.ndarray
    #: In order of how well they tell the labels apart.
    vocabulary: dict[bytes, int]
    idf: np.ndarray
    index: BlockMaxIndex
    empty_rate: float
    base_rate: float
    slope: float = 1.0
    shift: float = 0.0

    def __post_init__(self):
        self.known: dict[bytes, int] = {}

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def vector(self, counted: dict[int, int]) -> dict[int, float]:
        """Unit vector; a text without any term has none. Term -1 counts the other words."""
        raw = {t: math.sqrt(n) * self.idf[t] for t, n in counted.items() if t >= 0}
        norm = math.sqrt(sum(w * w for w in raw.values()) + OTHER**2 * counted.get(-1, 0))
        return {t: w / norm for t, w in raw.items()} | {len(self.idf): OTHER * math.sqrt(counted.get(-1, 0)) / norm} if raw else {}

    def term(self, word: bytes) -> int:
        found = min((self.vocabulary[t] for t in terms(word) if t in self.vocabulary), default=-1)
        if len(self.known) < REMEMBERED:
            self.known[word] = found
        return found

    def count(self, text: bytes) -> dict[int, int]:
        known, own = self.known.get, words(text)
        found = [known(w) for w in own]
        if None in found:
            found = [self.term(w) if t is None else t for t, w in zip(found, own)]
        return dict(Counter(found))

    def vote(self, counted: dict[int, int], without: int = -1) -> tuple[float | None, list[tuple[float, int]]]:
        found = self.index.nearest(self.vector(counted), NEIGHBOURS, without)
        if not found:
            return None, []
        total = sum(s * s for s, _ in found)
        positive = sum(s * s * self.labels[e] for s, e in found)
        return (positive + 0.5 * self.base_rate) / (total + 0.5), found

    def score(self, counted: dict[int, int]) -> tuple[float, list[tuple[float, int]]]:
        vote, found = self.vote(counted)
        if vote is None:
            return self.empty_rate, []
        return 1 / (1 + math.exp(-(self.slope * logit(vote) + self.shift))), found


def logit(p: float) -> float:
    p = min(max(p, 1e-6), 1 - 1e-6)
    return math.log(p / (1 - p))


def calibrated(votes: list[float], labels: list[int]) -> tuple[float, float]:
    """Slope and shift of a logistic curve from votes to label rates, with smoothed targets, by Newton steps."""
    y = np.array(labels, float)
    if len(y) < 20 or y.min() == y.max():
        return 1.0, 0.0
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    x = np.column_stack([[logit(v) for v in votes], np.ones(len(y))])
    beta, penalty = np.array([1.0, 0.0]), np.diag([0.5, 0.05])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (p - target) + penalty @ (beta - [1.0, 0.0])
        beta = beta - np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, gradient)
    return (float(beta[0]), float(beta[1])) if np.isfinite(beta).all() and beta[0] > 0 else (1.0, 0.0)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def examples_of(documents: DataFrame, labels: DataFrame, label: str = "toxic", most: int = EXAMPLES) -> DataFrame:
    """doc_id, text and y of the labelled rows to learn from, written."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    known = documents.select(F.col("doc_id").cast("long"), F.lit(1).alias("there")).distinct().join(known, "doc_id")
    chosen = written(known.select("doc_id", "y").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most), "examples")
    # at most ``most`` ids
    texts = documents.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return written(texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")), "examples")


def train(documents: DataFrame, labels: DataFrame, label: str = "toxic", most: int = EXAMPLES) -> Model:
    examples = examples_of(documents, labels, label, most)

    def occurring(batches):
        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
                own = list({t for w in set(words(text)) for t in terms(w)})
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), pa.array([y] * len(own), pa.int32())], names=["term", "y"])

    sizes = {r.y: r.n for r in examples.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sum(n for y, n in sizes.items() if y != 1)
    per_term = examples.select("y", "text").mapInArrow(tidy(occurring), "term binary, y int").groupBy("term")
    per_term = written(per_term.agg(F.sum(F.when(F.col("y") == 1, 1).otherwise(0)).alias("a"), F.sum(F.when(F.col("y") == 1, 0).otherwise(1)).alias("b")), "terms")
    vocabulary: dict[bytes, int] = {}
    if n1 and n0:
        tested = per_term.where("a + b >= 2").count()
        g = sum(F.when((o > 0) & (e > 0), 2 * o * F.log(o / e)).otherwise(0.0) for o, e in g_cells(F.col("a"), F.col("b"), n1, n0))
        best = per_term.where("a + b >= 2").select("term", g.alias("g")).orderBy(F.col("g").desc(), "term").limit(MOST_TERMS).collect()
        least = 2 * math.log(max(tested, 1))  # about one term by chance
        vocabulary = {bytes(r.term): k for k, r in enumerate(best) if r.g >= least or k < LEAST_TERMS}
    model = Model([], np.zeros(0), vocabulary, np.ones(len(vocabulary)), BlockMaxIndex([], len(vocabulary) + 1), 0.0, 0.0)

    def counted(batches):
        for batch in batches:
            own = [model.count(t) for t in text_bytes(batch.column(2))]
            kinds = [pa.array([list(c) for c in own], pa.list_(pa.int32())), pa.array([list(c.values()) for c in own], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *kinds], names=["doc_id", "y", "t", "n"])

    # at most ``most`` rows of at most MOST_TERMS terms; alike examples side by side make block bounds tight
    rows = examples.select("doc_id", "y", "text").mapInArrow(tidy(counted), "doc_id long, y int, t array<int>, n array<int>").collect()
    counts = [dict(zip(r.t, r.n)) for r in rows]
    seen = np.zeros(len(vocabulary))
    for c in counts:
        seen[[t for t in c if t >= 0]] += 1
    model.idf = np.log((1 + len(rows)) / (1 + seen)) + 1
    order = sorted(range(len(rows)), key=lambda k: (sorted((t for t in counts[k] if t >= 0), key=lambda t: -counts[k][t])[:3], rows[k].doc_id))
    model.ids, counts = [rows[k].doc_id for k in order], [counts[k] for k in order]
    model.labels = np.array([int(rows[k].y == 1) for k in order])
    model.index = BlockMaxIndex([model.vector(c) for c in counts], len(vocabulary) + 1)
    model.base_rate = (n1 + 0.0) / max(n1 + n0, 1)
    has_term = [any(t >= 0 for t in c) for c in counts]
    without = [int(y) for h, y in zip(has_term, model.labels) if not h]
    model.empty_rate = (sum(without) + model.base_rate) / (len(without) + 1)
    votes = [(model.vote(c, k)[0], y) for k, (c, y) in enumerate(zip(counts, model.labels)) if has_term[k]]
    votes = [(v, y) for v, y in votes if v is not None]
    model.slope, model.shift = calibrated([v for v, _ in votes], [int(y) for _, y in votes])
    return model


def g_cells(a: Column, b: Column, n1: int, n0: int):
    n = n1 + n0
    return ((a, (a + b) * n1 / n), (b, (a + b) * n0 / n), (n1 - a, (n - a - b) * n1 / n), (n0 - b, (n - a - b) * n0 / n))


def scorer(model: Model):
    """Column function from a text to (score, evidence): the nearest examples with cosine and label."""

    def run(texts: pa.Array) -> pa.Array:
        forget()
        scores, evidence = [], []
        for text in text_bytes(texts):
            score, found = model.score(model.count(text))
            scores.append(score)
            evidence.append([f"{model.ids[e]}:{s:.4f}:{model.labels[e]}" for s, e in found[:3]])
        return pa.StructArray.from_arrays([pa.array(scores, pa.float64()), pa.array(evidence, pa.list_(pa.string()))], names=["score", "evidence"])

    return F.arrow_udf(run, "score double, evidence array<string>")


def score_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and evidence of every document."""
    score = scorer(train(documents, labels))
    scored = documents.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), score("text").alias("s"))
    return scored.select("doc_id", "held_out", "s.score", (F.col("s.score") >= 0.5).cast("int").alias("predicted"), "s.evidence")


def drop_toxic(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``documents`` without those predicted toxic, all columns kept."""
    score = scorer(train(documents, labels))
    return documents.withColumn("_s", score("text")).where("_s.score < 0.5").drop("_s")
