"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmart.llm.common import durable, held_out, label_sample

#: Weights; the most labelled rows that are learned from; passes over them; rows that a feature must occur in.
WIDTH, SAMPLE_ROWS, PASSES, LEAST_ROWS = 1 << 22, 16_384, 12, 2
#: The weight of an example of the rarer label 1: how many examples of label 0 there are for it, to this power.
RARE_POWER = 0.8
#: FTRL-proximal: learning rate, its damping, L2, and L1 for each thousand examples (one at least).
ALPHA, BETA, L2, L1_PER_THOUSAND = 4.0, 1.0, 1.0, 5.0
#: Features that are passed on at a time.
PART = 4096
_WORD = re.compile(r"[^\W\d_]+")
_M = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """64-bit hash of a word; emptied when it has a million words."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 1_000_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_hashes = _Hashes()


def features(text: str) -> np.ndarray:
    """Distinct weight indices of the words, the pairs of neighbours and the pairs with one word between them."""
    words = _WORD.findall(text.lower())
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    grams = [h * _M]
    for gap in (1, 2):
        if len(h) > gap:
            grams.append((h[:-gap] * _M + h[gap:] + np.uint64(gap)) * _M)
    return np.unique(np.concatenate(grams) >> np.uint64(64 - 22)).astype(np.int64)


def _weights(z: np.ndarray, n: np.ndarray, l1: float) -> np.ndarray:
    return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


class Learner:
    """FTRL-proximal over examples that come one at a time: once to be counted, then PASSES times to be learned.

    It holds three numbers for each of WIDTH features and one example, however many examples there are.
    """

    def __init__(self) -> None:
        self.rows, self.examples, self.ones = np.zeros(WIDTH, np.int32), 0, 0
        self.z, self.n = np.zeros(WIDTH + 1), np.zeros(WIDTH + 1)
        self.l1 = self.weight = 1.0

    def count(self, x: np.ndarray, y: int) -> None:
        self.rows[x] += 1
        self.examples += 1
        self.ones += y
        self.l1 = max(1.0, L1_PER_THOUSAND * self.examples / 1000)
        self.weight = max(1.0, ((self.examples - self.ones) / self.ones) ** RARE_POWER) if self.ones else 1.0

    def learn(self, x: np.ndarray, y: int) -> None:
        i = np.append(x[self.rows[x] >= min(LEAST_ROWS, self.examples)].astype(np.int32), np.int32(WIDTH))
        w = _weights(self.z[i], self.n[i], self.l1)
        g = (1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - y) * (self.weight if y else 1.0)
        rate = (np.sqrt(self.n[i] + g * g) - np.sqrt(self.n[i])) / ALPHA
        self.z[i] += g - rate * w
        self.n[i] += g * g

    def weights(self) -> tuple[np.ndarray, np.ndarray]:
        """(indices, weights) that are not zero; index WIDTH is the bias."""
        used = np.nonzero(np.abs(self.z) > self.l1)[0]
        return used, _weights(self.z[used], self.n[used], self.l1)


def learn(examples: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Weights after PASSES over the examples.

    Features of fewer than LEAST_ROWS examples are left out, so names and slips are not learned by heart. Examples of
    the rarer label 1 weigh more, so that few of them are missed at a score of one half.
    """
    learner = Learner()
    for x, y in examples:
        learner.count(x, y)
    for _ in range(PASSES):
        for x, y in examples:
            learner.learn(x, y)
    return learner.weights()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features of each text, in parts of PART at most, so that no batch of rows grows with the texts' lengths."""
    for batch in batches:
        for at, row, y, text in zip(*(batch[c].to_pylist() for c in ("at", "row", "y", "text")), strict=True):
            found = features(text).astype("<i4")
            parts = [found[k : k + PART].tobytes() for k in range(0, max(len(found), 1), PART)]
            same = lambda v, kind: pa.array([v] * len(parts), kind)  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([same(at, pa.int64()), same(row, pa.int64()), pa.array(range(len(parts)), pa.int32()), same(y, pa.int32()), pa.array(parts, pa.binary())], names=["at", "row", "part", "y", "x"])


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, int]]:
    """(turn, features, label) of one example after another, put together from its parts."""
    key, parts, label = None, [], 0
    for batch in batches:
        columns = [batch[c].to_pylist() for c in ("turn", "at", "row", "y")]
        for k, (turn, at, row, y) in enumerate(zip(*columns, strict=True)):
            if key is not None and (turn, at, row) != key:
                yield key[0], np.concatenate(parts), label
                parts = []
            key, label = (turn, at, row), y
            parts.append(np.frombuffer(batch["x"][k].as_py(), "<i4"))
    if key is not None:
        yield key[0], np.concatenate(parts), label


def _learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    learner = Learner()
    for turn, x, y in _examples(batches):
        (learner.learn if turn else learner.count)(x, y)
    i, w = learner.weights()
    yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(w, pa.float64())], names=["i", "w"])


def fit_toxicity(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Sparse weights: features are hashed where the texts are, one task learns.

    The sample has at most ``sample_rows`` labelled rows of any length. Their features are sorted once, outside of
    memory, and written; the learner reads them from there again for every pass, one example at a time. L1 leaves few
    weights, at most WIDTH + 1 in any case, and these alone reach the driver.
    """
    sample = label_sample(documents, labels, "toxic", sample_rows, 5, 0)
    inputs = sample.select("text", "y", F.xxhash64(F.lit(5), "doc_id").alias("at"), F.monotonically_increasing_id().alias("row"))
    hashed = inputs.mapInArrow(_hashed, "at long, row long, part int, y int, x binary")
    ordered = durable(hashed.repartition(1).sortWithinPartitions("at", "row", "part"))
    # the one partition again and again, in this order, through one task
    turns = reduce(DataFrame.union, [ordered.select(F.lit(turn).alias("turn"), "at", "row", "y", "x") for turn in range(PASSES + 1)])
    table = turns.coalesce(1).mapInArrow(_learned, "i long, w double").toArrow()
    return table["i"].to_numpy(), table["w"].to_numpy()


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, weight = shared.value
        dense = np.zeros(WIDTH + 1, np.float32)
        dense[index] = weight
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                sums = np.array([dense[features(t)].sum(dtype=np.float64) + dense[WIDTH] for t in batch["text"].to_pylist()])
                score = 1.0 / (1.0 + np.exp(-np.clip(sums, -35, 35)))
                yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return run


def score_toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every whole text.

    Rows with crc32(doc_id) mod 5 equal to 0 are never learned from. Null and empty texts have no feature and get the
    score of the bias; without labels every score is 0.5. Several labels of an id count as the largest; equal texts
    get equal scores. An empty table gives no rows; columns other than doc_id and text (and toxic) are ignored.
    """
    weights = fit_toxicity(documents, labels)
    shared = documents.sparkSession.sparkContext.broadcast(weights)  # sparse, at most WIDTH + 1
    inputs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), held_out(F.col("doc_id"), 5, 0).alias("held_out"))
    return inputs.mapInArrow(_scored(shared), "doc_id long, held_out boolean, score double, predicted int")
