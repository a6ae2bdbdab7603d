"""A quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader.

Tokens are runs of letters and digits, or of other visible characters; features are single tokens and pairs (a token
repeated at once is one feature of its own), hashed to a fixed table. The value of a feature is the logarithm of one
plus its count, over the norm of the document. Scoring is a sparse dot product with a weight table of fixed size,
added to the log odds of a good document among those learnt from, so a text says nothing until its features do.

Training takes a bounded sample of the labelled rows (``TRAIN_ROWS``, by a hash of the id). The sample is dealt in shares
of about ``SHARE_ROWS``, one for a small sample. In each of a few rounds every share goes on from the mean state of the
leaders of the round before. Passes are as many as make about ``UPDATES`` updates, within bounds, so that few labelled
rows move the weights as far as many.

Defined results: null and empty texts have no features and score the share of good documents. A document with several labels
counts as good if their mean is at least one half; null labels are ignored. Without labels every score is 0.5 and
nothing is rejected. Rows are never merged, other columns stay, columns named like results are replaced.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tertulia.llm.common import slices
from tertulia.llm.vocabulary import Memo
from tertulia.sources.staging import settle

#: Size of the feature table.
BITS = 18
#: About so many labelled rows are learnt from, at most; fewer if there are fewer.
TRAIN_ROWS = 16_000
SHARE_ROWS, ROUNDS = 2000, 4
UPDATES, LEAST_PASSES, MOST_PASSES = 64_000, 4, 24
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.02, 0.0
#: Added to a document's squared norm, so that a few unknown words do not outweigh the prior.
EASE = 12.0
#: Score from which a document counts as good.
ACCEPTED = 0.7
_TOKEN = re.compile(r"\w+|[^\w\s]+")
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_SHIFT = np.uint64(64 - BITS)
SAME = 0  # a feature of its own


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


_codes = Memo(lambda token: zlib.crc32(token.encode()))


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted feature numbers of a text and their values."""
    tokens = _TOKEN.findall(text or "")
    own = np.fromiter(map(_codes.__getitem__, tokens), np.uint64, len(tokens))
    single = own * _A >> _SHIFT
    pairs = np.where(own[:-1] == own[1:], np.uint64(SAME), (own[:-1] * _A + own[1:] * _B) * _A >> _SHIFT)
    found, counts = np.unique(np.concatenate((single, pairs)), return_counts=True)
    values = np.log1p(counts)
    values = values / np.sqrt(values @ values + EASE)
    return found.astype(np.int64), values


def probability(margin):
    return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


class Leader:
    """State of follow-the-regularised-leader with per-feature rates."""

    def __init__(self, size: int = 1 << BITS):
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at=slice(None)) -> np.ndarray:
        z = self.z[at]
        shrunk = np.sign(z) * L1 - z
        return np.where(np.abs(z) <= L1, 0.0, shrunk / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2))

    def learn(self, at: np.ndarray, values: np.ndarray, label: float, prior: float) -> None:
        weights = self.weights(at)
        gradient = (probability(prior + weights @ values) - label) * values
        squares = self.n[at]
        rate = (np.sqrt(squares + gradient**2) - np.sqrt(squares)) / ALPHA
        self.z[at] += gradient - rate * weights  # the numbers of a text are distinct
        self.n[at] += gradient**2


def _training(prior: float, passes: int, number: int, state) -> Callable:
    """Work of one round on a share of the sample, in an order that only depends on its rows and the round; ``state`` is a
    broadcast of the mean state of the round before, or of None."""

    def work(rows: pa.Table) -> pa.Table:
        share = rows["share"][0].as_py()
        rows = rows.sort_by([("order", "ascending"), ("text", "ascending")])
        examples = []
        for batch in rows.select(["text", "label"]).to_batches(max_chunksize=256):  # few texts are Python objects at once
            texts, known = (column.to_pylist() for column in batch.columns)
            examples += [(*features(t), y) for t, y in zip(texts, known, strict=True)]
        leader, order = Leader(), np.random.RandomState(number)
        if state.value is not None:
            leader.z, leader.n = (x.astype(np.float64) for x in state.value)
        for _ in range(passes):
            for i in order.permutation(len(examples)):
                leader.learn(*examples[i], prior)
        after = {name: [x.astype("<f4").tobytes()] for name, x in (("z", leader.z), ("n", leader.n))}
        return pa.table({"share": pa.array([share], pa.int32()), **after})

    return work


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # 2**BITS numbers
    prior: float  # log odds

    def score(self, text: str | None) -> float:
        at, values = features(text)
        return float(probability(self.prior + self.weights[at] @ values))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Learns from ``labels`` (doc_id, quality) of documents that are not held out."""
    known = labels.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.avg("quality").alias("mean"))
    known = known.filter("mean is not null")
    share = min(1.0, rows / max(1, known.count()))
    order = F.xxhash64("doc_id")
    sample = known.filter(F.pmod(order, F.lit(1 << 30)) < int(share * (1 << 30))).select(
        "doc_id", (F.col("mean") >= 0.5).cast("double").alias("label"), order.alias("order")
    )
    joined = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # about ``rows`` rows of three numbers
    count, good = sample.agg(F.count("*"), F.sum("label")).first()
    prior = math.log(((good or 0) + 1) / (count - (good or 0) + 1))
    tasks = max(1, math.ceil(count / SHARE_ROWS))  # at most about rows / SHARE_ROWS
    share = F.pmod(F.shiftright("order", 32), F.lit(tasks)).cast("int").alias("share")
    shares = settle(joined.select("text", "label", "order", share))
    rounds = ROUNDS if tasks > 1 else 1
    passes = min(MOST_PASSES, max(LEAST_PASSES, round(UPDATES / max(1, count))))
    leader = Leader()
    state = None
    for number in range(rounds):
        sent = docs.sparkSession.sparkContext.broadcast(state)
        work = _training(prior, max(1, round(passes / rounds)), number, sent)
        learnt = shares.groupBy("share").applyInArrow(work, "share int, z binary, n binary").collect()  # one row a share
        if not learnt:
            return Model(np.zeros(1 << BITS, np.float32), 0.0)
        learnt.sort(key=lambda row: row["share"])
        leader.z, leader.n = (
            np.stack([np.frombuffer(row[name], "<f4") for row in learnt]).mean(axis=0, dtype=np.float64) for name in ("z", "n")
        )
        state = tuple(x.astype("<f4") for x in (leader.z, leader.n))
    return Model(leader.weights().astype(np.float32), prior)


def with_score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the probability that a text is good."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        for batch in slices(batches):
            yield pa.array([own.score(t) for t in batch.to_pylist()], pa.float64())

    return docs.withColumn(name, score(F.col(text)))


def predicted(score: Column, model: Model) -> Column:
    """1 if a score is accepted; a model that has learnt nothing rejects nothing."""
    return F.when((score >= ACCEPTED) | F.lit(not model.weights.any()), 1).otherwise(0)
