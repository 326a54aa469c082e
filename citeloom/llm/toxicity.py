"""Toxicity: cumulative-link ordinal regression on sparse word features.

P(grade <= g) = logistic(cut[g] - weights . x) with one weight per word, shared by all cuts, and cuts in
ascending order. The expected severity is the sum over grades of P(grade >= g). Grades of labelled
documents: 0 is not toxic; toxic ones are graded 1 to GRADES by how many distinct words they hold that
are tied to the label, in equal parts. Features: which words (runs of letters, A-Z lowered) occur, from
all words in at least LEAST_DOCS documents of the sample, looked up by 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm import flat
from citeloom.llm.frames import slices, utf8, with_columns
from citeloom.llm.quality import held_out

GRADES = 3
#: Labelled documents fitted on at most, the ones of smallest hash. They bound the vocabulary as well.
SAMPLE = 10_000
LEAST_DOCS = 5

_APART = np.ones(256, bool)
_APART[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1), *range(128, 256)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words of each text as hashes, all texts one after another, and the text of each."""
    data = _LOWER[data]
    first, last, before = flat.places(data, offsets, _APART)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(before))
    word = flat.hashes(data, first, last) if len(data) else np.zeros(0, np.uint64)
    order = np.lexsort((word, doc))
    word, doc = word[order], doc[order]
    new = np.concatenate([[True], (word[1:] != word[:-1]) | (doc[1:] != doc[:-1])])[: len(word)]
    return word[new], doc[new]


def _looked_up(vocabulary: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each word in the vocabulary, and whether it is there."""
    at = np.searchsorted(vocabulary, word)
    at[at == len(vocabulary)] = 0
    return at, vocabulary[at] == word if len(vocabulary) else np.zeros(len(word), bool)


@dataclass
class Model:
    vocabulary: np.ndarray  # hashes, ascending
    weights: np.ndarray
    cuts: np.ndarray  # ascending, one between each two grades

    def latent(self, word: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        at, known = _looked_up(self.vocabulary, word)
        return np.bincount(doc[known], weights=self.weights[at[known]], minlength=n)

    def above(self, latent: np.ndarray) -> np.ndarray:
        """P(grade >= g) for g = 1 .. GRADES, one row per text."""
        return 1.0 / (1.0 + np.exp(np.clip(self.cuts[None, :] - latent[:, None], -50, 50)))


def graded(word: np.ndarray, doc: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Grades of labelled texts (see above)."""
    keys, at = np.unique(word, return_inverse=True)
    bad = np.bincount(at, weights=toxic[doc], minlength=len(keys))
    good = np.bincount(at, minlength=len(keys)) - bad
    odds = np.log((bad + 0.5) / (toxic.sum() + 1)) - np.log((good + 0.5) / ((1 - toxic).sum() + 1))
    tied = (odds > 2) & (bad >= LEAST_DOCS)
    held = np.bincount(doc, weights=tied[at], minlength=len(toxic))
    marks = np.quantile(held[toxic > 0], np.arange(1, GRADES) / GRADES) if toxic.any() else np.zeros(GRADES - 1)
    return np.where(toxic > 0, 1 + (held[:, None] > marks[None, :]).sum(axis=1), 0)


def fit(word: np.ndarray, doc: np.ndarray, toxic: np.ndarray, rounds: int = 400, rate: float = 0.05, ridge: float = 1e-3) -> Model:
    """Maximum likelihood with a ridge, by Adam steps on all rows. Without both labels all weights are 0."""
    n = len(toxic)
    if n == 0 or toxic.min() == toxic.max():
        share = (toxic.sum() + 0.5) / (n + 1.0)
        return Model(np.zeros(0, np.uint64), np.zeros(0), -np.log(share / (1 - share)) + np.arange(GRADES))
    grade = graded(word, doc, toxic)
    keys, count = np.unique(word, return_counts=True)
    vocabulary = keys[count >= LEAST_DOCS]
    at, known = _looked_up(vocabulary, word)
    at, doc = at[known], doc[known]
    weights = np.zeros(len(vocabulary))
    share = np.array([(grade >= g).mean() for g in range(1, GRADES + 1)])
    share = np.clip(share, 1e-4, 1 - 1e-4)
    # The first cut and the logarithms of the steps between cuts, so that cuts stay in order.
    cuts = np.log((1 - share) / share)
    free = np.concatenate([cuts[:1], np.log(np.maximum(np.diff(cuts), 0.05))])
    moment = [np.zeros(len(weights) + GRADES), np.zeros(len(weights) + GRADES)]
    for step in range(1, rounds + 1):
        cuts = np.cumsum(np.concatenate([free[:1], np.exp(free[1:])]))
        latent = np.bincount(doc, weights=weights[at], minlength=n)
        below = np.concatenate([np.zeros((n, 1)), 1 / (1 + np.exp(np.clip(latent[:, None] - cuts[None, :], -50, 50))), np.ones((n, 1))], axis=1)
        row = np.arange(n)
        low, high = below[row, grade], below[row, grade + 1]
        p = np.maximum(high - low, 1e-12)
        d_high, d_low = high * (1 - high) / p, low * (1 - low) / p
        d_latent = (d_high - d_low) / n
        d_cuts = np.zeros(GRADES)
        np.add.at(d_cuts, np.minimum(grade, GRADES - 1), np.where(grade < GRADES, -d_high, 0) / n)
        np.add.at(d_cuts, np.maximum(grade - 1, 0), np.where(grade > 0, d_low, 0) / n)
        tail = d_cuts[::-1].cumsum()[::-1]
        slope = np.concatenate([np.bincount(at, weights=d_latent[doc], minlength=len(weights)) + ridge * weights, tail[:1], tail[1:] * np.exp(free[1:])])
        moment[0] = 0.9 * moment[0] + 0.1 * slope
        moment[1] = 0.99 * moment[1] + 0.01 * slope**2
        move = rate * (moment[0] / (1 - 0.9**step)) / (np.sqrt(moment[1] / (1 - 0.99**step)) + 1e-8)
        weights, free = weights - move[: len(weights)], free - move[len(weights) :]
    return Model(vocabulary, weights, np.cumsum(np.concatenate([free[:1], np.exp(free[1:])])))


def learned(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled documents that are not held out, the ones of smallest hash.

    Their distinct words come to the driver as hashes, about 3 kB a document.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select(
        F.col("doc_id").alias("label_id"), "toxic"
    )
    chosen = known.orderBy(F.xxhash64("label_id"), "label_id", "toxic").limit(sample)
    rows = docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).select("label_id", "toxic", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            word, doc = words_of(*utf8(part.column("text")))
            ends = np.searchsorted(doc, np.arange(part.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(word.view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("label_id"), part.column("toxic"), lists], names=["label_id", "toxic", "words"])

    kind = rows.schema["label_id"].dataType.simpleString(), rows.schema["toxic"].dataType.simpleString()
    found = rows.mapInArrow(run, f"label_id {kind[0]}, toxic {kind[1]}, words array<bigint>")
    # Documents may repeat an id: the bound holds for rows, chosen by a hash of what they are.
    found = found.orderBy(F.xxhash64("label_id", "words"), "label_id", "toxic").limit(sample).toArrow()
    lists = found.column("words").combine_chunks()
    counts = lists.value_lengths().to_numpy(zero_copy_only=False)
    word = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    return fit(word, np.repeat(np.arange(len(counts)), counts), found.column("toxic").to_numpy().astype(np.float64))


def graded_texts(docs: DataFrame, model: Broadcast, *keep: str) -> DataFrame:
    """``keep`` columns, ``score`` (P of any toxicity), ``severity`` (expected grade) and ``grade`` (likeliest)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text"):
            above = model.value.above(model.value.latent(*words_of(*utf8(part.column("_text"))), part.num_rows))
            edge = np.concatenate([np.ones((len(above), 1)), above, np.zeros((len(above), 1))], axis=1)
            likeliest = (edge[:, :-1] - edge[:, 1:]).argmax(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*(part.column(k) for k in keep), pa.array(above[:, 0]), pa.array(above.sum(axis=1)), pa.array(likeliest, pa.int32())],
                names=[*keep, "score", "severity", "grade"],
            )

    wanted = docs.select(*keep, F.col("text").alias("_text"))
    return wanted.mapInArrow(run, with_columns(wanted.schema, "_text", "score double, severity double, grade int"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text; labels doc_id, toxic -> doc_id, score, severity, grade, predicted, one row per input row.

    predicted is 1 if the score is 0.5 or more. Empty and null texts have no words and score by the cuts
    alone. Without labels of both kinds every text scores the same. Other columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(learned(docs, labels))
    return graded_texts(docs, model, "doc_id").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
