"""Quality classifier: histogram gradient-boosted trees over document statistics.

Each document is reduced to FEATURES statistics of its whole text in one pass (flat numpy arrays). The
trees are fitted on a bounded sample of the labelled statistics: binned features, gradient histograms
per node, depth-wise growth. Scoring walks all trees at once for a batch of rows: a tree is a complete
binary tree in arrays (feature, threshold, leaf value), so a step is one gather and one comparison.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.llm import flat
from citeloom.llm.frames import slices, utf8, with_columns
from citeloom.sources.scratch import staged

FEATURES = (
    "bytes",
    "words",
    "lines",
    "mean_word",
    "mean_line_words",
    "letters",
    "upper",
    "digits",
    "marks",
    "line_feeds",
    "beyond_ascii",
    "sentence_ends",
    "pipes",
    "symbols",
    "distinct_words",
    "distinct_pairs",
    "distinct_lines",
    "most_frequent_word",
    "repeats_before",
    "longest_word",
    "short_words",
    "marked_word_ends",
)
#: A document is held out from learning if the CRC-32 of its id as text has this remainder.
FOLDS = 5
#: Labelled documents that the trees are fitted on at most, the ones of smallest hash.
SAMPLE = 20_000
THRESHOLD = 0.3


@dataclass(frozen=True)
class Settings:
    trees: int = 80
    depth: int = 4
    bins: int = 64
    rate: float = 0.15
    least: float = 5.0  # hessian that a side of a split needs
    ridge: float = 1.0


def _class_of_bytes() -> np.ndarray:
    """One bit for each class of byte that is counted."""
    out = np.zeros(256, np.uint8)
    for c in range(256):
        x = chr(c)
        bits = [c < 128 and x.isalpha(), c < 128 and x.isupper(), c < 128 and x.isdigit(), c < 128 and c > 32 and not x.isalnum() and c != 127]
        bits += [c == 10, c >= 128, x in ".!?", x == "|"]
        out[c] = sum(1 << i for i, b in enumerate(bits) if b)
    return out


_CLASS = _class_of_bytes()
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#$%&*+<=>@[\\]^_`{}~"]] = True
_LINE = np.zeros(256, bool)
_LINE[[10, 13]] = True


def _per_text(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return np.diff(sums[cuts]).astype(np.float64)


def _distinct(keys: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text the number of distinct keys and the largest count of one."""
    if not len(keys):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((keys, doc))
    keys, doc = keys[order], doc[order]
    begin = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])]))
    count = np.diff(np.append(begin, len(keys)))
    most = np.zeros(n)
    np.maximum.at(most, doc[begin], count)
    return np.bincount(doc[begin], minlength=n).astype(np.float64), most


def statistics_of(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES per text (UTF-8 bytes and offsets); shares of an empty text are 0."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(np.float64)
    kinds = _CLASS[data]
    shares = [_per_text(kinds >> b & 1, offsets) for b in range(8)]
    first, last, before = flat.places(data, offsets)
    words = np.diff(before).astype(np.float64)
    doc = np.repeat(np.arange(n), np.diff(before))
    word = flat.hashes(data, first, last) if len(data) else np.zeros(0, np.uint64)
    width = (last - first).astype(np.float64)
    begin, end, lines_before = flat.places(data, offsets, _LINE)
    lines = np.diff(lines_before).astype(np.float64)
    line = flat.hashes(data, begin, end) if len(data) else np.zeros(0, np.uint64)
    same = doc[1:] == doc[:-1]
    pair = flat.runs(word, 2)[same] if len(word) > 1 else word[:0]
    unlike, most = _distinct(word, doc, n)
    pairs, _ = _distinct(pair, doc[1:][same], n)
    unlike_lines, _ = _distinct(line, np.repeat(np.arange(n), np.diff(lines_before)), n)
    again = np.bincount(doc[1:][same & (word[1:] == word[:-1])], minlength=n) if len(word) > 1 else np.zeros(n)
    longest = np.zeros(n)
    np.maximum.at(longest, doc, width)

    def share(value: np.ndarray, of: np.ndarray) -> np.ndarray:
        return np.divide(value, of, out=np.zeros(n), where=of > 0)

    columns = [
        np.log1p(size),
        np.log1p(words),
        np.log1p(lines),
        share(_per_text(width.astype(np.int64), before), words),
        share(words, lines),
        *(share(s, size) for s in shares),
        share(_per_text(_SYMBOL[data], offsets), size),
        share(unlike, words),
        share(pairs, np.maximum(words - 1, 0)),
        share(unlike_lines, lines),
        share(most, words),
        share(again.astype(np.float64), words),
        np.log1p(longest),
        share(_per_text(width <= 2, before), words),
        share(_per_text(_SYMBOL[data[last - 1]], before) if len(last) else np.zeros(n), words),
    ]
    return np.stack(columns, axis=1)


def statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns and ``features`` (array<float>, see FEATURES) of ``text``; null is empty. One pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text"):
            rows = statistics_of(*utf8(part.column("_text"))).astype(np.float32)
            offsets = pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.array(rows.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), lists], names=[*keep, "features"])

    wanted = docs.select(*keep, F.col("text").alias("_text"))
    return wanted.mapInArrow(run, with_columns(wanted.schema, "_text", "features array<float>"))


@dataclass
class Trees:
    """Complete binary trees of one depth in arrays: node i has children 2i+1 and 2i+2."""

    base: float
    feature: np.ndarray  # (trees, inner nodes)
    threshold: np.ndarray  # a row goes right if its value is above
    leaf: np.ndarray  # (trees, leaves)

    def raw(self, rows: np.ndarray) -> np.ndarray:
        """Sum of the leaves that each row reaches: all trees step down together."""
        trees = np.arange(len(self.feature))[None, :]
        at = np.zeros((len(rows), len(self.feature)), np.int64)
        line = np.arange(len(rows))[:, None]
        inner = self.feature.shape[1]
        for _ in range((inner + 1).bit_length() - 1):
            right = rows[line, self.feature[trees, at]] > self.threshold[trees, at]
            at = 2 * at + 1 + right
        return self.base + self.leaf[trees, at - inner].sum(axis=1)

    def score(self, rows: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.raw(rows)))


def fit(rows: np.ndarray, labels: np.ndarray, settings: Settings = Settings()) -> Trees:
    """Boost on the logistic loss. One label only, or no row at all, gives that label's rate for all."""
    rows = rows.astype(np.float32)
    n, width = rows.shape
    inner, leaves = (1 << settings.depth) - 1, 1 << settings.depth
    rate = (labels.sum() + 0.5) / (n + 1.0)
    base = float(np.log(rate / (1 - rate)))
    feature = np.zeros((settings.trees, inner), np.int64)
    threshold = np.full((settings.trees, inner), np.inf, np.float32)
    leaf = np.zeros((settings.trees, leaves))
    out = Trees(base, feature, threshold, leaf)
    if n == 0 or labels.min() == labels.max():
        return out
    edges = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, settings.bins + 1)[1:-1], method="lower")) for f in range(width)]
    binned = np.stack([np.searchsorted(e, rows[:, f], "left") for f, e in enumerate(edges)], axis=1)  # a row is in bin b if value <= edge b
    raw = np.full(n, base)
    flat_bin = binned + np.arange(width)[None, :] * settings.bins
    for tree in range(settings.trees):
        p = 1.0 / (1.0 + np.exp(-raw))
        gradient, hessian = p - labels, p * (1 - p)
        node = np.zeros(n, np.int64)
        for depth in range(settings.depth):
            start, count = (1 << depth) - 1, 1 << depth
            slot = ((node - start)[:, None] * (width * settings.bins) + flat_bin).ravel()
            shape = (count, width, settings.bins)
            g = np.bincount(slot, weights=np.repeat(gradient, width), minlength=np.prod(shape)).reshape(shape).cumsum(axis=2)
            h = np.bincount(slot, weights=np.repeat(hessian, width), minlength=np.prod(shape)).reshape(shape).cumsum(axis=2)
            all_g, all_h = g[:, :1, -1:], h[:, :1, -1:]
            gain = g * g / (h + settings.ridge) + (all_g - g) ** 2 / (all_h - h + settings.ridge) - all_g**2 / (all_h + settings.ridge)
            gain[(h < settings.least) | (all_h - h < settings.least)] = 0
            for f, e in enumerate(edges):
                gain[:, f, len(e) :] = 0
            best = gain.reshape(count, -1).argmax(axis=1)
            for i, b in enumerate(best.tolist()):
                f, cut = divmod(b, settings.bins)
                if gain[i, f, cut] > 1e-9:
                    feature[tree, start + i], threshold[tree, start + i] = f, edges[f][cut]
            f = feature[tree, node]
            node = 2 * node + 1 + (rows[np.arange(n), f] > threshold[tree, node])
        place = node - inner
        g, h = (np.bincount(place, weights=x, minlength=leaves) for x in (gradient, hessian))
        leaf[tree] = -settings.rate * g / (h + settings.ridge)
        raw += leaf[tree, place]
    return out


def held_out(doc_id: Column) -> Column:
    """Whether a document is never learned from; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def learned(found: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Trees:
    """Fit on the statistics of labelled documents that are not held out, at most ``sample`` of them.

    ``sample`` rows of FEATURES numbers come to the driver, the ones of smallest hash of the id (20,000
    rows are 2 MB). Labels that are null or for ids that are null are left out; of an id with several
    labels each counts.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select(
        F.col("doc_id").alias("label_id"), F.col(label).alias("label")
    )
    chosen = known.orderBy(F.xxhash64("label_id"), "label_id", "label").limit(sample)
    rows = found.join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).select("doc_id", "label", "features")
    rows = rows.orderBy("doc_id", "label", "features").limit(sample).toArrow()
    x = rows.column("features").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
    return fit(x, rows.column("label").to_numpy().astype(np.float64))


def scored(found: DataFrame, trees: Broadcast, *keep: str) -> DataFrame:
    """``keep`` columns and ``score`` (0 to 1) of rows with ``features``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            x = part.column("features").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            score = trees.value.score(x)
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), pa.array(score)], names=[*keep, "score"])

    wanted = found.select(*keep, "features")
    return wanted.mapInArrow(run, with_columns(wanted.schema, "features", "score double"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text; labels doc_id, quality -> doc_id, held_out, score, predicted, one row per input row.

    Whole texts are scored, empty and null ones too. Without usable labels every score is 0.5. Inputs
    of a score are statistics of the text alone. Other columns are ignored.
    """
    found = staged(statistics(docs, "doc_id"), "statistics")
    trees = docs.sparkSession.sparkContext.broadcast(learned(found, labels))
    rows = scored(found, trees, "doc_id")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier takes, all columns unchanged; two passes, no shuffle of text."""
    found = staged(statistics(docs, "doc_id"), "statistics")
    trees = docs.sparkSession.sparkContext.broadcast(learned(found, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            rows = statistics_of(*utf8(part.column("text"))).astype(np.float32)
            yield part.filter(pa.array(trees.value.score(rows) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
