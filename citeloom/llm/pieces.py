"""SentencePiece encoding and decoding: BPE merge rounds over flat numpy arrays.

The merges are this module's own; of a model file only the list of pieces, scores and types is read.
Text is cut where no piece can reach across (before a run of spaces, around a line feed), and each
distinct cut-out word is encoded once per task. In a round every unfinished word finds the smallest
rank among its pairs, merges it wherever it stands (from the left, without overlap), and the arrays
are compacted; it ends when no pair of any word is a piece. A rank is the place of the merged piece
in order of score, equal scores sharing one. Merging all places at once equals the library's one at
a time unless the merged piece begins or ends a piece of the same or a better rank: of such a piece
only the first place is merged in a round. Words of over LONG symbols are merged one pair at a time
from a heap, which gives the same and does not need a round per merge.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm.frames import slices, unused, with_columns

SPACE = "▁"
#: Symbols of a word from which on the heap merges it; distinct words that a task remembers.
LONG = 512
KNOWN_WORDS = 600_000
_NONE = np.int32(2**31 - 1)
_FREE = np.uint64(2**64 - 1)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_WORD = re.compile(f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+")


@dataclass
class Vocabulary:
    """Pieces of a model by id: text, score, and kind ("normal", "byte" or "control")."""

    texts: list[str]
    scores: list[float]
    kinds: list[str]

    @cached_property
    def tables(self) -> Tables:
        return Tables(self)


def read_model(path: str) -> Vocabulary:
    """The pieces of a BPE model with byte fallback, a dummy prefix and no other normalisation."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())

    def kind(i: int) -> str:
        return "byte" if model.is_byte(i) else "control" if model.is_control(i) or model.is_unknown(i) else "normal"

    return Vocabulary([model.id_to_piece(i) for i in ids], [model.get_score(i) for i in ids], [kind(i) for i in ids])


class Tables:
    """Lookup arrays made from a vocabulary.

    Symbols are numbered like pieces; characters that only occur inside pieces follow; a character in
    no piece is symbol -1 and is written as its UTF-8 bytes.
    """

    def __init__(self, vocabulary: Vocabulary):
        normal = {t: i for i, (t, k) in enumerate(zip(vocabulary.texts, vocabulary.kinds)) if k == "normal"}
        if any(t.rstrip(SPACE) and SPACE in t.lstrip(SPACE) or "\n" in t for t in normal):
            raise ValueError("a piece reaches across words")
        n = len(vocabulary.texts)
        symbols = dict(normal)
        for text in normal:
            for c in text:
                symbols.setdefault(c, n + len(symbols))
        scores = sorted({vocabulary.scores[i] for i in normal.values()}, reverse=True)
        place = {score: r for r, score in enumerate(scores)}
        self.rank = np.full(max(symbols.values(), default=0) + 1, _NONE, np.int32)
        for i in normal.values():
            self.rank[i] = place[vocabulary.scores[i]]
        self.chars = {c: s for c, s in symbols.items() if len(c) == 1}
        self.symbol_of = np.full(0x110000, -1, np.int32)
        self.symbol_of[[ord(c) for c in self.chars]] = list(self.chars.values())
        self.byte = np.zeros(256, np.int32)
        for i, (t, k) in enumerate(zip(vocabulary.texts, vocabulary.kinds)):
            if k == "byte":
                self.byte[int(t[1:-1], 16)] = i
        self.pieces = n
        pairs = {}
        first_only = np.zeros(len(self.rank), bool)
        for text, i in normal.items():
            for cut in range(1, len(text)):
                left, right = symbols.get(text[:cut]), symbols.get(text[cut:])
                for part in (left, right):
                    if part is not None and part < n and self.rank[i] <= self.rank[part]:
                        first_only[part] = True
                if left is not None and right is not None:
                    pairs[left << 32 | right] = i
        self.first_only = first_only
        self.pairs = pairs
        self._spread(pairs)
        raw = [
            bytes([int(t[1:-1], 16)]) if k == "byte" else b"" if k == "control" else t.replace(SPACE, " ").encode()
            for t, k in zip(vocabulary.texts, vocabulary.kinds)
        ]
        self.unknown = [i for i, k in enumerate(vocabulary.kinds) if k == "control"][:1]
        if self.unknown:
            raw[self.unknown[0]] = " ⁇ ".encode()
        self.control = np.array([k == "control" for k in vocabulary.kinds])
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_ends = np.cumsum([len(r) for r in raw])
        self.raw_sizes = np.array([len(r) for r in raw], np.int64)

    def merge_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that two symbols make, or -1."""
        keys = (left.astype(np.int64) << 32 | right.astype(np.int64)).view(np.uint64)
        at = (keys * _SPREAD) >> self.shift
        out = np.full(len(keys), -1, np.int32)
        seen = self.keys[at]
        found = seen == keys
        out[found] = self.merged[at[found]]
        # A slot that another pair took: look in the next ones up to a free slot.
        look = np.flatnonzero(~found & (seen != _FREE))
        at = at[look] + np.uint64(1)
        while len(look):
            seen = self.keys[at]
            found = seen == keys[look]
            out[look[found]] = self.merged[at[found]]
            more = ~found & (seen != _FREE)
            look, at = look[more], at[more] + np.uint64(1)
        return out

    def _spread(self, pairs: dict[int, int]) -> None:
        """A hash table of the pairs in two arrays, at most an eighth full."""
        bits = max(4, (8 * len(pairs)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys = np.full((1 << bits) + len(pairs) + 1, _FREE)
        self.merged = np.full(len(self.keys), -1, np.int32)
        for key, piece in pairs.items():
            at = (key * int(_SPREAD) & (1 << 64) - 1) >> 64 - bits
            while self.keys[at] != _FREE:
                at += 1
            self.keys[at], self.merged[at] = key, piece

    def _from_heap(self, word: str) -> list[int]:
        symbols = [self.chars.get(c, -1) for c in word]
        after = [*range(1, len(symbols)), -1]
        before = [*range(-1, len(symbols) - 1)]
        alive = [True] * len(symbols)
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i] if i >= 0 else -1
            if j < 0 or symbols[i] < 0 or symbols[j] < 0:
                return
            made = self.pairs.get(symbols[i] << 32 | symbols[j])
            if made is not None:
                heapq.heappush(heap, (int(self.rank[made]), i, symbols[i], symbols[j]))

        for i in range(len(symbols)):
            offer(i)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j < 0 or symbols[i] != left or symbols[j] != right:
                continue
            symbols[i] = self.pairs[left << 32 | right]
            alive[j] = False
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [(i, s) for i, s in enumerate(symbols) if alive[i]]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and where each word ends."""
        size = np.array([len(w) for w in words], np.int64)
        long = np.flatnonzero(size > LONG)
        usual = [w if len(w) <= LONG else "" for w in words]
        points = np.frombuffer("".join(usual).encode("utf-32-le"), np.uint32)
        symbol = self.symbol_of[points]
        word = np.repeat(np.arange(len(words)), np.where(size > LONG, 0, size))
        done_symbol, done_word, done_at = [], [], []
        place = np.arange(len(points))
        piece = np.full(len(symbol), -1, np.int32)
        inside = np.flatnonzero(word[1:] == word[:-1])
        piece[inside] = self.merge_of(symbol[inside], symbol[inside + 1])
        while len(symbol):
            rank = np.where(piece >= 0, self.rank[piece], _NONE)
            begin = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            lowest = np.repeat(np.minimum.reduceat(rank, begin), np.diff(np.append(begin, len(word))))
            open_ = lowest != _NONE
            if not open_.all():
                shut = ~open_
                done_symbol.append(symbol[shut])
                done_word.append(word[shut])
                done_at.append(place[shut])
                symbol, word, place, piece, rank, lowest = (x[open_] for x in (symbol, word, place, piece, rank, lowest))
                if not len(symbol):
                    break
            hit = np.flatnonzero(rank == lowest)
            fresh = np.concatenate([[True], hit[1:] != hit[:-1] + 1])
            order = np.arange(len(hit))
            since = order - np.maximum.accumulate(np.where(fresh, order, 0))
            take = since % 2 == 0
            alone = np.concatenate([[False], word[hit[1:]] == word[hit[:-1]]])
            # Only the first place in a word for a rank that holds such a piece.
            first = ~alone
            risky = self.first_only[piece[hit]]
            if risky.any():
                word_of = np.cumsum(first) - 1
                held = np.zeros(word_of[-1] + 1, bool)
                held[word_of[risky]] = True
                take &= first | ~held[word_of]
            hit = hit[take]
            symbol[hit] = piece[hit]
            keep = np.ones(len(symbol), bool)
            keep[hit + 1] = False
            moved = np.cumsum(keep) - 1
            hit = moved[hit]
            symbol, word, place, piece = symbol[keep], word[keep], place[keep], piece[keep]
            near = np.zeros(len(symbol) + 1, bool)
            near[hit] = True
            near[hit - 1] = True  # -1 is the spare last place
            near[-1] = False
            touched = np.flatnonzero(near)
            piece[touched] = -1
            touched = touched[touched + 1 < len(symbol)]
            touched = touched[word[touched] == word[touched + 1]]
            piece[touched] = self.merge_of(symbol[touched], symbol[touched + 1])
        ends = np.cumsum(size)
        char_at = np.cumsum(np.where(size > LONG, 0, size)) - np.where(size > LONG, 0, size)
        out_word = np.concatenate([np.zeros(0, np.int64), *done_word])
        out_symbol = np.concatenate([np.zeros(0, np.int32), *done_symbol])
        out_at = np.concatenate([np.zeros(0, np.int64), *done_at])
        point = points[out_at] if len(out_at) else np.zeros(0, np.uint32)
        within = out_at - char_at[out_word] if len(out_at) else out_at
        for w in long.tolist():
            kept = self._from_heap(words[w])
            at = np.array([i for i, _ in kept], np.int64)
            text = np.frombuffer(words[w].encode("utf-32-le"), np.uint32)
            out_word = np.concatenate([out_word, np.full(len(kept), w)])
            out_symbol = np.concatenate([out_symbol, np.array([s for _, s in kept], np.int32)])
            within = np.concatenate([within, at])
            point = np.concatenate([point, text[at]])
        order = np.lexsort((within, out_word))
        out_word, out_symbol, point = out_word[order], out_symbol[order], point[order]
        # What is no piece is written as bytes.
        spelled = (out_symbol < 0) | (out_symbol >= self.pieces)
        count = np.ones(len(out_symbol), np.int64)
        if spelled.any():
            codes = point[spelled]
            count[spelled] = 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)
        starts = np.cumsum(count) - count
        ids = np.empty(int(count.sum()), np.int32)
        ids[starts[~spelled]] = out_symbol[~spelled]
        if spelled.any():
            raw = np.frombuffer("".join(map(chr, codes.tolist())).encode(), np.uint8)
            ids[np.repeat(spelled, count)] = self.byte[raw]
        per_word = np.bincount(out_word, weights=count, minlength=len(words)).astype(np.int64)
        return ids, np.cumsum(per_word)


def ragged(flat: np.ndarray, ends: np.ndarray, sizes: np.ndarray, picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The picked stretches of ``flat`` one after another, and the size of each."""
    size = sizes[picks]
    total = int(size.sum())
    begin = (ends - sizes)[picks]
    out_begin = np.cumsum(size) - size
    return flat[np.repeat(begin - out_begin, size) + np.arange(total)], size


class Encoder:
    """Encodes texts, remembering the words it has met (at most KNOWN_WORDS and those of one slice)."""

    def __init__(self, tables: Tables):
        self.tables = tables
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = np.zeros(0, np.int32)
        self.ends = np.zeros(0, np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the number of ids of each; null is empty."""
        if len(self.known) > KNOWN_WORDS:
            self._forget()
        words: list[str] = []
        counts = []
        for text in texts:
            found = _WORD.findall(SPACE + text.replace(" ", SPACE)) if text else []
            counts.append(len(found))
            words += found
        known = self.known
        picks = list(map(known.get, words))
        if None in picks:
            new = list(dict.fromkeys(w for w, p in zip(words, picks) if p is None))
            ids, ends = self.tables.encode_words(new)
            self.ends = np.concatenate([self.ends, ends + len(self.ids)])
            self.ids = np.concatenate([self.ids, ids])
            known.update(zip(new, range(len(known), len(known) + len(new))))
            picks = [known[w] if p is None else p for w, p in zip(words, picks)]
        chosen = np.array(picks, np.int64)
        ids, size = ragged(self.ids, self.ends, np.diff(self.ends, prepend=0), chosen)
        of = np.repeat(np.arange(len(texts)), counts)
        return ids, np.bincount(of, weights=size, minlength=len(texts)).astype(np.int64)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Texts of runs of ids; the space that encoding put in front goes, bytes that are no UTF-8 become U+FFFD."""
        t = self.tables
        raw, size = ragged(t.raw, t.raw_ends, t.raw_sizes, ids)
        per_text = np.add.reduceat(np.append(size, 0), np.minimum(np.cumsum(counts) - counts, len(size))) if len(counts) else size
        per_text = np.where(counts > 0, per_text, 0)
        data, out, at = raw.tobytes(), [], 0
        begins = np.cumsum(counts) - counts
        for n, count, begin in zip(per_text.tolist(), counts.tolist(), begins.tolist()):
            part = data[at : at + n]
            at += n
            lead = begin
            while lead < begin + count and t.control[ids[lead]] and ids[lead] not in t.unknown:
                lead += 1
            if part.startswith(b" ") and lead < begin + count and t.raw[t.raw_ends[ids[lead]] - t.raw_sizes[ids[lead]]] == 0x20 and ids[lead] not in t.byte and ids[lead] not in t.unknown:
                part = part[1:]
            out.append(part.decode("utf-8", "replace"))
        return out


_encoders: dict[int, Encoder] = {}


def _encoder(vocabulary: Broadcast) -> Encoder:
    key = id(vocabulary.value)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(vocabulary.value.tables)
    return _encoders[key]


def broadcast_model(spark: SparkSession, path: str) -> Broadcast:
    """The pieces of the model at ``path`` (a file of this driver), a few hundred kB, for every task."""
    return spark.sparkContext.broadcast(read_model(path))


def round_trip(docs: DataFrame, vocabulary: Broadcast, text: str = "text", *keep: str) -> DataFrame:
    """``keep`` columns, ``ids`` (array<int>) and ``decoded``: the text encoded, and those ids decoded.

    A null or empty text has no ids and decodes to the empty string. One pass, no shuffle. Columns named ``ids``
    or ``decoded`` are replaced.
    """
    keep = tuple(k for k in keep if k not in ("ids", "decoded"))
    (inner,) = unused(docs, "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary)
        for part in slices(batches, inner):
            ids, counts = encoder.encode(part.column(inner).to_pylist())
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [*(part.column(k) for k in keep), lists, pa.array(encoder.decode(ids, counts), pa.string())],
                names=[*keep, "ids", "decoded"],
            )

    wanted = docs.select(*keep, F.col(text).alias(inner))
    return wanted.mapInArrow(run, with_columns(wanted.schema, inner, "ids array<int>, decoded string"))


def decode(encoded: DataFrame, vocabulary: Broadcast, ids: str = "ids", *keep: str) -> DataFrame:
    """``keep`` columns and ``decoded``: the text of stored ids; null ids decode to the empty string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary)
        for part in batches:
            lists = [x or [] for x in part.column("_ids").to_pylist()]
            counts = np.array([len(x) for x in lists], np.int64)
            flat = np.array([i for x in lists for i in x], np.int64)
            yield pa.RecordBatch.from_arrays(
                [*(part.column(k) for k in keep), pa.array(encoder.decode(flat, counts), pa.string())], names=[*keep, "decoded"]
            )

    wanted = encoded.select(*keep, F.col(ids).alias("_ids"))
    return wanted.mapInArrow(run, with_columns(wanted.schema, "_ids", "decoded string"))


def lengths(docs: DataFrame, vocabulary: Broadcast, text: str = "text", *keep: str) -> DataFrame:
    """``keep`` columns and ``n_tokens`` (long): the encoded length of each text; 0 for null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary)
        for part in slices(batches, "_text"):
            _, counts = encoder.encode(part.column("_text").to_pylist())
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), pa.array(counts, pa.int64())], names=[*keep, "n_tokens"])

    wanted = docs.select(*keep, F.col(text).alias("_text"))
    return wanted.mapInArrow(run, with_columns(wanted.schema, "_text", "n_tokens bigint"))
