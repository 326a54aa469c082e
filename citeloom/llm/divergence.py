"""Source divergence audit: how far the terms of each source of a language differ from the others'.

Terms are found by iceberg prefix refinement. Level by level (FIRST_BYTES, then twice as many bytes each
time) the byte prefixes of terms are counted by distinct documents of a language; a prefix in fewer than
LEAST documents is dropped, and only terms with a kept prefix are looked at in the next level. A term that
ends within a level is counted there as a whole, by source. A term of a dropped prefix is in fewer than
LEAST documents itself, so every kept term is found and all its counts are exact; the broadcast bitmap
of kept prefixes only spares work.

Divergences are whole numbers throughout. Pairs of sources are compared in cells of (term shard, block
of sources, block of sources): a cell lays the shares of its terms out as an array of terms x sources, so
no row per term and pair of sources is made.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.llm import flat
from citeloom.llm.bits import broadcast_bits
from citeloom.llm.frames import slices, utf8
from citeloom.sources.scratch import staged

#: Documents of a language that a term is in, at least.
LEAST = 10
FIRST_BYTES = 4
SCALE = 1_000_000_000
#: Terms of each group in the report.
TOP = 10
#: Bytes of text that are counted before rows are handed on.
COUNTED_BYTES = 4 << 20
#: Rows of a term shard, about, and sources of a block.
SHARD_ROWS = 20_000
BLOCK = 512
#: Groups that may be broadcast; more of them are joined.
MOST_GROUPS = 100_000

_GAP = np.zeros(256, bool)
_GAP[0x00:0x41] = _GAP[0x5B:0x61] = _GAP[0x7B:0x80] = True


def _lowered(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data | 32, data).astype(np.uint8)  # only A-Z


def _cut(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The bytes of each span as a binary array."""
    ends = np.cumsum(sizes)
    offsets = np.zeros(len(sizes) + 1, np.int64)
    offsets[1:] = ends
    place = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], sizes)
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data[place])])


def _keys(langs: np.ndarray, prefixes: np.ndarray) -> np.ndarray:
    """A key for a prefix (hash) in a language (hash)."""
    return flat.mixed(prefixes ^ langs * np.uint64(0x9E3779B97F4A7C15))


def _strings(column: pa.Array) -> np.ndarray:
    """A hash of each string."""
    data, offsets = utf8(column)
    return flat.hashes(data, offsets[:-1], offsets[1:]) if len(data) else np.full(len(column), flat.mixed(np.zeros(1, np.uint64))[0])


def _counted(docs: DataFrame, done: int, level: int, kept: Broadcast | None) -> DataFrame:
    """lang, source, text -> counts of the terms of ``done`` + 1 to ``level`` bytes by source (``whole``), and of the prefixes of longer ones by language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", COUNTED_BYTES):
            data, offsets = utf8(part.column("text"))
            data = _lowered(data)
            first, last, before = flat.places(data, offsets, _GAP)
            doc, size = np.repeat(np.arange(part.num_rows), np.diff(before)), last - first
            at = np.flatnonzero(size > done)
            if kept is not None and len(at):
                prefix = flat.hashes(data, first[at], first[at] + done)
                at = at[kept.value.holds(_keys(_strings(part.column("lang"))[doc[at]], prefix))]
            if not len(at):
                continue
            cut = _cut(data, first[at], np.minimum(size[at], level)).dictionary_encode()
            code = cut.indices.to_numpy().astype(np.int64) * 2 + (size[at] <= level)
            width = 2 * len(cut.dictionary)
            in_doc, times = np.unique(doc[at] * width + code, return_counts=True)
            lang, source = (part.column(c).dictionary_encode() for c in ("lang", "source"))
            langs, sources = lang.indices.to_numpy().astype(np.int64), source.indices.to_numpy().astype(np.int64)
            held, code = in_doc // width, in_doc % width
            # A prefix belongs to a language, a whole term to a source of it.
            of = langs[held] * (len(source.dictionary) + 1) + np.where(code & 1, sources[held] + 1, 0)
            each, place = np.unique(of * width + code, return_inverse=True)
            n = np.bincount(place, weights=times).astype(np.int64)
            of, code = each // width, each % width
            owner = of % (len(source.dictionary) + 1)
            yield pa.RecordBatch.from_arrays(
                [
                    lang.dictionary.take(pa.array(of // (len(source.dictionary) + 1))),
                    source.dictionary.take(pa.array(owner - 1, mask=owner == 0)),
                    cut.dictionary.cast(pa.binary()).take(pa.array(code >> 1)),
                    pa.array((code & 1).astype(bool)),
                    pa.array(np.bincount(place)),
                    pa.array(n),
                ],
                names=["lang", "source", "term", "whole", "docs", "n"],
            )

    counted = docs.mapInArrow(run, "lang string, source string, term binary, whole boolean, docs bigint, n bigint")
    summed = counted.groupBy("lang", "source", "term", "whole").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))
    return staged(summed.where(F.col("whole") | (F.col("docs") >= LEAST)), "terms")


def _prefix_keys(prefixes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            if part.num_rows:
                key = _keys(_strings(part.column("lang")), _strings(part.column("term").cast(pa.large_binary()).view(pa.large_string())))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64))], names=["key"])

    return prefixes.select("lang", "term").mapInArrow(run, "key bigint")


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, text (no nulls) -> lang, source, term (string), n, total: occurrences in the source and in the language, of the kept terms."""
    done, level, kept, found = 0, FIRST_BYTES, None, None
    while True:
        counted = _counted(docs, done, level, kept)
        whole = counted.where("whole").drop("whole")
        found = whole if found is None else found.unionByName(whole)
        prefixes = counted.where("NOT whole")
        many = prefixes.count()
        if not many:
            break
        kept = broadcast_bits(_prefix_keys(prefixes), many)
        done, level = level, 2 * level
    held = found.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total")).where(F.col("docs") >= LEAST)
    return found.select("lang", "source", "term", "n").join(held.select("lang", "term", "total"), ["lang", "term"]).withColumn("term", F.col("term").cast("string"))


def _share(count: Column, size: Column, terms: Column) -> Column:
    """1 + floor(SCALE (count + 2) / (size + 2 terms)), exactly; 1 where there are no terms."""
    wide = F.lit(SCALE).cast("decimal(10,0)") * (count + 2).cast("decimal(20,0)")
    whole = F.call_function("div", wide, F.greatest(size + 2 * terms, F.lit(1)).cast("decimal(20,0)"))
    return F.when(terms > 0, whole + 1).otherwise(F.lit(1)).cast("long")


def _apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _cell(rows: pa.Table, groups: pa.Table) -> pa.Table:
    """Rows (source, term, p) and all groups (source, block, absent) of one cell -> sums over the cell's terms for pairs of sources."""
    names = ["lang", "one", "other", "one_absent", "other_absent", "value", "seen"]
    types = [pa.string(), pa.string(), pa.string(), *[pa.int64()] * 4]
    order = np.argsort(np.array(groups["source"].to_pylist(), dtype=object), kind="stable")
    groups = groups.take(pa.array(order))
    source, absent = groups["source"].combine_chunks(), groups["absent"].to_numpy()
    left, right = (np.flatnonzero(groups["block"].to_numpy() == groups[c][0].as_py()) if len(source) else np.zeros(0, np.int64) for c in ("low", "high"))
    same = len(left) and left[0] == right[0] if len(right) else False
    sums = np.zeros((len(source), len(source)), np.int64)
    term = rows["term"].combine_chunks().dictionary_encode()
    terms = len(term.dictionary)
    if terms:
        row = term.indices.to_numpy().astype(np.int64)
        column = pa.compute.index_in(rows["source"].combine_chunks(), source).to_numpy().astype(np.int64)
        p, by = rows["p"].to_numpy(), np.argsort(row, kind="stable")
        step = max(1, (1 << 21) // len(source))
        for low in range(0, terms, step):
            here = by[np.searchsorted(row[by], low) : np.searchsorted(row[by], low + step)]
            shares = np.repeat(absent[None, :], min(step, terms - low), axis=0)
            shares[row[here] - low, column[here]] = p[here]
            for s in left.tolist():
                others = right[right > s] if same else right
                apart = shares[:, others] - shares[:, [s]]
                sums[s, others] += (apart * apart // (shares[:, others] + shares[:, [s]])).sum(axis=0)
    one, other = np.meshgrid(left, right, indexing="ij")
    one, other = one.ravel(), other.ravel()
    if same:
        one, other = one[one < other], other[one < other]
    lang = groups["lang"].combine_chunks()
    into = [lang.take(pa.array(one)), source.take(pa.array(one)), source.take(pa.array(other)), pa.array(absent[one]), pa.array(absent[other]), pa.array(sums[one, other]), pa.array(np.full(len(one), terms))]
    return pa.table([a.cast(t) for a, t in zip(into, types)], names=names)


def _pairs(rows: DataFrame, groups: DataFrame, blocks: int, shards: int) -> DataFrame:
    """lang, source, item (another source), value."""
    block = F.pmod(F.xxhash64("source"), F.lit(blocks)).cast("int").alias("block")
    partners = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda j: F.struct(F.least("block", j).alias("low"), F.greatest("block", j).alias("high")))
    dealt = rows.select("lang", "source", "term", "p", F.pmod(F.xxhash64("term"), F.lit(shards)).cast("int").alias("shard"), block)
    dealt = dealt.withColumn("cell", F.explode(partners)).select("lang", "source", "term", "p", "shard", "cell.low", "cell.high")
    every = groups.select("lang", "source", "absent", block).withColumn("cell", F.explode(partners))
    every = every.select("lang", "source", "absent", "block", "cell.low", "cell.high", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    cell = ["lang", "shard", "low", "high"]
    sums = dealt.groupBy(*cell).cogroup(every.groupBy(*cell)).applyInArrow(
        _cell, "lang string, one string, other string, one_absent bigint, other_absent bigint, value bigint, seen bigint"
    )
    whole = sums.groupBy("lang", "one", "other").agg(
        F.min("one_absent").alias("p"), F.min("other_absent").alias("q"), F.sum("value").alias("value"), F.sum("seen").alias("seen")
    )
    terms = groups.select("lang", F.col("source").alias("one"), "terms")
    # Terms that neither source has differ by the same amount each.
    value = F.col("value") + (F.col("terms") - F.col("seen")) * _apart(F.col("p"), F.col("q"))
    valued = staged(whole.join(terms, ["lang", "one"]).select("lang", "one", "other", value.alias("value")), "pairs")
    there = valued.select("lang", F.col("one").alias("source"), F.col("other").alias("item"), "value")
    back = valued.select("lang", F.col("other").alias("source"), F.col("one").alias("item"), "value")
    return there.unionByName(back)


def audit(docs: DataFrame) -> DataFrame:
    """lang, source, text -> lang, source, part, item, value, rank.

    Part ``pair``: every other source of the language, the most different first. Part ``term``: the TOP
    terms that the source has more of than its language. Null text, lang and source are read as ''. Each row
    is a document, rows that repeat an id too. Equal values are ranked by the bytes of the item. Other
    columns are ignored. A source without terms is compared like any other (each term's count is 0); a
    language without kept terms gives 0 for its pairs and no terms. An empty table gives no rows.
    """
    read = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    rows = staged(term_counts(read), "counts")
    named = read.select("lang", "source").distinct()
    sizes = rows.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    per_term = rows.groupBy("lang", "term").agg(F.min("total").alias("total"))
    langs = per_term.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("lang_size"))
    groups = named.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0)
    groups = staged(groups.withColumn("absent", _share(F.lit(0), F.col("size"), F.col("terms"))), "groups")
    held = groups.groupBy("lang").count().agg(F.sum("count"), F.max("count")).first()
    count, most = held[0] or 0, held[1] or 0
    shown = groups.select("lang", "source", "size", "terms", "lang_size")
    shares = rows.join(F.broadcast(shown) if count <= MOST_GROUPS else shown, ["lang", "source"]).select(
        "lang",
        "source",
        "term",
        _share(F.col("n"), F.col("size"), F.col("terms")).alias("p"),
        _share(F.col("total"), F.col("lang_size"), F.col("terms")).alias("q"),
    )
    shares = staged(shares, "shares")
    shards = math.ceil(max(1, shares.count()) / SHARD_ROWS)
    pairs = _pairs(shares, groups, max(1, math.ceil(most / BLOCK)), shards).withColumn("part", F.lit("pair"))
    above = shares.where("p > q").select("lang", "source", F.col("term").alias("item"), _apart(F.col("p"), F.col("q")).alias("value"), F.lit("term").alias("part"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), F.asc("item"))
    ranked = [f.withColumn("rank", F.row_number().over(order)) for f in (pairs, above)]
    both = ranked[0].unionByName(ranked[1].where(F.col("rank") <= TOP))
    return both.select("lang", "source", "part", "item", "value", "rank")


SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM documents),
each AS (SELECT row, lang, source, unnest(terms) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS total FROM each GROUP BY lang, term HAVING count(DISTINCT row) >= {LEAST}),
langs AS (SELECT lang, count(*) AS v, sum(total) AS size FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS n FROM each JOIN kept USING (lang, term) GROUP BY lang, source, term),
groups AS (
  SELECT g.lang, g.source, coalesce(v, 0) AS v, coalesce(l.size, 0) AS lang_size, coalesce(s.size, 0) AS size
  FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN langs l ON g.lang = l.lang
  LEFT JOIN (SELECT lang, source, sum(n) AS size FROM counts GROUP BY lang, source) s ON g.lang = s.lang AND g.source = s.source),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n,
         1 + ({SCALE}::HUGEINT * (coalesce(n, 0) + 2)) // (g.size + 2 * v)::HUGEINT AS p,
         1 + ({SCALE}::HUGEINT * (k.total + 2)) // (g.lang_size + 2 * v)::HUGEINT AS q
  FROM groups g JOIN kept k ON g.lang = k.lang
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
apart AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM shares WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank
FROM ranked WHERE part = 'pair' OR rank <= {TOP}
"""
