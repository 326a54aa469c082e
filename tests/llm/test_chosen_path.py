"""The chosen-path join against brute-force Jaccard similarity."""

import random

import numpy as np
import pytest

from citeloom.llm import chosenpath


def shingles(text, k):
    words = (text or "").encode().lower().split()
    return frozenset(zip(*(words[i:] for i in range(k)))) or frozenset([tuple(words)] if words else [])


def brute(texts, k, empty_alike=False):
    sets, root = {i: shingles(t, k) for i, t in texts.items()}, {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in texts:
        for j in texts:
            shared = len(sets[i] & sets[j])
            both = len(sets[i]) + len(sets[j]) - shared
            if j < i and (empty_alike or both) and 100 * shared >= 80 * both:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in texts}


def edited_texts(seed):
    """Texts, copies with some words changed, a passage that many hold, a long chain of copies, short and empty ones."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    common = " ".join(r.choices(words, k=40))
    texts = []
    for _ in range(25):
        base = r.choices(words, k=r.randint(20, 150))
        texts.append(" ".join(base))
        for _ in range(r.randint(0, 4)):
            copy = list(base)
            for _ in range(r.randint(1, 5)):
                copy[r.randrange(len(copy))] = r.choice(words)
            texts.append(" ".join(copy) if r.random() < 0.7 else " ".join(copy).upper() + "\n" + common)
    texts += [" ".join(r.choices(words, k=r.randint(8, 14))) + " " + common for _ in range(40)]
    long = r.choices(words, k=300)
    texts += [" ".join([*long[: i * 5], "changed", str(i), *long[i * 5 + 2 :]]) for i in range(40)]
    texts += ["", " \n", None, "one two", "ONE two", "one", "One", "one two three four", "a b c d e", "A b c d e", "a a a a", "a a"]
    r.shuffle(texts)
    return {i + 1: t for i, t in enumerate(texts)}


@pytest.mark.parametrize("shingle, leaf, block", [(2, 32, 4096), (2, 2, 5), (5, 32, 4096), (5, 3, 4096)])
def test_against_brute_force(spark, monkeypatch, shingle, leaf, block):
    # Small leaves and blocks lead through every level and into blocks of large nodes.
    monkeypatch.setattr(chosenpath, "LEAF", leaf)
    monkeypatch.setattr(chosenpath, "BLOCK_ROWS", block)
    monkeypatch.setattr(chosenpath, "SHARD_ROWS", 50)
    texts = edited_texts(shingle + leaf)
    want = brute(texts, shingle)
    assert 40 < len({c for _, c in want.values()}) < len(texts) - 40
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").selectExpr("*", "'clash' AS key", "'clash' AS node", "1 AS n", "2 AS _root")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in chosenpath.near_copies(frame, shingle).collect()}
    assert got == want


def test_odd_rows(spark):
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
    rows = [(None, "a b c d"), (None, None), (7, "a b c d"), (7, "other words here"), (7, "other words here"), (9, long), (12, long), (3, ""), (4, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in chosenpath.near_copies(frame).collect())
    size = len(shingles(long, 2))
    assert got == [(-1, 0, -1), (-1, 3, 7), (3, 0, 3), (4, 0, 4), (7, 2, 7), (7, 2, 7), (7, 3, 7), (9, size, 9), (12, size, 9)]
    alike = {r.doc_id: r.component_id for r in chosenpath.near_copies(frame, empty_alike=True).collect()}
    assert alike[3] == alike[4] == alike[None] or alike[4] == 3
    assert chosenpath.near_copies(frame.limit(0)).count() == 0
    assert {r.component_id for r in chosenpath.near_copies(frame.where("doc_id < 5")).collect()} == {3, 4}


def test_trees_miss_as_seldom_as_stated():
    """Share of pairs of similarity 0.8 that one tree's level parts: 1 - 0.9974, within sampling error."""
    r = np.random.default_rng(1)
    missed = total = 0
    for _ in range(300):
        common, left, right = (r.integers(0, 1 << 64, n, dtype=np.uint64) for n in (80, 10, 10))
        both = [np.sort(np.concatenate([common, own])) for own in (left, right)]
        one, other = chosenpath.branches_of(np.concatenate(both), np.array([0, 90, 180])).reshape(2, -1, chosenpath.BRANCHES)
        shared = np.array([bool(set(a) & set(b)) for a, b in zip(one.tolist(), other.tolist())])
        missed, total = missed + (~shared).sum(), total + len(shared)
    assert missed / total < 0.006
