"""The kernels against plain versions of themselves."""

import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from citeloom.llm import crosspolytope, flat, licenses, multiset, pieces, quality, substring, token_lengths, toxicity
from citeloom.llm.automaton import SuffixAutomaton
from citeloom.llm.components import components

PATH = public_tokenizers.path("piece_bpe_32k.model")


def packed(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def encoder():
    return pieces.Encoder(pieces.read_model(PATH).tables)


def same(encoder, library, texts):
    ids, counts = encoder.encode(texts)
    decoded = encoder.decode(ids, counts)
    ends = np.cumsum(counts)
    for text, n, end, back in zip(texts, counts, ends, decoded):
        want = library.encode(text)
        assert ids[end - n : end].tolist() == want, text
        assert back == library.decode(want), text


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=4))
def test_pieces_of_any_text(encoder, library, texts):
    same(encoder, library, texts)


def test_pieces_of_hard_texts(encoder, library):
    r = random.Random(3)
    alphabet = ["a", "b", " ", "   ", "\n", "the", "▁", "é", "漢", "😀", "\x00", "\t", "1", "ing", "�", "aa", "<s>", "<0x0A>", "\r"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(2000)]
    texts += [" " * n for n in range(1, 70)] + [" " * 900 + "x", "ab" * 700, "a" * 600, "the" * 300]
    texts += ["".join(r.choice("etaoinsrhl") for _ in range(5000))]
    same(encoder, library, texts)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), min_size=1, max_size=12), min_size=1, max_size=6), st.integers(1, 5))
def test_automaton_owners(sequences, least):
    owned = [(s, 10 - i) for i, s in enumerate(sequences)]
    automaton = SuffixAutomaton(owned)
    for words in [*sequences, list("abcabcabca")]:
        want = []
        for i in range(len(words) - least + 1):
            run = words[i : i + least]
            want.append(min((o for s, o in owned if any(s[j : j + least] == run for j in range(len(s)))), default=None))
        assert automaton.owners(words, least) == want


def test_places_and_hashes():
    texts = ["", " a b", "b a ", "ab", "\n", "a\tb a", "　x"]
    data, offsets = packed(texts)
    first, last, before = flat.places(data, offsets)
    words = [data[a:b].tobytes() for a, b in zip(first, last)]
    assert words == [w for t in texts for w in t.encode().split()]
    assert before.tolist() == [0, *np.cumsum([len(t.encode().split()) for t in texts])]
    hashes = flat.hashes(data, first, last)
    assert len(set(zip(words, hashes.tolist()))) == len(set(words)) == len(set(hashes.tolist()))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=30), st.integers(1, 8))
def test_lowest(values, width):
    got = flat.lowest(np.array(values, np.uint64), width).tolist()
    assert got == [i + int(np.argmin(values[i : i + width])) for i in range(len(values) - width + 1)]


def test_equal_windows_choose_equal_anchors():
    r = random.Random(5)
    texts = [" ".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(0, 60))) for _ in range(30)]
    of, start, count, anchor, _ = substring.passages_of(*packed(texts))
    seen, windows = {}, set()
    for d, s, n, a in zip(of.tolist(), start.tolist(), count.tolist(), anchor.tolist()):
        words = texts[d].split()
        for i in range(s, s + n):
            windows.add((d, i))
            assert seen.setdefault(tuple(words[i : i + 13]), a) == a
    assert windows == {(d, i) for d, t in enumerate(texts) for i in range(len(t.split()) - 12)}


def test_components(spark):
    r = random.Random(1)
    links = [(r.randint(0, 400), r.randint(0, 400)) for _ in range(250)] + [(i, i + 1) for i in range(1000, 1200)] + [(2000, i) for i in range(2001, 2300)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {row.node: row.root for row in components(spark.createDataFrame(links, "a long, b long")).collect()}
    touched = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: find(x) for x in touched}


def test_fingerprint_is_a_multiset_hash():
    one, other = "first line\nsecond one", "third\nfourth and more"
    assert multiset.fingerprint_of("second one\nfirst line") == multiset.fingerprint_of(one)
    both = multiset.combined(multiset.fingerprint_of(one), multiset.fingerprint_of(other))
    assert both == multiset.fingerprint_of(one + "\n" + other)
    assert multiset.combined(both, multiset.fingerprint_of(other), -1) == multiset.fingerprint_of(one)
    assert multiset.fingerprint_of(one + "\nfirst line") != multiset.fingerprint_of(one)
    assert multiset.fingerprint_of(None) == multiset.fingerprint_of("")


def test_hadamard_keeps_length_and_axes_are_nearest():
    rows = np.random.default_rng(0).normal(size=(50, 8))
    assert np.allclose((crosspolytope.hadamard(rows) ** 2).sum(1), 8 * (rows**2).sum(1))
    axes = crosspolytope.axes_of(rows, crosspolytope.Settings(tables=3), 4)
    assert (axes[:, :, 0] == crosspolytope.axes_of(3 * rows, crosspolytope.Settings(tables=3), 1)[:, :, 0]).all()
    opposite = crosspolytope.axes_of(-rows, crosspolytope.Settings(tables=3), 4)
    assert (opposite == axes ^ 1).all()


def test_neighbours_exactly_when_few(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(60)]
    rows += [(100, rows[0][1]), (101, rows[0][1]), (102, [0.0] * 6), (103, None), (104, [float("nan")] * 6), (105, [1.0, None] + [1.0] * 4)]
    rows += [(200, [1.0, 2.0]), (201, [1.0, 2.5])]
    frame = spark.createDataFrame(rows, "vec_id long, vector array<double>")
    got = crosspolytope.nearest(frame, frame.vec_id % 20 == 0, k=50, settings=crosspolytope.Settings(tables=1, probes=1)).collect()
    usable = {i: np.array(v) for i, v in rows if i < 102 or i >= 200}
    for q in (0, 20, 40, 100, 200):
        same_size = {i: v for i, v in usable.items() if len(v) == len(usable[q]) and i != q}
        want = sorted((float(np.sqrt(((v - usable[q]) ** 2).sum())), i) for i, v in same_size.items())[:50]
        found = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == q)
        assert [f[1] for f in found] == [i for _, i in want]
        assert np.allclose([f[2] for f in found], [s for s, _ in want])


def test_trees_learn_a_rule():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, len(quality.FEATURES)))
    y = ((x[:, 3] > 0.2) ^ (x[:, 7] > 0)).astype(float)
    trees = quality.fit(x[:2000], y[:2000])
    assert ((trees.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95
    assert np.allclose(quality.fit(x[:5], np.ones(5)).score(x[:3]), 5.5 / 6)
    assert np.isfinite(quality.fit(x[:0], y[:0]).score(x[:3])).all()


def test_statistics_are_those_of_the_text():
    texts = ["Ab cd. Ab cd.\nAb cd.", "", "x"]
    rows = quality.statistics_of(*packed(texts))
    at = dict(zip(quality.FEATURES, rows[0]))
    assert at["words"] == np.log1p(6) and at["distinct_words"] == 2 / 6 and at["lines"] == np.log1p(2)
    assert at["upper"] == 3 / 20 and at["most_frequent_word"] == 0.5 and at["repeats_before"] == 0
    assert not rows[1].any() and np.isfinite(rows).all()


def test_severity_orders_texts():
    r = random.Random(4)
    plain = ["green", "house", "river", "stone", "walks", "quiet", "paper"]
    bad = ["scum", "vile", "filth", "rotten"]
    texts, toxic = [], []
    for i in range(800):
        n = i % 4 if i % 2 else 0
        texts.append(" ".join(r.choices(plain, k=20) + r.sample(bad, n)))
        toxic.append(float(n > 0))
    model = toxicity.fit(*toxicity.words_of(*packed(texts)), np.array(toxic))
    assert (np.diff(model.cuts) > 0).all()
    ask = ["green house river", "green house SCUM!", "vile scum house", "vile, scum; filth rotten"]
    above = model.above(model.latent(*toxicity.words_of(*packed(ask)), 4))
    assert (np.diff(above.sum(axis=1)) > 0).all()
    assert (np.diff(above, axis=1) <= 0).all() and above[0, 0] < 0.5 < above[1, 0]


def test_licenses_are_found_where_they_stand(spark):
    fill = [f"word{i}" for i in range(200)]
    gpl = licenses.TEMPLATES["GPL-3.0"]
    rows = [
        (1, " ".join(fill[:50]) + " " + gpl + " " + " ".join(fill[50:])),
        (2, gpl.upper()),
        (3, gpl.replace("version", "Version,\n") + " Released under the MIT License."),
        (4, "This work is licensed under the GNU General"),
        (5, licenses.TEMPLATES["MPL-2.0"].replace("You can obtain", "you may obtain")),
        (6, " ".join(fill)),
    ]
    got = {(r.doc_id, r.license): r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {(1, "GPL-3.0"), (2, "GPL-3.0"), (3, "GPL-3.0"), (3, "MIT"), (5, "MPL-2.0")}
    assert got[1, "GPL-3.0"].containment == 1.0 and 0.8 <= got[5, "MPL-2.0"].containment < 1


def test_truncated_totals_and_quantiles(spark):
    sizes = [0, 0, 3, 5, 5, 9]
    sums = token_lengths.suffix_sums(spark.createDataFrame([(n, sizes.count(n)) for n in set(sizes)], "n_tokens long, n_docs long"))
    for row in token_lengths.truncated_totals(sums, [0, 1, 4, 5, 9, 100]).collect():
        assert row.tokens_kept == sum(min(s, row.limit) for s in sizes)
        assert row.docs_cut == sum(s > row.limit for s in sizes)
    assert [r.n_tokens for r in token_lengths.quantiles(sums, [0.1, 0.5, 0.9, 1.0]).collect()] == [0, 3, 9, 9]
