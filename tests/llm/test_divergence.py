"""The divergence audit against plain Python, on terms of every length and sources of every kind."""

import random
import re
from collections import Counter, defaultdict

import pytest

from citeloom.llm import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def plain(rows, least):
    seen, counts, groups = defaultdict(int), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        terms = TERM.findall(lowered)
        groups.add((lang, source))
        counts[lang, source].update(terms)
        for t in set(terms):
            seen[lang, t] += 1
    out = set()
    for lang in {g[0] for g in groups}:
        kept = sorted(t for (g, t), n in seen.items() if g == lang and n >= least)
        sources = sorted(s for g, s in groups if g == lang)
        tables = {s: {t: counts[lang, s][t] for t in kept} for s in sources}
        total = {t: sum(tables[s][t] for s in sources) for t in kept}

        def shares(table):
            size = sum(table.values()) + 2 * len(kept)
            return {t: 1 + 10**9 * (n + 2) // size for t, n in table.items()}

        p, q = {s: shares(tables[s]) for s in sources}, shares(total)
        for s in sources:
            pair = [(-sum((p[s][t] - p[o][t]) ** 2 // (p[s][t] + p[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            term = [(-((p[s][t] - q[t]) ** 2 // (p[s][t] + q[t])), t.encode()) for t in kept if tables[s][t] and p[s][t] > q[t]]
            for part, ranked in (("pair", sorted(pair)), ("term", sorted(term)[:10])):
                out |= {(lang, s, part, item.decode(), -v, i + 1) for i, (v, item) in enumerate(ranked)}
    return out


@pytest.mark.parametrize("first_bytes", [1, 4])
def test_against_plain_python(spark, monkeypatch, first_bytes):
    monkeypatch.setattr(divergence, "FIRST_BYTES", first_bytes)
    monkeypatch.setattr(divergence, "LEAST", 3)
    monkeypatch.setattr(divergence, "SHARD_ROWS", 7)
    monkeypatch.setattr(divergence, "BLOCK", 2)
    monkeypatch.setattr(divergence, "MOST_GROUPS", 0)
    r = random.Random(first_bytes)
    words = ["a", "ab", "abc", "abcd", "abcde", "ABCDEF", "éa", "é", "日本語の長い言葉", "日本", "ß" * 40, "x" * 70, "x" * 69 + "y", "ſ", "😀"]
    words += ["".join(r.choices("abc", k=r.randint(1, 9))) for _ in range(40)]
    rows = []
    for _ in range(150):
        text = r.choice([" ", "1", "-", "_", "\n"]).join(r.choices(words, k=r.randint(0, 30)))
        rows.append((text, r.choice(["en", "de", None, ""]), r.choice(["web", "src", "é", None, "", *"abcdefg"])))
    rows += [(None, "fr", "web"), ("", "fr", "src"), ("only here", "it", "one")] + [("same same", "en", "web")] * 5
    frame = spark.createDataFrame(rows, "text string, lang string, source string")
    got = [tuple(x) for x in divergence.audit(frame).collect()]
    assert len(got) == len(set(got)) and set(got) == plain(rows, 3)


def test_odd_columns_and_an_empty_table(spark):
    rows = [("one two", "en", "a", 1, "x")] * 12 + [(None, None, None, 2, "y")]
    frame = spark.createDataFrame(rows, "text string, lang string, source string, n int, _part string").withColumnsRenamed({"n": "term"})
    got = {tuple(r) for r in divergence.audit(frame).collect()}
    assert got == set()  # one source a language, whose shares are those of the language
    assert divergence.audit(frame.limit(0)).count() == 0
