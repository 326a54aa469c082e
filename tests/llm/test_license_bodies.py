"""Headers and opening clauses with words changed, against a scan of all windows."""

import random

from citeloom.llm import licenses


def shingles(text):
    for mark in licenses._MARKS:
        text = text.replace(mark, "")
    words = text.lower().split()
    return [tuple(words[i : i + 5]) for i in range(len(words) - 4)]


def best(text, template):
    """The largest share of a template's shingles in any stretch that a window and its surroundings can cover."""
    own, found = set(shingles(template)), shingles(text)
    width = len(own) + 2 * max(1, len(own) // licenses.STRIDE_PART)
    return max((len(own & set(found[i : i + width])) / len(own) for i in range(max(1, len(found) - width + 1))), default=0)


def test_changed_bodies_are_found_and_halves_are_not(spark):
    r = random.Random(3)
    filler = [f"w{i}" for i in range(300)]
    rows, kept = [], {}
    for name, body in licenses.BODIES.items():
        for changed in (0, 1, 2, 30):
            words = body.split()
            for at in range(changed):
                words[(7 + at * (len(words) // max(1, changed))) % len(words)] = f"changed{at}"
            text = " ".join([*r.choices(filler, k=40), *words, *r.choices(filler, k=25)])
            kept[len(rows)] = text
            rows.append((len(rows), text))
        kept[len(rows)] = half = " ".join(body.split()[: len(body.split()) // 2])
        rows.append((len(rows), half))
    got = {(x.doc_id, x.license) for x in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {(i, name) for i, text in kept.items() for name in licenses.TEXTS if any(best(text, t) >= licenses.LEAST for t in licenses.TEXTS[name])}
    assert got == want and len(want) >= 12
