"""The prefix trie against plain Python, and the queue that spills."""

import hashlib
import random
import zlib

import pytest

from citeloom.llm import prefixtrie


def plain(rows):
    turns = {}
    for conv, turn, role, text in sorted(((c, t, r or "", x or "") for c, t, r, x in rows if c is not None), key=lambda x: (x[0], x[1] is not None, x[1] or 0, x[2:])):
        turns.setdefault(conv, []).append((role, text))
    whole = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        rest = abs(c) % 5 * (1 if c > 0 else -1)
        whole[c] = tuple(turns.get(c - rest, [])[:h] + own[h:])
    members = {}
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members.setdefault(whole[c][:d], []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children.get(node, [])
        leaves[node] = sum(leaves[x] for x in below) or 1
        saved[node] = sum(saved[x] for x in below) + (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0)
    out = []
    for node, convs in members.items():
        ends = ",".join(str(c) for c in convs if len(whole[c]) == len(node))
        parent = members[node[:-1]][0] if node else None
        out.append((convs[0], len(node), parent, len(convs), len(children.get(node, [])), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda x: (x[1], x[0]))


def conversations(seed):
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(-40, 200), 120):
        if c % 5 == 0 and r.random() < 0.3:
            continue
        for t in range(r.choice([0, 1, 2, 3, 5, 9, 12])):
            rows.append((c, t, r.choice(["user", "assistant", None]), r.choice(["", None, "é", "hello", "a b"]) if r.random() < 0.6 else f"turn {t}"))
    rows += [(7, t, "user", "long " + "é" * (t % 3)) for t in range(300)] + [(8, None, "user", "null turn"), (8, None, "user", "null turn"), (8, 0, "b", "x"), (8, 0, "a", "y")]
    rows += [(None, 1, "user", "no conversation"), (10**12, 1, "user", "far")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("shard_nodes, most_heavy", [(50_000, 100_000), (5, 0), (40, 100_000), (1, 0)])
def test_against_plain_python(spark, monkeypatch, shard_nodes, most_heavy):
    monkeypatch.setattr(prefixtrie, "MOST_HEAVY", most_heavy)
    rows = conversations(shard_nodes)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS place", "'x' AS depth", "2 AS _n", "3 AS p")
    got = [tuple(r) for r in prefixtrie.trie(frame, shard_nodes).collect()]
    assert sorted(got, key=lambda x: (x[1], x[0])) == plain(rows)


def test_empty_table(spark):
    assert prefixtrie.trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_only_a_root(spark):
    # 6 shares its first turns with 5, which is not there, and has no later ones.
    h = zlib.crc32(b"6") % 9
    assert h > 0
    got = prefixtrie.trie(spark.createDataFrame([(6, 1, "user", "x")], "conv_id long, turn long, role string, text string")).collect()
    assert [tuple(r) for r in got] == [(6, 0, None, 1, 0, 1, 0, hashlib.sha256(b"6").hexdigest())]


@pytest.mark.parametrize("limit", [1, 10, 10_000])
def test_queue_gives_entries_in_order(limit):
    r = random.Random(limit)
    queue, held = prefixtrie.SpillingQueue(limit), []
    for _ in range(3000):
        if held and r.random() < 0.4:
            held.sort()
            assert queue.top() == held[0] and queue.pop() == held.pop(0)
        else:
            entry = (r.randint(0, 50), r.randint(0, 9), r.random())
            queue.push(entry)
            held.append(entry)
    while held:
        held.sort()
        assert queue.pop() == held.pop(0)
    assert queue.top() is None
