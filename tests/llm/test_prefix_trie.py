"""The trie of conversations against one built turn by turn in memory."""

import hashlib
import zlib
from collections import defaultdict

from spanworks.llm import prefix_trie

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(rows):
    own = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            own[conv_id].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(role, text) for *_, role, text in sorted(turns)] for c, turns in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 6
        turns = own.get(c - (c % 100 if c >= 0 else -(-c % 100)), [])[:h] + own[c][h:]
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    out, leaves, saved, children = [], defaultdict(int), defaultdict(int), defaultdict(int)
    for node in sorted(members, key=len, reverse=True):
        if not children[node]:
            leaves[node] = 1
        saved[node] += (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
        up = node[:-1]
        if node:
            children[up] += 1
            leaves[up] += leaves[node]
            saved[up] += saved[node]
        ids = ",".join(map(str, sorted(ends[node])))
        out.append((min(members[node]), len(node), min(members[up]) if node else None, len(members[node]), children[node], leaves[node], saved[node], hashlib.sha256(ids.encode()).hexdigest()))
    return out


def order(rows):
    return sorted(rows, key=lambda r: (r[0], r[1]))


def same(spark, rows):
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = [tuple(r[c] for c in COLUMNS) for r in prefix_trie.trie(table).collect()]
    assert order(got) == order(brute(rows))


def test_given_conversations(spark, sf):
    table = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/conversations.parquet")
    got = [tuple(r[c] for c in COLUMNS) for r in prefix_trie.trie(table).collect()]
    assert order(got) == order(brute([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]))


def test_awkward_conversations(spark):
    """Nulls, ties, repeated turns, absent hundreds, negative ids, turnless and equal conversations."""
    rows = [
        (0, 1, "user", "a"), (0, 2, "assistant", "b"), (0, None, None, None), (0, 2, "assistant", "b"), (0, 2, "assistant", "aa"), (0, 9, "user", "🎉ü"),
        *[(c, t, "user", "xyz"[t % 3]) for c in range(1, 40) for t in range(c % 7)], *[(c, t, None, "same") for c in range(200, 230) for t in range(9)],
        *[(c, 0, "user", "") for c in (-5, -105, -100, 512)], (None, 1, "user", "lost"), (77, 3, "user", "x" * 10_000), (9_000_000_000, 1, "u", None)]
    same(spark, rows)
    same(spark, rows[:1])
    same(spark, [(7, 1, "u", "t")])


def test_deep_conversations(spark, monkeypatch):
    """Depths shared over many rounds, paths hanging from paths, and tails written in parts."""
    monkeypatch.setattr(prefix_trie, "TAIL", 8)
    monkeypatch.setattr(prefix_trie, "MOST_TURNS", 8)
    rows = [(100 * c, t, "u", "same" if t < 40 - 3 * c else f"{c}") for c in range(1, 13) for t in range(55)]
    same(spark, rows + [(100 * c, t, "u", "same") for c in (20, 21) for t in range(45)])


def test_empty_and_clashing(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.trie(empty).collect() == []
    table = spark.createDataFrame([(1, 2, "u", "t", 3, "x", {"k": 1}, 4)], "conv_id long, turn long, role string, text string, depth long, key string, `a.b` map<string,int>, part int")
    assert len(prefix_trie.trie(table).collect()) == len(brute([(1, 2, "u", "t")]))


def test_hot_node(spark):
    """One conversation copied many times: a shared path and one node where all end."""
    same(spark, [(c, t, "u", f"turn {t}") for c in range(0, 3000) for t in range(3)])
