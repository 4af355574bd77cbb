import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from zonewise.llm import queries, trie
from zonewise.llm.parentheses import Parentheses
from zonewise.operators.workset import Scratch

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def expected(rows):
    """Every prefix as a tuple of turns, every subtree walked."""
    talks = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            talks[conv].append((turn is not None, turn or 0, role or "", text or ""))
    talks = {c: [x[2:] for x in sorted(t, key=lambda x: x[:2])] for c, t in talks.items()}
    built = {}
    for c, own in talks.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(talks.get(c - int(math.fmod(c, 5)), [])[:h] + own[h:])
    members = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[built[c][:d]].append(c)
    below = defaultdict(list)
    for node in members:
        if node:
            below[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[x] for x in below[node]) or 1
        own = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        saved[node] = own + sum(saved[x] for x in below[node])
    return sorted(
        (m[0], len(x), members[x[:-1]][0] if x else -1, len(m), len(below[x]), leaves[x], saved[x], sha(",".join(str(c) for c in m if built[c] == x)))
        for x, m in members.items()
    )


def got(df):
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.select(*columns).collect())


def made(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS size", "2 AS depth", "'x' AS nodes", "3 AS ka")
    with Scratch(spark) as scratch:
        return got(trie.build(df, scratch))


def test_query_on_whole_conversations(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(queries.op11_conversation_trie(spark, folder)) == expected(rows)


def drawn(seed, n=150):
    draw = random.Random(seed)
    rows = []
    for c in range(-20, n):
        for k in range(draw.choice([1, 2, 3, 9, 14])):
            rows.append((c, k, draw.choice(["user", "user", "assistant", None]), draw.choice(["a", "a", "a", "bé", None])))
    return rows


@pytest.mark.parametrize("nodes", [1, 40, 200_000])
def test_any_cut_into_parts_gives_the_same(spark, monkeypatch, nodes):
    monkeypatch.setattr(trie, "NODES", nodes)
    monkeypatch.setattr(trie, "HOT_ROWS", 20)
    monkeypatch.setattr(trie, "BLOCK", 3)
    monkeypatch.setattr(trie, "LOT", 2)
    rows = drawn(nodes)
    want = expected(rows)
    assert made(spark, rows) == want
    monkeypatch.setattr("zonewise.operators.workset.BROADCAST_ROWS", 0)
    assert made(spark, rows) == want


def test_odd_conversations(spark):
    rows = [
        (None, 0, "user", "lost"), (1, None, "user", "b"), (1, 0, None, None), (2, 1, "user", "x" * 300_000), (2, 0, "us", "er"), (3, 0, "use", "r"),
        (4, 7, "user", "only"), (4, 7, "user", "only"), (9, -1, "user", "𝄞"), (-7, 0, "a", ""), (-5, 0, "a", ""), (2**62, 0, "a", ""),
    ]
    assert made(spark, rows) == expected(rows)
    assert made(spark, rows[:1]) == []
    alone = [(c, 0, "user", "a") for c in range(1, 400) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 0][:1]
    assert made(spark, alone) == expected(alone) == [(alone[0][0], 0, -1, 1, 0, 1, 0, sha(str(alone[0][0])))]


def test_hot_conversations(spark):
    """A conversation with a third of the rows, another with a third in equal turns, and many copies of a third one."""
    rows = [(5, k, "user", f"t{k}") for k in range(3000)] + [(8, 1, "user", "same")] * 3000
    rows += [(c, k, "user", f"c{k}") for c in range(1000, 2500) for k in (0, 1)]
    assert made(spark, rows) == expected(rows)


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 5000])
def test_close_against_a_stack(n):
    draw = random.Random(n)
    for lean in (0.5, 0.9):
        bits, depth = [], 0
        for left in range(2 * n, 0, -1):
            up = depth == 0 or (depth < left and draw.random() < lean)
            bits.append(int(up))
            depth += 1 if up else -1
        tree, stack, want = Parentheses(bits), [], {}
        for k, b in enumerate(bits):
            if b:
                stack.append(k)
            else:
                want[stack.pop()] = k
        at = np.array(sorted(want))
        assert tree.close(at).tolist() == [want[k] for k in at.tolist()]
        assert tree.rank(at).tolist() == list(range(len(at)))
