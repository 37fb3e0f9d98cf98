"""The prefix trie against a plain version, with stretches of a few turns so that conversations span several."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from poseframe.llm.prefix_trie import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    own = defaultdict(list)
    digest = lambda role, text: hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    own = {c: [(r[3], r[4]) for r in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(set), defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        turns = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(turns) + 1):
            members[turns[:d]].add(c)
        ends[turns].append(c)
    out = []
    for node, ids in members.items():
        below = [n for n in members if n[: len(node)] == node]
        saved = sum((len(members[n]) - 1) * (len(n[-1][1]) if n else 0) for n in below)
        kids = [n for n in members if n and n[:-1] == node]
        leaves = sum(all(m[: len(n)] != n or m == n for m in below) for n in below)
        parent = min(members[node[:-1]]) if node else None
        out.append((min(ids), len(node), parent, len(ids), len(kids), leaves, saved, hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()))
    return sorted(out, key=str)


def made(seed, n=60, deep=9):
    rng = np.random.default_rng(seed)
    rows = []
    ids = [0, 100, 300, -100, *(int(x) for x in rng.choice(np.arange(-250, 450), n, replace=False))]
    for c in dict.fromkeys(ids):
        size = int(rng.integers(1, deep))
        same = rng.random() < 0.5
        for t in range(size):
            turn = None if rng.random() < 0.1 else t
            rows.append((c, turn, [None, "user", "assistant"][t % 3], f"turn {t}" if same else [None, "", "a", "bé"][int(rng.integers(4))]))
    rows += rows[:5] + [(None, 1, "user", "x")]
    return rows


def got(spark, rows, stretch):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("family", "a", "b", "n", "depth", "block")})
    return sorted((tuple(r[c] for c in COLUMNS) for r in prefix_trie(df, stretch).collect()), key=str)


@pytest.mark.parametrize(("seed", "stretch"), [(1, 2048), (2, 2), (3, 3)])
def test_equals_plain_version(spark, seed, stretch):
    rows = made(seed, deep=14 if seed == 3 else 9)
    assert got(spark, rows, stretch) == plain(rows)


def test_long_conversation_spans_tasks_and_shares_its_copy(spark):
    rows = [(c, t, "user", f"t{t % 7}") for c in (201, 305) for t in range(400)] + [(205, t, "user", "other") for t in range(3)]
    assert got(spark, rows, 64) == plain(rows)


def test_repeated_rows_and_empty_table(spark):
    rows = [(7, 1, "user", "same")] * 500
    assert got(spark, rows, 100) == plain(rows)
    assert got(spark, [], 100) == []
    assert got(spark, [(None, 1, "u", "t")], 100) == []
