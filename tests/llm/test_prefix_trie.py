"""The prefix trie against sequences held whole in plain Python."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from concordia.llm import prefix_trie, running

SCHEMA = "conv_id long, turn long, role string, text string, depth int"


def brute(rows, rebuild=True):
    own = defaultdict(list)
    for conv, turn, role, text, _ in rows:
        if conv is not None:
            own[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(turns)] for c, turns in own.items()}
    convs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9 if rebuild else 0
        convs[c] = own.get(c - c % 5, [])[:h] + turns[h:] if rebuild else turns
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids, under = defaultdict(int), defaultdict(list)
    for path in members:
        if path:
            kids[path[:-1]] += 1
        for d in range(len(path) + 1):
            under[path[:d]].append(path)
    out = []
    for path, cs in members.items():
        ends = ",".join(str(c) for c in sorted(cs) if len(convs[c]) == len(path))
        saved = sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in under[path] if p)
        out.append((min(cs), len(path), min(members[path[:-1]]) if path else None, len(cs), kids[path], sum(not kids[p] for p in under[path]), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def query(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    return found(prefix_trie.op11_prefix_trie(spark, str(tmp_path)))


@pytest.mark.parametrize("convs,alphabet", [(60, 2), (40, 9)])
def test_rebuilt_conversations(spark, tmp_path, convs, alphabet):
    draw = random.Random(convs)
    rows = []
    for c in draw.sample(range(2 * convs), convs):
        for turn in range(draw.randrange(1, 11)):
            rows.append((c, turn, draw.choice(["user", "user", "assistant", None]) if draw.random() < 0.2 else "user", draw.choice([None, "", "é", "long " * 50, *"abcdefghi"][:alphabet + 2]), 1))
    rows += [(None, 1, "user", "a", 1), (3, None, "user", "first", 1), (3, 0, "user", "b", 1), (3, 0, "user", "b", 1)]
    assert query(spark, tmp_path, rows) == brute(rows)


def test_empty_table(spark, tmp_path):
    assert query(spark, tmp_path, []) == []


def test_copies_and_a_long_conversation_that_ranges_part(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK_BITS", 2)  # several blocks of ids in a node
    rows = [(c, t, "user", f"t{t}", 1) for c in range(0, 200, 2) for t in range(3)] + [(1, t, "user", f"t{t % 5}", 1) for t in range(700)] + [(5, t, "user", f"t{t % 5}", 1) for t in range(600)]
    turns = prefix_trie.ordered_turns(spark.createDataFrame(rows, SCHEMA))
    assert found(prefix_trie.prefix_trie(*prefix_trie.as_they_are(turns))) == brute(rows, rebuild=False)


def test_running_sums_over_parted_keys(spark):
    from pyspark.sql import functions as F

    rows = [(k, i, 1) for k in (None, 1, 1, 1, 1, 2) for i in range(200)]
    got = running.running_sums(spark.createDataFrame(rows, "k long, i long, x int"), "k", [F.col("i")], {"n": F.lit(1).cast("long")})
    seen = defaultdict(list)
    for r in got.collect():
        seen[r.k].append((r.i, r.n))
    assert {k: len(v) for k, v in seen.items()} == {None: 200, 1: 800, 2: 200}
    for v in seen.values():
        assert [n for _, n in sorted(v, key=lambda x: x[1])] == list(range(1, len(v) + 1)) and [i for i, _ in sorted(v, key=lambda x: x[1])] == sorted(i for i, _ in v)
