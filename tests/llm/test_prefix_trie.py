import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from condense.llm import prefix_trie as pt
from condense.session import written

NAMES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def rebuilt(convs):
    """The contract's rule on {conv_id: [(role, text), ...]}."""
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(c - 100 * int(c / 100))
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def brute_force(convs):
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    rows = []
    for node, members in nodes.items():
        d = len(node)
        under = [n for n in nodes if n[:d] == node]
        inner = {n[:-1] for n in nodes if n}
        ends = sorted(c for c in members if len(convs[c]) == d)
        rows.append((
            min(members), d, min(nodes[node[:-1]]) if d else None, len(members),
            sum(len(n) == d + 1 for n in under), sum(n not in inner for n in under),
            sum((len(nodes[n]) - 1) * len(n[-1][1]) for n in under if n),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(rows, key=repr)


def table(spark, convs):
    rows = [(c, i, role, text) for c, turns in convs.items() for i, (role, text) in enumerate(turns)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)


def got_rows(df):
    return sorted((tuple(r[c] for c in NAMES) for r in df.collect()), key=repr)


def dialogues(n, seed, said=("a", "bb", "é😀", "")):
    dice = random.Random(seed)
    turn = lambda i: (("user", "assistant")[i % 2], dice.choice(said))
    return {c * 7 % 1009 - 20: [turn(i) for i in range(dice.randint(1, 7))] for c in range(n)}


@pytest.mark.parametrize("chunk", [1, 2, 5, 64, 20_000])
def test_against_brute_force(spark, chunk):
    convs = dialogues(150, chunk)
    assert got_rows(pt.trie(pt.conversations(table(spark, convs)), chunk_rows=chunk)) == brute_force(convs)


def test_grafted_heads(spark):
    convs = dialogues(300, 4, ("a", "b", "c", "d"))
    plain = written(pt.conversations(table(spark, convs)), "t")
    base = F.col("conv_id") - F.col("conv_id") % 100
    got = pt.graft(plain, base, F.crc32(F.col("conv_id").cast("string")) % 6, 5)
    want = rebuilt(convs)
    assert {r["conv_id"]: len(r["turns"]) for r in got.collect()} == {c: len(t) for c, t in want.items()}
    assert got_rows(pt.trie(got, chunk_rows=16)) == brute_force(want)


def test_copies_over_many_chunks_are_one_path(spark):
    same = [("user", "hello"), ("assistant", "you said")]
    convs = {c: same if c % 3 else [("user", str(c))] for c in range(2000)}
    assert got_rows(pt.trie(pt.conversations(table(spark, convs)), chunk_rows=50)) == brute_force(convs)


def test_odd_turns(spark):
    rows = [
        (1, None, "user", "first"), (1, 0, None, None), (1, 0, None, None), (1, 2, "a", "x" * 300_000),
        (None, 0, "user", "nobody's"), (2, None, "user", "first"), (2, 5, "", ""), (3, 1, "use", "rfirst"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for name in ("node", "part", "path", "digest", "turns", "_base", "kind"):
        df = df.withColumn(name, F.lit("clash"))
    empty = ("", "")
    want = {1: [("user", "first"), empty, empty, ("a", "x" * 300_000)], 2: [("user", "first"), empty], 3: [("use", "rfirst")]}
    assert got_rows(pt.trie(pt.conversations(df))) == brute_force(want)
    assert pt.trie(pt.conversations(df.limit(0))).count() == 0


def test_only_conversations_without_turns(spark):
    none = spark.createDataFrame([(4, []), (2, [])], "conv_id long, turns array<struct<digest:string,chars:long>>")
    assert got_rows(pt.trie(none)) == brute_force({4: [], 2: []})


def test_extents_of_every_prefix():
    dice = random.Random(5)
    paths = sorted(b"".join(bytes([dice.randint(0, 1)]) * pt.WIDTH for _ in range(dice.randint(0, 6))) for _ in range(90))
    chunk = pt.Chunk(np.arange(90), paths, [np.ones(len(p) // pt.WIDTH, dtype=np.int64) for p in paths])
    for i, path in enumerate(paths):
        for d in range(len(path) // pt.WIDTH + 1):
            left, right = chunk.extents(np.array([i]), np.array([d]))
            members = [j for j, p in enumerate(paths) if len(p) >= d * pt.WIDTH and p[: d * pt.WIDTH] == path[: d * pt.WIDTH]]
            assert (left[0], right[0]) == (members[0], members[-1])
