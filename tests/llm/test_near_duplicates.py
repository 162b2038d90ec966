import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from condense.llm import chosen_path, itq
from condense.llm.components import components


class Groups(dict):
    def find(self, x):
        self.setdefault(x, x)
        while self[x] != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


def test_components(spark):
    dice = random.Random(3)
    links = [(dice.randrange(300), dice.randrange(300)) for _ in range(170)] + [(500 + i, 501 + i) for i in range(60)]
    links += [(900, 900 + i) for i in range(1, 40)] + [(7, 7), (None, 3)]
    want = Groups()
    for a, b in links:
        if a is not None and a != b:
            want.join(a, b)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: want.find(n) for n in want}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute_force(rows):
    sets = {i: shingles(t) for i, t in rows}
    groups = Groups()
    ids = sorted(sets)
    for n, i in enumerate(ids):
        groups.find(i)
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                groups.join(i, j)
    return {i: (len(sets[i]), groups.find(i), groups.find(i) == i) for i in ids}


def copies(n_groups=25, seed=5):
    dice = random.Random(seed)
    rows = []
    for _ in range(n_groups):
        words = [f"w{dice.randrange(4000)}" for _ in range(dice.randint(3, 150))]
        for _ in range(dice.randint(1, 12)):
            own = list(words)
            for _ in range(dice.randint(0, max(1, len(words) // 25))):
                own[dice.randrange(len(own))] = f"w{dice.randrange(4000)}"
            rows.append((len(rows), " ".join(own).upper() if dice.random() < 0.2 else "  ".join(own)))
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(spark, monkeypatch, small):
    if small:  # every node branches and every group is cut into blocks
        monkeypatch.setattr(chosen_path, "NODE", 3)
        monkeypatch.setattr(chosen_path, "GROUP_ROWS", 2)
    rows = copies()
    got = chosen_path.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == brute_force(rows)


def test_similarity_at_the_border(spark):
    def text(shared, own, tag):  # a set of shared + own shingles
        return " ".join([f"s{i}" for i in range(shared + 4)] + [f"{tag}{i}" for i in range(own)])

    rows = [(1, text(75, 12, "a")), (2, text(75, 13, "b")), (3, text(750, 126, "c")), (4, text(750, 125, "d"))]
    got = {r[0]: r[2] for r in chosen_path.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: c for i, (_, c, _) in brute_force(rows).items()} == {1: 1, 2: 1, 3: 3, 4: 4}


def test_odd_documents(odd_documents, no_documents):
    got = sorted(map(tuple, chosen_path.near_duplicates(odd_documents).collect()), key=str)
    assert len(got) == 9
    want = {i: v for i, v in brute_force([(r["doc_id"], r["text"]) for r in odd_documents.collect() if r["doc_id"]]).items()}
    assert {g[0]: g[1:] for g in got if g[0] is not None} == want
    assert [g[2:] for g in got if g[0] is None] == [(None, True)]
    assert chosen_path.near_duplicates(no_documents).count() == 0


def test_one_id_with_two_texts(spark):
    a, b = (" ".join(f"{t}{i}" for i in range(40)) for t in "ab")
    df = spark.createDataFrame([(1, a), (5, a), (5, b), (9, b)], "doc_id long, text string")
    assert {(r[0], r[2]) for r in chosen_path.near_duplicates(df).collect()} == {(1, 1), (5, 1), (9, 1)}


def vectors(seed=1, n=220, size=64):
    dice = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        if rows and dice.random() < 0.5:
            v = np.array(rows[dice.integers(len(rows))][1]) + dice.normal(scale=dice.choice([0.0, 0.02, 0.05]), size=size)
        else:
            v = dice.normal(size=size)
        rows.append((i, [float(x) for x in v.astype(np.float32)], int(dice.integers(3))))
    return rows


def cosine_groups(rows, threshold=0.93):
    units = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in rows}
    label, groups, links = {i: c for i, _, c in rows}, Groups(), {i: 0 for i, _, _ in rows}
    for i in units:
        groups.find(i)
        for j in units:
            if j < i and label[i] == label[j] and units[i] @ units[j] >= threshold:
                links[i] += 1
                links[j] += 1
                groups.join(i, j)
    return links, groups


@pytest.mark.parametrize("block", [2000, 4])
def test_vectors_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(itq, "BLOCK", block)
    rows = vectors()
    links, groups = cosine_groups(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r for r in itq.near_duplicates(df).collect()}
    found = sum(r["n_links"] for r in got.values())
    assert 0.97 * sum(links.values()) <= found <= sum(links.values())
    assert all(r["n_links"] <= links[i] for i, r in got.items())
    assert sum(r["component_id"] != groups.find(i) for i, r in got.items()) <= 2


@pytest.mark.parametrize("common", [0.0, 0.5, 0.8])
def test_recall_of_pairs_at_the_threshold(spark, monkeypatch, common):
    """Vectors with a common direction, and partners of 400 of them just over the threshold."""
    monkeypatch.setattr(itq, "BLOCK", 100)
    dice = np.random.default_rng(4)
    x = dice.normal(size=(1200, 64)) * np.sqrt((1 - common) / 64)
    x[:, 0] += np.sqrt(common)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    aside = dice.normal(size=(400, 64))
    aside -= (aside * x[:400]).sum(axis=1, keepdims=True) * x[:400]
    aside /= np.linalg.norm(aside, axis=1, keepdims=True)
    near = 0.932 * x[:400] + np.sqrt(1 - 0.932**2) * aside
    rows = [(i, v.tolist(), 1) for i, v in enumerate(np.concatenate([x, near]))]
    want = sum(cosine_groups(rows)[0].values())
    got = sum(r["n_links"] for r in itq.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert want >= 800 and 0.99 * want <= got <= want


def test_tables_follow_the_vectors():
    dice = np.random.default_rng(7)
    sizes = []
    for common in (0.0, 0.8, 0.95):
        x = dice.normal(size=(3000, 64)) * np.sqrt((1 - common) / 64)
        x[:, 0] += np.sqrt(common)
        sizes.append(itq.fit_tables(x / np.linalg.norm(x, axis=1, keepdims=True), 0.93)[1].shape[1])
    assert 64 <= sizes[0] < sizes[1] <= 64 * itq.ROTATIONS and sizes[2] == 0  # no tables: compared with each other


@pytest.mark.parametrize("block", [2000, 3])
def test_every_length_links_its_own_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(itq, "BLOCK", block)
    rows = [(1, [1.0] * 8, 1), (2, [1.0] * 8, 1), (3, [1.0, 2.0], 1), (4, [1.0, 2.0], 1), (5, [1.0, 2.0], 2), (6, [3.0], 1)]
    rows += [(i, None, 1) for i in range(10, 20)] + [(i, [], 1) for i in range(20, 40)]
    rows += [(40 + i, [2.0 + i, 1.0, -1.0], 3) for i in range(4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in itq.near_duplicates(df).collect()}
    links = {i: g for i, g in got.items() if g[0] and i < 40}
    assert len(got) == len(rows) and links == {1: (1, 1), 2: (1, 1), 3: (1, 3), 4: (1, 3)}
    assert {i: g for i, g in got.items() if i >= 40} == {i: (3, 40) for i in range(40, 44)}


def test_odd_vectors(spark):
    one = [1.0] + [0.5] * 7
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, one, 1), (2, [2 * x for x in one], 1), (3, one, 2), (4, one, None), (5, None, 1), (6, [0.0] * 8, 1),
        (7, [nan] + one[1:], 1), (8, [inf] + one[1:], 1), (9, [None] + one[1:], 1), (10, one[:4], 1), (11, [], 1),
        (2, one, 1), (None, one, 1), (12, [1e-30 * x for x in one], 1), (13, [1e30 * x for x in one], 1),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("n", F.lit("clash"))
    got = itq.near_duplicates(df).collect()
    assert len(got) == len(rows)
    linked = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got if r["n_links"]}
    assert linked == {1: (4, 1), 2: (4, 1), 12: (4, 1), 13: (4, 1)}
    assert itq.near_duplicates(df.limit(0)).count() == 0
    assert itq.near_duplicates(df.filter("vec_id = 5")).collect()[0][1:] == (0, 5, True)


def test_rotation_balances_the_bits():
    dice = np.random.default_rng(2)
    sample = dice.normal(size=(4000, 16)) @ np.diag(np.linspace(0.2, 3, 16)) + 1
    mean, projection = itq.fit_rotation(sample, 16)
    share = ((sample - mean) @ projection >= 0).mean(axis=0)
    assert (abs(share - 0.5) < 0.05).all()
    assert np.allclose(projection.T @ projection, np.eye(16), atol=1e-8)
