import random
import re
from collections import defaultdict
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from condense.llm import quality as ql


def plain_contexts(texts):
    """Context sums by the definition: every token and every other one at most WINDOW places away."""
    places, signs = ql.index_vectors()
    sums, seen = defaultdict(lambda: np.zeros(ql.DIMS, dtype=np.int64)), defaultdict(int)
    for text in texts:
        buckets = [crc32(t.encode()) >> (32 - ql.BITS) for t in re.findall(r"\w+|[^\w\s]+", text or "")]
        for i, b in enumerate(buckets):
            for j in range(max(0, i - ql.WINDOW), min(len(buckets), i + ql.WINDOW + 1)):
                if i != j:
                    seen[b] += 1
                    np.add.at(sums[b], places[buckets[j]], signs[buckets[j]])
    return sums, seen


def sentences(n, seed=2):
    dice = random.Random(seed)
    words = ["alpha", "Beta", "gamma!", "délta", "日本", "x_1", "--", "end."]
    return [" ".join(dice.choices(words, k=dice.randint(0, 40))) for _ in range(n)]


def test_index_vectors_are_sparse_signs():
    places, signs = ql.index_vectors()
    assert all(len(set(row)) == ql.NONZERO for row in places[:-1].tolist())
    assert set(np.unique(signs[:-1])) == {-1, 1} and not signs[-1].any()


def test_context_sums_against_the_definition(spark):
    texts = sentences(120) + [None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    sums, seen = ql.context_sums(df)
    want, want_seen = plain_contexts(texts)
    assert {int(b): int(seen[b]) for b in np.flatnonzero(seen)} == dict(want_seen)
    assert all((sums[b] == v).all() for b, v in want.items())


def test_blocks_of_a_long_text_meet(monkeypatch):
    text = " ".join(sentences(30))
    buckets = ql.Buckets()
    whole = np.concatenate(list(ql.blocks_of(text, buckets)))
    monkeypatch.setattr(ql, "BLOCK", 7)
    assert (np.concatenate(list(ql.blocks_of(text, buckets))) == whole).all()
    once, pieces = ql.Contexts(), ql.Contexts()
    once.add(whole)
    held, known = np.empty(0, dtype=np.int64), 0
    for at in range(0, len(whole), 5):
        held = np.concatenate([held, whole[at : at + 5]])
        pieces.add(held, known)
        held = held[-ql.WINDOW :]
        known = len(held)
    assert (once.sums == pieces.sums).all() and (once.seen == pieces.seen).all()


def test_pooled_features_against_the_definition():
    dice = np.random.default_rng(4)
    vectors = dice.normal(size=(1 << ql.BITS, ql.DIMS)).astype(np.float32)
    texts = sentences(50) + [""]
    got = ql.pooled_features(texts, vectors, ql.Buckets())
    for text, row in zip(texts, got):
        v = np.array([vectors[crc32(t.encode()) >> (32 - ql.BITS)] for t in re.findall(r"\w+|[^\w\s]+", text)], dtype=float)
        n = len(v)
        if not n:
            assert not row.any()
            continue
        near = [(v[k:] * v[:-k]).sum() / n if n > k else 0.0 for k in (1, 2)]
        assert np.allclose(row, [*v.mean(axis=0), *v.std(axis=0), *near, np.log1p(n)], atol=1e-3)


def test_temperature_recovers_the_scale():
    dice = np.random.default_rng(1)
    margin = dice.normal(0, 3, 20_000)
    good = dice.random(20_000) < 1 / (1 + np.exp(-margin))
    assert ql.temperature(margin * 2.5, good) == pytest.approx(2.5, rel=0.1)
    assert ql.temperature(margin, good) == pytest.approx(1.0, rel=0.1)


def corpus(spark, n=900):
    dice = random.Random(7)
    syllables = ["an", "er", "the", "ou", "ing", "st", "re", "on"]
    rows = []
    for i in range(n):
        words = ["".join(dice.choices(syllables, k=dice.randint(1, 4))) for _ in range(dice.randint(20, 80))]
        good = int(i % 5 != 0)
        if not good:
            words = [w + dice.choice(["###", "$$$", "!!"]) for w in words] if i % 2 else [words[0]] * len(words)
        rows.append((i, " ".join(words), good))
    return spark.createDataFrame(rows, "doc_id long, text string, quality int")


def test_held_out_rows_and_calibration(spark):
    rows = corpus(spark)
    labels = rows.filter("doc_id % 3 <> 0").select("doc_id", "quality")
    scored = ql.classify(rows, labels).filter("doc_id % 3 = 0").collect()
    right = sum((r["score"] >= 0.7) == bool(r["quality"]) for r in scored)
    assert right >= 0.97 * len(scored)
    assert all(0 <= r["score"] <= 1 for r in scored)
    assert abs(sum(r["score"] for r in scored) / len(scored) - sum(r["quality"] for r in scored) / len(scored)) < 0.03


def test_labels_never_change_what_is_not_learned(spark):
    rows = corpus(spark, 300)
    taught = rows.filter("doc_id % 4 <> 2").select("doc_id", "quality")
    lied = rows.select("doc_id", F.when(F.col("doc_id") % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")).alias("quality"))
    a = ql.classify(rows, taught, keep=["doc_id"]).collect()
    b = ql.classify(rows, lied.filter("doc_id % 4 <> 2"), keep=["doc_id"]).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_odd_documents(spark, odd_documents, no_documents):
    df = odd_documents
    for name in ("pooled", "_pooled", "k0", "_quality", "dice", "quality", "bucket", "seen"):
        df = df.withColumn(name, F.lit("clash"))
    labels = odd_documents.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    out = ql.classify(df, labels)
    rows = out.collect()
    assert len(rows) == 9 and set(out.columns) == set(df.columns) - {"pooled"}
    assert all(0 <= r["score"] <= 1 and r["seen"] == "clash" for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] == 6}) == 1
    assert ql.classify(no_documents, labels).count() == 0
    one = odd_documents.select("doc_id", F.lit(1).alias("quality"))
    assert all(r["score"] > 0.99 for r in ql.classify(odd_documents, one, keep=["doc_id"]).collect())
    assert all(r["score"] < 0.01 for r in ql.classify(odd_documents, one.limit(0), keep=["doc_id"]).collect())


def test_rows_that_share_a_label_are_bounded(spark):
    df = spark.range(500).select(F.lit(1).cast("long").alias("doc_id"), F.array(*[F.rand(i) for i in range(ql.FEATURES)]).alias("pooled"))
    labels = spark.createDataFrame([(1, 1), (1, 0)], "doc_id long, quality int")
    assert ql.fit(df, labels, max_rows=100).centre.shape == (ql.FEATURES,)
