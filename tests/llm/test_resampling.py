import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from condense.llm import resampling as rs


def plain_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain_features(text):
    w = plain_words(text)
    return w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def brute_force(documents, target, share=25, least=20):
    """Rows (id, n_features, weight, score, rank) of the contract's rule, one by one."""
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = [0] * 10000, [0] * 10000
    for counts, texts in ((s, [x for _, x in documents]), (t, target)):
        for text in texts:
            for f in plain_features(text):
                counts[bucket(f)] += 1
    big_s, big_t = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((b + 1) * (big_s + 10000) / ((a + 1) * (big_t + 10000)))) for a, b in zip(s, t)]
    rows = []
    for i, text in documents:
        found = plain_features(text)
        weight = math.floor(sum(gain[bucket(f)] for f in found) / len(found)) if found else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(found), weight, score, None, len(plain_words(text)) >= least])
    able = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for n, r in enumerate(able[: share * len(able) // 100], 1):
        r[4] = n
    return [tuple(r[:5]) for r in rows]


def texts(n, seed=3):
    dice = random.Random(seed)
    alphabet = ["red", "Green", "blau", "Éléphant", "naïve", "日本", "x1", "42", "don't", "a_b", "tail"]
    ends = [" ", " ", "\n", "\t", ", ", "\x00", "\x85", "\x1c", "-"]
    return ["".join(dice.choice(alphabet) + dice.choice(ends) for _ in range(dice.randint(0, 60))) for _ in range(n)]


def got_rows(df):
    return [tuple(r[c] for c in ("doc_id", *rs.RESULTS)) for r in df.collect()]


def key(row):
    return (row[0] is None, row[0] or 0, row[4] is None, row[4] or 0)


def test_words_and_hashes():
    for text in texts(200):
        words = [w.decode() for w in rs.words_of(text)]
        assert words == plain_words(text)
        assert sorted(rs.hashes_of(rs.words_of(text))) == sorted(zlib.crc32(f.encode()) for f in plain_features(text))
    three = rs.hashes_of([b"a", b"b", b"c"], 3)
    assert zlib.crc32(b"a b c") in three and len(three) == 6


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(rs, "HELD", 50)
    rows = list(enumerate(texts(400))) + [(1000, None), (1001, "")]
    target = texts(30, 9) + [None]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    want = brute_force(rows, target)
    got = got_rows(rs.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), keep=["doc_id"]))
    assert sorted(got, key=key) == sorted(want, key=key)
    assert sum(r[4] is not None for r in got) > 50


def test_equal_scores_and_repeated_rows_are_spread_and_ranked_once(spark):
    rows = [(i % 3, "one two three " * 10) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = got_rows(rs.resample(df, df.limit(5), keep=["doc_id"]))
    ranks = sorted(r[4] for r in got if r[4] is not None)
    assert len(got) == 600 and ranks == list(range(1, 151))
    best = max(got, key=lambda r: r[3])
    assert all(r[0] == best[0] for r in got if r[4] is not None)


def test_odd_documents(spark, odd_documents, no_documents):
    clash = odd_documents
    for name in ("weight", "rank", "_id", "_row", "_part", "_at", "_able", "_text", "n_features"):
        clash = clash.withColumn(name, F.lit("clash"))
    out = rs.resample(clash, odd_documents)
    rows = out.collect()
    assert len(rows) == 9 and set(clash.columns) == set(out.columns)
    assert all(r["_row"] == "clash" and r["node"] == "clash" for r in rows)
    want = brute_force([(r["doc_id"], r["text"]) for r in odd_documents.collect()], [r["text"] for r in odd_documents.collect()])
    assert sorted((r["weight"], r["score"]) for r in rows) == sorted((w[2], w[3]) for w in want)
    assert rs.resample(no_documents, odd_documents).count() == 0
    plain = rs.resample(odd_documents, no_documents, keep=["doc_id"]).collect()
    assert len(plain) == 9


@pytest.mark.parametrize("wanted, lowest", [(0, None), (1, 9), (3, 9), (4, 5), (6, 2), (99, None)])
def test_cutoff(wanted, lowest):
    assert rs.cutoff([(5, 1), (9, 3), (2, 2)], wanted) == lowest
