import random
import re

import numpy as np
from pyspark.sql import functions as F

from condense.llm import rules, toxicity


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dups = sum(1 for i, x in enumerate(lines) if x in lines[:i])
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dups, len(twice)


def test_counts():
    dice = random.Random(2)
    parts = ["a", "bb", " ", " ", "\n", "\t", "é", "\xa0", "\x1c", "#", "a b c", "\x0b"]
    for _ in range(500):
        text = "".join(dice.choice(parts) for _ in range(dice.randint(0, 40)))
        assert rules.text_counts(text)[:5] == plain_counts(text), repr(text)


def test_statistics_of_odd_documents(odd_documents, no_documents):
    rows = rules.judge(odd_documents, []).collect()
    assert len(rows) == 9
    for r in rows:
        assert tuple(r[c] for c in rules.COUNTS) == (plain_counts(r["text"] or "") if r["doc_id"] != 5 else tuple(r[c] for c in rules.COUNTS))
        assert r["kept"] == (not r["base_failed"])
    assert {r["doc_id"] for r in rows if not r["base_failed"]} <= {5, 6, None}
    assert rules.judge(no_documents, []).count() == 0
    labels = odd_documents.select("doc_id", F.lit(1).alias("quality"))
    assert rules.learn_from(odd_documents, labels) == []
    assert rules.learn_from(no_documents, labels.limit(0)) == []


def test_learned_list_finds_the_planted_rule_and_is_one_expression(spark):
    dice = np.random.default_rng(3)
    n = 3000
    table = {name: dice.random(n) for name in rules.FEATURES}
    bad = (table["symbols_per_word"] >= 0.8) | ((table["upper_share"] >= 0.7) & (table["repeat_share"] < 0.3))
    found = rules.learn(table, bad)
    hit = np.zeros(n, dtype=bool)
    for rule in found:
        hit |= rules._covered(rule, table, np.ones(n, dtype=bool))
    assert (hit & bad).sum() >= 0.97 * bad.sum() and (hit & ~bad).sum() <= 0.03 * hit.sum()
    counts = {c: float(i + 1) for i, c in enumerate(rules.COUNTS + rules.EXTRA)}
    row = spark.range(1).select(*[F.lit(v).alias(c) for c, v in counts.items()])
    values = {k: np.array([counts[a] / (counts[b] if b else 1)]) for k, (a, b) in rules.FEATURES.items()}
    want = not any(rules._covered(r, values, np.array([True]))[0] for r in found)
    assert row.select(rules.verdict(found)).first()[0] == want


def test_nothing_is_learned_from_noise():
    dice = np.random.default_rng(5)
    table = {name: dice.random(900) for name in rules.FEATURES}
    assert rules.learn(table, dice.random(900) < 0.1) == []


def insults(spark, n=600):
    dice = random.Random(7)
    syllables = ["an", "er", "the", "ou", "ing", "st", "re", "on"]
    rows = []
    for i in range(n):
        words = ["".join(dice.choices(syllables, k=dice.randint(1, 4))) for _ in range(dice.randint(20, 80))]
        toxic = int(i % 4 == 0)
        if toxic:
            words[dice.randrange(len(words))] = dice.choice(["grobzaj", "Grobzajka", "vilmut", "VILMUT!"])
        rows.append((i, " ".join(words), toxic))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_toxicity_on_held_out_rows(spark):
    rows = insults(spark)
    model = toxicity.fit(rows.select("doc_id", "text"), rows.filter("doc_id % 3 <> 0").select("doc_id", "toxic"))
    scored = toxicity.score(rows.filter("doc_id % 3 = 0"), model).collect()
    right = sum((r["score"] >= 0.7) == bool(r["toxic"]) for r in scored)
    assert right >= 0.97 * len(scored)
    assert all(0 <= r["score"] <= 1 for r in scored)


def test_presence_ignores_neighbouring_texts():
    alone = [set(toxicity.present([t], None)[1].tolist()) for t in ("abcdef", "", "xyz")]
    which, bucket = toxicity.present(["abcdef", "", "xyz"], None)
    assert [set(bucket[which == i].tolist()) for i in range(3)] == alone


def test_toxicity_of_odd_documents(spark, odd_documents, no_documents):
    labels = odd_documents.select("doc_id", F.lit(0).alias("toxic"))
    model = toxicity.fit(odd_documents, labels)
    scored = toxicity.score(odd_documents, model).collect()
    assert len(scored) == 9 and all(0 <= r["score"] < 0.01 for r in scored)
    assert toxicity.score(no_documents, model).count() == 0
    assert toxicity.fit(no_documents, labels.limit(0)).intercept < -10
