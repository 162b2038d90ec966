"""The queries of this package against their SQL, and the pipeline against brute force, on the smallest tables."""

import os

import pytest
from check_queries import compare, duck
from pyspark.sql import functions as F

import corpus_pipeline
from condense.llm import pii
from condense.llm.queries import ORACLES, QUERIES
from test_near_duplicates import brute_force
from test_rules_toxicity import plain_counts

SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")


def test_one_query_per_operator():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF_DIR)
    if name in ORACLES:
        assert compare(df, duck(SF_DIR), ORACLES[name]) is None
    else:
        table = {"op9_chat": "conversations"}.get(name, "documents")
        ids = {r[0] for r in spark.read.parquet(f"{SF_DIR}/{table}.parquet").select("doc_id").collect()}
        assert {r["doc_id"] for r in df.collect()} == ids


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:4]:
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = spark.createDataFrame(stage(spark, docs, SF_DIR).collect(), docs.schema)
        after = {r["doc_id"]: r for r in docs.collect()}
        assert docs.columns == columns and set(after) <= set(before)
        if name == "quality rules":
            for i in set(before) - set(after):
                n, _, symbols, _, repeated = plain_counts(before[i]["text"] or "")
                assert n < 50 or 2 * repeated > n or symbols > 0.1 * n
        if name == "near copies":
            want = brute_force([(i, r["text"]) for i, r in before.items()])
            assert set(after) == {i for i, (_, _, kept) in want.items() if kept}
        if name == "personal data":
            assert set(after) == set(before)
            for i, r in after.items():
                assert not pii.base_spans(r["text"]) and r["n_chars"] == len(r["text"])
        else:
            assert all(after[i] == before[i] for i in after)
    pieces = corpus_pipeline.STAGES[4][1](spark, docs, SF_DIR)
    assert {r["doc_id"] for r in pieces.collect()} == {r["doc_id"] for r in docs.collect()}
    assert corpus_pipeline.run(spark, SF_DIR).count() == pieces.count()


ODD = [
    (None, None), (1, None), (2, ""), (3, "one two three"), (3, "one two three"), (4, " ".join(f"word{i}" for i in range(70))),
    (4, " ".join(f"other{i}" for i in range(70))), (9, " ".join(f"word{i}" for i in range(70))), (None, "write to a.b@c.de " * 3),
]


def odd_table(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    extra = {"lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long")}
    return df.select("*", *[v.alias(k) for k, v in extra.items()], F.lit("clash").alias("_n"), F.lit("clash").alias("score"))


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_odd_and_empty_tables(spark, name, stage):
    odd = odd_table(spark, ODD)
    rows = stage(spark, odd, SF_DIR).collect()
    texts = [(r["doc_id"], r["text"]) for r in rows] if name != "packing" else None
    if name == "near copies":
        assert sorted(texts, key=repr) == sorted([ODD[0], ODD[1], ODD[2], ODD[3], ODD[5], ODD[6], ODD[8]], key=repr)
    elif name == "quality rules":
        assert sorted(texts) == sorted([ODD[5], ODD[6], ODD[7]])
    elif name == "packing":
        assert len(rows) == len(ODD)
    else:
        assert len(texts) == len(ODD)
    assert stage(spark, odd.limit(0), SF_DIR).count() == 0


def test_licences_are_inherited_from_several_levels(spark):
    rows = QUERIES["op8_licenses"](spark, SF_DIR.replace("sf0.001", "sf0.01")).collect()
    taken = [r for r in rows if r["own"] is None and r["licence"]]
    levels = {r["licence_from"].count("/") for r in taken}
    assert len(taken) > 0.2 * len(rows) and len(levels) > 1, (len(taken), len(rows), levels)
