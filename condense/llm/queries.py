"""The queries over the test tables, one for each operator of this package."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from condense.llm import (
    bpe,
    chat,
    chosen_path,
    itq,
    licenses,
    oracles,
    packing,
    pii,
    prefix_trie,
    quality,
    resampling,
    rules,
    toxicity,
    warc,
)
from condense.session import shared_dir, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = dict(oracles.ORACLES)

TOKENIZER = "byte_bpe_50k.json"


def query(call: Callable[[SparkSession, str], DataFrame]):
    QUERIES[call.__name__] = call
    return call


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(TOKENIZER)
    ids = bpe.encode(read(spark, sf_dir, "documents"), path, keep=["doc_id"])
    measured = ids.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        "ids",
    )
    back = bpe.decode(measured, path, text="decoded", keep=["doc_id", "n_tokens", "ids_sha256"])
    return back.select(
        "doc_id", "n_tokens", "ids_sha256", F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256")
    )


@query
def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), limit=2048, end_id=0)


@query
def op4_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    found = rules.learn_from(documents, read(spark, sf_dir, "labels"))
    return rules.judge(documents, found, keep=["doc_id"]).select("doc_id", *rules.COUNTS, "base_failed", "kept")


def held_out() -> Column:
    """The fold that nothing is learned from."""
    return F.crc32(F.col("doc_id").cast("string")) % 3 == 1


TOXIC_FROM = 0.7


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    model = toxicity.fit(documents, read(spark, sf_dir, "labels").filter(~held_out()))
    scored = toxicity.score(documents, model, keep=["doc_id"])
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted")
    )


@query
def op10_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op6_itq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.near_duplicates(read(spark, sf_dir, "embeddings"), threshold=0.93)


@query
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "warc")
    # small enough that most pages lie in several segments and chunks
    warc.write(read(spark, sf_dir, "pages"), path, least_bytes=0, segment_bytes=1024, chunk_bytes=512)
    pages = warc.reassemble(warc.read_records(spark, path)).select(
        warc.page_of("record").alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        F.col("kind").alias("record_type"),
        warc.page_of("refers").alias("refers_to"),
    )
    pages = written(pages, "warc-pages")
    full = pages.filter(F.col("record_type") == "response").groupBy(F.col("page_id").alias("refers_to"), "payload_digest")
    sizes = full.agg(F.max("payload_bytes").alias("_bytes"))
    # a revisit has the payload of the record it refers to
    resolved = pages.join(sizes, ["refers_to", "payload_digest"], "left")
    return resolved.select(
        "page_id",
        F.coalesce("payload_bytes", "_bytes").alias("payload_bytes"),
        "payload_digest",
        "record_type",
        "refers_to",
    )



@query
def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    tricky = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    given = read(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text"
    )
    rows = given.unionByName(spark.createDataFrame(tricky, "conv_id long, turn long, role string, text string"))
    chats = written(chat.format_chats(rows), "chats")
    back = chats.select("conv_id", "formatted", chat.read_back().alias("turns"), chat.learned_text().alias("learned"))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(F.array_join(lines, ""), "UTF-8"), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.encode("learned", "UTF-8"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query
def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    found = pii.find(documents, pii.fit(documents), keep=["doc_id"])
    return found.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans"
    )


STATEMENT = r"(?i)licen[sc]ed? under|under the .{0,60}licen[sc]e|released under|all rights reserved|public domain|permission is hereby"


def placed(documents: DataFrame) -> DataFrame:
    """The documents have no paths; a tree that is made from their rows gives them some.

    A source has directories of two levels; about a tenth of all files lies in one
    directory, an eighth in loose directories outside the sources. A document that
    says something of a licence is the licence file of its leaf, of the directory above or
    of the source, or a file as others.
    """
    dice = F.xxhash64("doc_id")
    block = lambda n: (F.col("doc_id") / n).cast("long").cast("string")
    top, middle, leaf = F.coalesce("source", F.lit("none")), F.concat(F.lit("m"), block(2000)), F.concat(F.lit("l"), block(200))
    hot, loose = F.pmod(dice, F.lit(10)) == 0, F.pmod(dice, F.lit(8)) == 1
    level = F.when(F.col("text").rlike(STATEMENT), F.pmod(F.shiftright(dice, 8), F.lit(16)))
    folder = (
        F.when(loose, F.concat_ws("/", F.lit("loose"), leaf))
        .when(level == 0, top)
        .when(level < 4, F.concat_ws("/", top, middle))
        .when(hot, F.lit("shared/all"))
        .otherwise(F.concat_ws("/", top, middle, leaf))
    )
    name = F.when(level < 8, F.concat(F.lit("LICENSE-"), "doc_id")).otherwise(F.concat("doc_id", F.lit(".txt")))
    return documents.select("doc_id", F.concat_ws("/", folder, name).alias("path"), "text")


@query
def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = placed(read(spark, sf_dir, "documents"))
    return licenses.inherit(licenses.scan(files, keep=["doc_id"])).select(
        "doc_id", "own", "cosine", "licence", "licence_from"
    )


GOOD_FROM = 0.7


@query
def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    apart = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    labels = read(spark, sf_dir, "labels").filter(~apart)
    scored = quality.classify(read(spark, sf_dir, "documents"), labels, keep=["doc_id"])
    return scored.select(
        "doc_id", apart.alias("held_out"), "score", (F.col("score") >= GOOD_FROM).cast("int").alias("predicted")
    )


@query
def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), keep=["doc_id"])


@query
def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = written(prefix_trie.conversations(read(spark, sf_dir, "conversations")), "conversations")
    conv = F.col("conv_id")
    return prefix_trie.trie(prefix_trie.graft(convs, conv - conv % 100, F.crc32(conv.cast("string")) % 6, 5))
