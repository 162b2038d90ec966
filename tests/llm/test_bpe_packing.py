import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

import public_tokenizers
from condense.llm import bpe, packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
KNOWN = bpe.vocabulary(bpe.read_vocabulary(PATH))
LIBRARY = Tokenizer.from_file(PATH)
LIBRARY.no_truncation()
LIBRARY.no_padding()

PARTS = [" ", "  ", "\n", "\t", "a", "the", "ing", "'s", "'ll", "12", "é", "日本", "😀", "\x1c", "\x85", "\xa0", "²", "_", "-.", "<|endoftext|>", "<|end", "aaaa"]


def as_ids(data):
    return np.frombuffer(data, dtype="<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.lists(st.sampled_from(PARTS), max_size=14).map("".join)))
def test_encoding_is_that_of_the_library(text):
    text = text.encode("utf-8", "ignore").decode()
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    got = KNOWN.encode(text)
    assert as_ids(got) == want
    assert KNOWN.decode(got) == LIBRARY.decode(want, skip_special_tokens=False) == text


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 3000, "0" * 3000, "=" * 999, "é" * 2000])
def test_one_long_piece(text):
    assert as_ids(KNOWN.encode(text)) == LIBRARY.encode(text, add_special_tokens=False).ids


def test_every_token_encodes_to_itself_and_memory_is_bounded():
    for i in random.Random(1).sample(range(50_000), 500):
        text = KNOWN.bytes[i].decode("utf-8", "ignore")
        if text.encode() == KNOWN.bytes[i] and len(KNOWN.split_pieces(text)) == 1:
            assert as_ids(KNOWN.encode(text)) == [i]


def test_encode_and_decode_tables(odd_documents, no_documents):
    rows = bpe.decode(bpe.encode(odd_documents, PATH), PATH, text="back").collect()
    assert len(rows) == 9
    for r in rows:
        assert r["back"] == (r["text"] or "")
        assert as_ids(r["ids"]) == LIBRARY.encode(r["text"] or "", add_special_tokens=False).ids
    assert bpe.encode(no_documents, PATH).count() == 0


def check_packing(rows, documents, limit):
    sequences, pieces = {}, {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= limit
    got = sorted(p for own in pieces.values() for p in own)
    want = []
    for text in documents:
        ids = LIBRARY.encode(text or "", add_special_tokens=False).ids + [0]
        first = (len(ids) - 1) % limit + 1
        for n, start in enumerate([0, *range(first, len(ids), limit)]):
            own = ids[start : first if n == 0 else start + limit]
            want.append((n, start, len(own), zlib.crc32(np.array(own, dtype="<u4").tobytes())))
    assert got == sorted(want)
    return len(sequences)


def test_pack_odd_documents(odd_documents, no_documents):
    rows = packing.pack(odd_documents, PATH).collect()
    check_packing(rows, [r["text"] for r in odd_documents.collect()], 2048)
    assert packing.pack(no_documents, PATH).count() == 0


@pytest.mark.parametrize("blank", [" ", "\n", "\t ", "\u3000"])
def test_long_runs_of_blanks(spark, blank):
    texts = ["a" + blank * (2_000_000 // len(blank)) + "b c", blank * 3_000, "x " + blank * 1_999 + "y", "z" * 300_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check_packing(packing.pack(df, PATH).collect(), texts, 2048)


def test_pack_carries_columns_with_inner_names(odd_documents):
    names = ["doc_id", "_part", "_number", "_key", "_k0", "_text", "length"]
    rows = packing.pack(odd_documents, PATH, keep=names).collect()
    assert all(r["_part"] == r["_number"] == r["_key"] == r["_k0"] == "clash" and r["length"] != "clash" for r in rows)


def test_pack_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(packing, "ROWS_PER_TASK", 25)
    dice = random.Random(4)
    texts = [" x" * dice.choice([7, 7, 7, dice.randint(1, 60), 64, 200]) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = packing.pack(df, PATH, limit=64).collect()
    used = check_packing(rows, texts, 64)
    assert used <= 1.03 * sum(r["length"] for r in rows) / 64 + 1


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 63), st.integers(1, 40), max_size=20))
def test_plan_gives_every_number_one_place(counts):
    matches = packing.plan(counts, 64)
    given_numbers = sorted((size, lo + k) for size, lo, n, _, _ in matches for k in range(n))
    assert given_numbers == sorted((s, k) for s, n in counts.items() for k in range(n))
    held = {}
    for size, _, n, first, offset in matches:
        for k in range(n):
            held.setdefault(first + k, []).append((offset, size))
    for spans in held.values():
        at = 0
        for offset, size in sorted(spans):
            assert offset == at
            at += size
        assert at <= 64
