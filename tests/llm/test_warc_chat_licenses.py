import base64
import hashlib
import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from condense.llm import chat, licenses, warc
from condense.session import shared_dir


def test_chunked_framing():
    for size in (0, 1, 5, 6, 1000):
        payload = random.Random(size).randbytes(size)
        assert warc.unchunked(warc.chunked(payload, 5)) == payload
    for broken in (b"", b"5\r\nabc", b"zz\r\n", b"3\r\nabcX\r\n0\r\n\r\n"):
        with pytest.raises(ValueError):
            warc.unchunked(broken)


def pages(spark):
    payloads = [
        "", None, "plain", "plain", "a\r\n\r\nb", "\r\n\r\n", "\r\r\n\r\n\r\r\n\r\n", "WARC/1.1\r\nContent-Length: 5\r\n\r\nxx\r\n\r\n",
        "é" * 500, "日本語" * 400, "x" * 5000, "x" * 5000, "0\r\n\r\n", "﻿bom", "\x00\x01",
    ]
    rows = [(i + 10, f"http://h/{i}\r\nX: y", p) for i, p in enumerate(payloads)] + [(None, None, "plain"), (12, "again", "plain")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return df.withColumn("record", F.lit("clash")).withColumn("payload", F.lit("clash"))


@pytest.mark.parametrize("segment", [64, 700, 1 << 20])
def test_archive_gives_pages_back(spark, segment):
    path = shared_dir(spark, "warc-test")
    df = pages(spark)
    warc.write(df.repartition(3), path, segment_bytes=segment)
    records = warc.read_records(spark, path)
    got = warc.reassemble(records).withColumn("page", warc.page_of("record")).collect()
    assert len(got) == df.count() and all(r["error"] is None for r in got)
    by_page = {r["page_id"]: (r["html"] or "").encode() for r in df.collect()}
    for r in got:
        want = by_page[r["page"]]
        assert r["digest"] == base64.b32encode(hashlib.sha1(want).digest()).decode()
        if r["kind"] == "response":
            assert r["payload"] == want
        else:
            assert r["payload"] is None and by_page[int(r["refers"].split(":")[-1])] == want
    kinds = sorted((r["page"] or -1, r["kind"]) for r in got if by_page[r["page"]] == b"plain")
    assert kinds == [(-1, "response"), (12, "response"), (12, "response"), (13, "revisit")]
    if segment == 64:
        assert records.filter("kind = 'continuation'").count() > 50
        lost = warc.reassemble(records.filter("number is null or number <> 2")).filter("error is not null")
        assert {r["error"] for r in lost.collect()} == {"segments missing"}
        short = records.withColumn("block", F.when(F.col("number") == 2, F.substring("block", 1, 9)).otherwise(F.col("block")))
        assert "total length differs" in {r["error"] for r in warc.reassemble(short).collect()}


def test_least_bytes_and_empty_archive(spark):
    path = shared_dir(spark, "warc-test")
    warc.write(pages(spark), path, least_bytes=100)
    kinds = warc.reassemble(warc.read_records(spark, path)).groupBy("kind").count().collect()
    assert {r["kind"]: r["count"] for r in kinds}["revisit"] == 1
    empty = shared_dir(spark, "warc-test")
    warc.write(pages(spark).limit(0), empty)
    assert warc.reassemble(warc.read_records(spark, empty)).count() == 0


def test_damaged_files_are_reported_and_reading_goes_on():
    good = [b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1:a>\r\nContent-Length: 3", b"abc"]
    for broken, error in (
        ([b"no record"], "no head"),
        ([b"WARC/1.1\r\nWARC-Type: x\r\nContent-Length: 3", b"abc"], "no head"),
        ([b"WARC/1.1\r\nWARC-Type: x\r\nWARC-Record-ID: <a>\r\nContent-Length: -3", b"abc"], "no head"),
        ([b"WARC/1.1\r\nWARC-Type: x\r\nWARC-Record-ID: <a>\r\nContent-Length: 3", b"abcdef"], "ends inside"),
        ([b"WARC/1.1\r\nWARC-Type: x\r\nWARC-Record-ID: <a>\r\nContent-Length: 9", b"abc"], "ends inside"),
    ):
        got = list(warc.parse([*good, *broken, *good]))
        assert [r[1] for r in got] == ["response", "damaged", "response"], (broken, got)
        assert error in got[1][-1] and got[0][-2] == got[2][-2] == b"abc"
    cut = list(warc.parse([*good, good[0].replace(b": 3", b": 30"), b"abc"]))
    assert [r[1] for r in cut] == ["response", "damaged"] and "cut short" in cut[1][-1]


def test_blocks_may_be_cut_within_line_ends():
    for segment in range(1, 140):
        for payload in (b"x" * 400, b"\r\n" * 90, b"a\r\n\r\n\r" * 40, b""):
            made = [v for n in range(2) for _, v in warc.page_records(str(n), 7, "u", payload, None, segment, 37)]
            got = list(warc.parse((warc.BREAK.join(made) + warc.BREAK).split(warc.BREAK)))
            assert [r[1] for r in got].count("damaged") == 0 and len(got) == len(made)
            block = warc.HTTP + warc.chunked(payload, 37)
            for n in range(2):
                assert b"".join(r[-2] for r in got if r[0] == f"urn:page:7:{n}") == block


def test_damaged_archive_is_read(spark, tmp_path):
    df = pages(spark)
    path = shared_dir(spark, "warc-test")
    warc.write(df.repartition(2), path, segment_bytes=700)
    lines = spark.read.option("lineSep", "\r\n\r\n").text(path)
    torn = lines.filter(~F.col("value").rlike("(?s)WARC-Segment-Number: 2"))  # heads gone, their blocks left behind
    again = shared_dir(spark, "warc-test")
    torn.select("value").coalesce(1).write.option("lineSep", "\r\n\r\n").text(again)
    rows = warc.reassemble(warc.read_records(spark, again)).collect()
    assert any(r["kind"] == "damaged" for r in rows) and any(r["error"] is None and r["payload"] == b"plain" for r in rows)


def test_swapped_segments_and_files(spark):
    df = pages(spark)
    path = shared_dir(spark, "warc-test")
    warc.write(df.repartition(2), path, segment_bytes=256, chunk_bytes=100)
    records = warc.read_records(spark, path)
    files = spark.read.option("lineSep", "\r\n\r\n").text(path).filter("value like '%WARC-Record-ID%'").select(
        F.regexp_extract("value", "urn:page:([0-9]*):", 1).alias("page"), F.input_file_name().alias("file")
    )
    assert files.groupBy("page").agg(F.countDistinct("file").alias("n")).agg(F.max("n")).first()[0] == 1 + warc.SLOTS
    swapped = records.withColumn("number", F.when(F.col("number") == 2, 3).when(F.col("number") == 3, 2).otherwise(F.col("number")))
    long = records.filter("number >= 3").select("record").distinct().count()
    broken = warc.reassemble(swapped).filter("error is not null").count()
    assert long > 2 and broken >= long - 1  # equal neighbours may change places unnoticed


def test_most_pages_of_the_query_are_segmented(spark):
    path = shared_dir(spark, "warc-test")
    warc.write(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"), path, segment_bytes=1024, chunk_bytes=512)
    records = warc.read_records(spark, path)
    whole = records.filter("kind = 'response'")
    assert 2 * records.filter("number = 2").count() > whole.count()


def test_map_of_digests_has_all_that_repeat(spark):
    digests = spark.range(500).select(F.sha1(F.col("id").cast("string").cast("binary")).alias("sha1"))
    held = warc.marks(digests.limit(200))
    assert digests.limit(200).filter(~warc.may_repeat(F.col("sha1"), held)).count() == 0
    assert digests.filter(warc.may_repeat(F.col("sha1"), held)).count() < 260


def rows_of(spark, turns):
    return spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")


def round_trip(spark, turns):
    formatted = chat.format_chats(rows_of(spark, turns))
    back = formatted.select("conv_id", "formatted", "loss_spans", chat.read_back().alias("turns"), chat.learned_text().alias("learned"))
    return {r["conv_id"]: r for r in back.collect()}


HARD = ["", " ", "\n", "<", "[", "\\", "</s>", "<s>", "<\\/s>", "[INST]", " [/INST]", "[/INST]", "<<SYS>>", "\n<</SYS>>\n\n", "[NEXT]", "[ROLE]", "[/ROLE]", "[/TURN]", "<</s>", "<<<s>", "a", "é😀", "$1", "[\\NEXT]"]
ROLES = ["user", "assistant", "system", "tool", "", None, "[/ROLE]", "user "]


def test_turns_and_loss_come_back(spark):
    dice = random.Random(6)
    turns = []
    for conversation in range(400):
        for turn in range(dice.randint(1, 7)):
            text = None if dice.random() < 0.05 else "".join(dice.choice(HARD) for _ in range(dice.randint(0, 5)))
            turns.append((conversation, turn, dice.choice(ROLES[:2] if dice.random() < 0.6 else ROLES), text))
    shuffled = list(turns)
    dice.shuffle(shuffled)
    got = round_trip(spark, shuffled)
    for conversation in range(400):
        own = [(r or "", t or "") for c, _, r, t in turns if c == conversation]
        assert [tuple(t) for t in got[conversation]["turns"]] == own
        assert got[conversation]["learned"] == "".join(t for r, t in own if r == "assistant")
        spans = [tuple(s) for s in got[conversation]["loss_spans"]]
        assert spans == sorted(spans) and len(spans) == sum(r == "assistant" for r, _ in own)


def test_merging_and_defined_orders(spark):
    got = round_trip(spark, [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "system", "s"), (None, 1, "user", "x"), (1, 9, "assistant", "y")])
    assert got[1]["formatted"] == "<<SYS>>\ns\n<</SYS>>\n\n<s>[INST] a[NEXT]a[NEXT]b [/INST] y</s>"
    assert [tuple(t) for t in got[None]["turns"]] == [("user", "x")]
    assert chat.format_chats(rows_of(spark, [])).count() == 0


def test_escaping_is_reversible(spark):
    dice = random.Random(8)
    texts = ["".join(dice.choice(HARD) for _ in range(dice.randint(0, 8))) for _ in range(2000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"))
    for r in df.select("t", "e", chat.unescape(F.col("e")).alias("b")).collect():
        assert r["b"] == r["t"]
        assert not any(c in r["e"] for c in ("</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[NEXT]", "[/TURN]"))


def test_licences_own_and_inherited(spark):
    filler = "some code here\n" * 5
    rows = [
        ("repo/LICENSE", "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", 1),
        ("repo/src/a.py", filler + "print(1)", 2),
        ("repo/src/deep/er/b.py", filler, 3),
        ("repo/vendor/COPYING", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", 4),
        ("repo/vendor/x/c.c", filler, 5),
        ("repo/vendor/x/d.c", filler + "# Licensed under the Apache License, Version 2.0.\n", 6),
        ("other/e.c", filler, 7),
        ("top.txt", None, 8),
        (None, filler, 9),
        ("repository/f.c", filler, 10),
        ("repo/src/a.py", filler + "print(1)", 11),
        ("repo/n.txt", "a licence to say nothing of this at all, whatever the weather " * 3, 12),
    ]
    df = spark.createDataFrame(rows, "path string, text string, n long").withColumn("own", F.lit("clash"))
    out = licenses.inherit(licenses.scan(df, keep=["n", "own"])).collect()
    got = {r["n"]: (r["own"], r["licence"], r["licence_from"]) for r in out}
    assert got == {
        1: ("MIT", "MIT", "repo/LICENSE"), 2: (None, "MIT", "repo/LICENSE"), 3: (None, "MIT", "repo/LICENSE"),
        4: ("GPL-3.0", "GPL-3.0", "repo/vendor/COPYING"), 5: (None, "GPL-3.0", "repo/vendor/COPYING"),
        6: ("Apache-2.0", "Apache-2.0", "repo/vendor/x/d.c"), 7: (None, None, None), 8: (None, None, None),
        9: (None, None, None), 10: (None, None, None), 11: (None, "MIT", "repo/LICENSE"), 12: (None, "MIT", "repo/LICENSE"),
    }
    assert licenses.inherit(licenses.scan(df.limit(0))).count() == 0


def commented(text, marker):
    return "\n".join(f"{marker} {line}".rstrip() for line in text.split("\n"))


GNU = """Frob - a tool for frobbing
Copyright (C) 2019  Jane Roe

This program is free software{colon} you can redistribute it and/or modify
it under the terms of the GNU {kind}General Public License as published by
the Free Software Foundation{comma} either version {version} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU {kind}General Public License for more details.

You should have received a copy of the GNU {kind}General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>."""
BSD = """Copyright (c) 2012, The Frob Authors
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
    * Redistributions of source code must retain the above copyright
      notice, this list of conditions and the following disclaimer.
    * Redistributions in binary form must reproduce the above copyright
      notice, this list of conditions and the following disclaimer in the
      documentation and/or other materials provided with the distribution.
{third}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND
ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""
THIRD = """    * Neither the name of the Frob project nor the
      names of its contributors may be used to endorse or promote products
      derived from this software without specific prior written permission.
"""
HEADERS = {
    "gpl3.c": ("GPL-3.0", commented(GNU.format(kind="", version=3, colon=":", comma=","), " *")),
    "gpl2.py": ("GPL-2.0", commented(GNU.format(kind="", version=2, colon=";", comma=";"), "#")),
    "lgpl3.cc": ("LGPL-3.0", commented(GNU.format(kind="Lesser ", version=3, colon=":", comma=","), "//")),
    "lgpl21.h": ("LGPL-2.1", commented(GNU.format(kind="Lesser ", version="2.1", colon=";", comma=";"), " *")),
    "agpl.js": ("AGPL-3.0", commented(GNU.format(kind="Affero ", version=3, colon=":", comma=","), "//")),
    "apache.java": ("Apache-2.0", commented("""Copyright 2020 The Frob Authors

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    https://www.apache.org/licenses/LICENSE-2.0""", " *")),
    "bsd2.c": ("BSD-2-Clause", commented(BSD.format(third=""), " *")),
    "bsd3.c": ("BSD-3-Clause", commented(BSD.format(third=THIRD), " *")),
    "isc.c": ("ISC", commented("""Copyright (c) 2004 Jane Roe <jane@example.org>

Permission to use, copy, modify, and distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.""", " *")),
    "mit.ts": ("MIT", commented("""Copyright (c) 2018 Jane Roe

Permission is hereby granted, free of charge, to any person obtaining a
copy of this software and associated documentation files (the "Software"),
to deal in the Software without restriction.""", " *")),
    "mpl.rs": ("MPL-2.0", commented("""This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http://mozilla.org/MPL/2.0/.""", "//")),
    "tag.py": ("MIT", "# SPDX-License-Identifier: MIT"),
    "tag.go": ("Apache-2.0", "// SPDX-License-Identifier: Apache-2.0"),
    "tag.c": ("GPL-2.0", "/* SPDX-License-Identifier: GPL-2.0-only */"),
    "unknown.c": (None, "/* SPDX-License-Identifier: Zlib */"),
    "choice.c": (None, "/* SPDX-License-Identifier: MIT OR Apache-2.0 */"),
    "prose.md": (None, "The driver showed his licence to the officer and asked for permission to leave.\nNobody would use the road in the rain."),
}


@pytest.mark.parametrize("as_file", [False, True])
def test_real_headers(spark, as_file):
    code = "\n\nint main(void) {\n    return 0;\n}\n" * 3
    rows = [(f"{name}/LICENSE", text) if as_file else (name, text + code) for name, (_, text) in HEADERS.items()]
    found = licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect()
    got = {r["path"].split("/")[0]: r["own"] for r in found}
    assert got == {name: own for name, (own, _) in HEADERS.items()}


def test_files_of_a_hot_directory_meet_their_licence_in_parts(spark):
    files = spark.range(20_000).select(
        F.concat(F.lit("a/hot/f"), F.col("id").cast("string")).alias("path"), F.lit(None).cast("string").alias("own"), F.lit(0.0).alias("cosine")
    )
    given = spark.createDataFrame([("a/LICENSE", "MIT", 1.0)], "path string, own string, cosine double")
    out = licenses.inherit(files.unionByName(given))
    assert out.where("licence = 'MIT' and licence_from = 'a/LICENSE'").count() == 20_001
    parts = files.groupBy(F.pmod(F.xxhash64("path"), F.lit(licenses.PARTS))).count()
    assert parts.agg(F.max("count")).first()[0] < 20_000 / licenses.PARTS * 1.3


def test_cosine_against_a_dense_statement():
    # no word is in more files than there are
    idf, other = licenses.weights(100, {i: i % 100 for i in range(len(licenses.VOCABULARY))})
    text = "Licensed under the Apache License, Version 2.0 of zzz zzz"

    def dense(value):
        words = licenses.terms_of(value)
        return {w: words.count(w) * (idf[licenses.VOCABULARY.index(w)] if w in licenses.VOCABULARY else other) for w in words}

    a, b = dense(text), dense(licenses.TEMPLATES[0][1])
    size = lambda v: sum(x * x for x in v.values()) ** 0.5
    want = sum(a[w] * b.get(w, 0) for w in a) / size(a) / size(b)
    templates = [(n, licenses.vector(t, idf, other)) for n, t in licenses.TEMPLATES[:1]]
    name, got = licenses.best_match([text], idf, other, templates)
    assert name == "Apache-2.0" and abs(got - want) < 1e-8
