import random
import re

import pytest
from pyspark.sql import functions as F

from condense.llm import pii

K = pii.KINDS


def plain_spans(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), m.end(), 0))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append((m.start(), m.end(), 1))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub(r"[^0-9]", "", m.group())
        checked = sum(int(d) if i % 2 == 0 else sum(map(int, str(2 * int(d)))) for i, d in enumerate(digits[::-1]))
        if 12 <= len(digits) <= 19 and checked % 10 == 0:
            out.append((m.start(), m.end(), 2))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub(r"[^0-9]", "", m.group())) <= 15:
            out.append((m.start(), m.end(), 3))
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_plain_forms():
    dice = random.Random(1)
    parts = ["@", ".", "a", "b-c", "1", "23", "255", "256", "00", " ", "-", "+", "(", ")", "4111111111111111", "x@y.zz", "1.2.3.4", "é", "_%", "+1 (743) 555-3824"]
    for _ in range(4000):
        text = "".join(dice.choice(parts) for _ in range(dice.randint(0, 25)))
        assert pii.base_spans(text) == plain_spans(text), repr(text)
    assert pii.base_spans("0" * 6000 + ".1.2.3") == [(0, 6006, 1)]
    for hard in ("1" * 200_000, "a" * 200_000, "1." * 100_000, "a@" * 100_000, "+" + "1" * 200_000):
        pii.base_spans(hard)
        pii.candidates(hard)


@pytest.fixture(scope="module")
def documents(spark):
    dice = random.Random(9)
    rows = []
    for i in range(500):
        words = ["".join(dice.choices(["an", "er", "the", "ou", "re"], k=3)) for _ in range(60)]
        digits = "4" + "".join(dice.choices("0123456789", k=14))
        card = next(digits + d for d in "0123456789" if pii.luhn(digits + d))
        for form in (
            f"{words[0]}.{i}@mail{i % 9}.example.com",
            ".".join(str(dice.randint(0, 255)) for _ in range(4)),
            card,
            f"+1 ({dice.randint(100, 999)}) 555-{dice.randint(1000, 9999)}",
        ):
            words[dice.randrange(60)] = form
        rows.append((i, " ".join(words)))
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.fixture(scope="module")
def model(documents):
    return pii.fit(documents)


def test_trees_add_other_forms_and_leave_look_alikes(spark, documents, model):
    assert model.trees is not None
    wanted = [
        "er the an (743) 555-3824 ou re the",
        "er the an 743-555-3824 ou re the",
        "er the an 4111.1111.1111.1111 ou re the",
        "er the an some.one [at] mail3 [dot] example [dot] com ou re",
        "er the an some.one at mail3 dot example dot com ou re",
    ]
    clean = ["er the an 2024-01-31 ou re", "an on 2023-05-06 12-30 the", "er 12:30:45 an", "the 3.14159 of", "er the an ou re " * 20]
    rows = spark.createDataFrame(list(enumerate(wanted + clean)), "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.find(rows, model).collect()}
    found = [bool(got[i]) for i in range(len(wanted))]
    assert sum(found) >= 4, got
    assert not any(got[i] for i in range(len(wanted), len(got))), got


ADDRESSES = ["jane(at)example.com", "jane [at] example.com", "jane at example.com", "jane@ example.com", "jane(AT)example(DOT)com", "jane AT example Dot com"]


@pytest.mark.parametrize("form", ADDRESSES)
def test_every_form_of_an_address_is_searched(form):
    text = "er the an ou " * 30 + form + ", ou re"
    assert form in [text[s:e] for s, e, k in pii.candidates(text) if K[k] == "email"]


def test_trees_find_spelled_addresses(spark, model):
    rows = [(i, f"er the an {f.replace('jane', 'ouer.37').replace('example', 'mail3.example')} ou re the") for i, f in enumerate(ADDRESSES[:4])]
    got = {r["doc_id"]: r["spans"] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert all("email" in s for s in got.values()), got


SIDE_BY_SIDE = [
    ("{} {}", ["555-123-4567", "555-987-6543"]),
    ("{} / {}", ["743-555-3824", "743-555-3825"]),
    ("2024-01-05 {}", ["(743) 555-3824"]),
    ("7 {}", ["743-555-3824"]),
    ("{} {} {} {} {} {}", [f"743-555-38{i}4" for i in range(6)]),
    ("{} {}", ["4111.1111.1111.1111", "743-555-3824"]),
]
SPACED = [("{}", [" ".join("4111111111111111")]), ("{} {}", [" ".join("7435553824"), "743-555-3825"])]


@pytest.mark.parametrize("pattern, numbers", SIDE_BY_SIDE + SPACED)
def test_every_number_of_a_list_is_searched(pattern, numbers):
    text = "er the an " + pattern.format(*numbers) + " ou re"
    assert set(numbers) <= {text[s:e] for s, e, _ in pii.candidates(text)}


def test_trees_find_numbers_side_by_side(spark, model):
    rows = [(i, "er the an " + p.format(*n) + " ou re the") for i, (p, n) in enumerate(SIDE_BY_SIDE)]
    wanted = found = 0
    for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string"), model).collect():
        text, spans = r["text"], [s.split(":") for s in r["spans"].split(",") if s]
        said = [text[int(s) : int(e)] for _, s, e in spans]
        wanted += len(SIDE_BY_SIDE[r["doc_id"]][1])
        found += len(set(said) & set(SIDE_BY_SIDE[r["doc_id"]][1]))
    assert found >= 0.75 * wanted, (found, wanted)


def probe(dice, i):
    """One phone number and one address, each in a form that the plain rules don't know."""
    phone = f"{dice.randint(200, 999)}-{dice.randint(200, 999)}-{dice.randint(1000, 9999)}"
    return phone, f"ouer.{i} [at] mail{i % 7}.example.com"


@pytest.mark.parametrize("beside", [False, True])
def test_forms_in_the_corpus_are_not_taught_as_negative(spark, documents, beside):
    dice = random.Random(31)
    corpus = documents
    if beside:
        forms = [probe(dice, i) for i in range(500)]
        more = spark.createDataFrame([(i, f" the {p} ou {a} re an") for i, (p, a) in enumerate(forms)], "doc_id long, more string")
        corpus = documents.join(more, "doc_id").select("doc_id", F.concat("text", "more").alias("text"))
    taught = pii.fit(corpus)
    asked = [probe(dice, 1000 + i) for i in range(100)]
    rows = spark.createDataFrame([(i, f"er the an {p} ou re the {a} an er") for i, (p, a) in enumerate(asked)], "doc_id long, text string")
    phones = addresses = 0
    for r in pii.find(rows, taught).collect():
        said = [r["text"][int(s) : int(e)] for _, s, e in (x.split(":") for x in r["spans"].split(",") if x)]
        phones += asked[r["doc_id"]][0] in said
        addresses += asked[r["doc_id"]][1] in said
    assert phones >= 95 and addresses >= 95, (phones, addresses)


def test_what_a_check_rules_out():
    for text, span, ruled_out in (
        ("4111.1111.1111.1111", (0, 19, 2), False), ("4111.1111.1111.1112", (0, 19, 2), True),
        ("2024-01-31", (0, 10, 3), True), ("743-555-3824", (0, 12, 3), False),
        ("12:30:45", (0, 8, 1), True), ("fe80::1:2", (0, 9, 1), False), ("a at b.cc", (0, 9, 0), False),
    ):
        assert pii.impossible(text, span) == ruled_out, text


def test_held_out_candidates_are_of_other_documents(documents):
    rows = pii.training_candidates(documents).collect()
    assert len({r["pick"] for r in rows}) <= 500 < len(rows) and {r["pick"] % 4 == 0 for r in rows} == {True, False}


def test_every_document_and_every_plain_span_is_learned_from(spark):
    texts = spark.range(9_000).selectExpr("concat('write to user', id, '@example.org now') text")
    assert pii.training_candidates(texts).select("pick").distinct().count() == 9_000
    many = spark.createDataFrame([(" ; ".join(f"user{n}@example.org" for n in range(200)),)], "text string")
    assert pii.training_candidates(many).where("label = 1").count() >= 1_000
    counted = [(0, p / 10, float(p >= 6), 10) for p in range(10)]
    assert pii.thresholds(counted) == pii.thresholds([c[:3] for c in counted for _ in range(10)])
    plain = [(0, 9, 0), (2, 4, 1), (20, 25, 0)]
    assert pii.apart([(9, 20, 0), (8, 10, 0), (5, 8, 0), (24, 30, 1), (25, 30, 1)], plain) == [(9, 20, 0), (25, 30, 1)]


def test_base_spans_stay_and_redaction_covers_them(documents, model):
    for r in pii.find(documents, model).collect():
        plain = plain_spans(r["text"])
        assert {f"{K[k]}:{s}:{e}" for s, e, k in plain} <= set(r["spans"].split(","))
        assert [r[f"n_{k}"] for k in K] == [sum(s[2] == i for s in plain) for i in range(4)]
    for r in pii.redact(documents, model).collect():
        assert not plain_spans(r["text"]) and re.search(r"\[(EMAIL|IP|CARD|PHONE)\]", r["text"])


def test_overlaps_are_masked_once():
    assert pii._masked("card:3:9,phone:5:12", "abc0123456789xyz") == "abc[CARD]9xyz"
    assert pii._masked("", "abc") == "abc"


def test_odd_documents(odd_documents, no_documents, model):
    for m in (model, pii.Model(None, [1.1] * 4)):
        rows = pii.find(odd_documents, m).collect()
        assert len(rows) == 9
        assert [r["n_email"] for r in rows if r["doc_id"] == 6] == [20, 20]
        masked = pii.redact(odd_documents, m)
        assert masked.columns == odd_documents.columns
        assert {r["spans"] for r in masked.collect()} == {"clash"}
        assert [r["text"] for r in masked.collect() if r["doc_id"] == 1] == [None]
        assert pii.find(no_documents, m).count() == pii.redact(no_documents, m).count() == 0
    assert pii.fit(no_documents).trees is None


def test_thresholds():
    scored = [(0, i / 100, float(i >= 60)) for i in range(100)]
    least = pii.thresholds(scored)
    assert 0.55 <= least[0] <= 0.61 and least[1:] == [1.1] * 3
