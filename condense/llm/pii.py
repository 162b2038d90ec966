"""Personal data: rules for the plain forms, boosted trees for candidates beyond them.

Plain forms (e-mail, IPv4, card and phone numbers) are found by fixed rules and always
stay. High-recall generators propose further, overlapping spans: digit chains with any
usual separators, spelled-out or spaced e-mail addresses, IPv6. Gradient-boosted trees
score a span from its format and its surroundings; per kind, a threshold calibrated on
held-out candidates for a wanted precision decides. Of overlapping accepted spans
the most probable one stays.

The trees learn without hand-made labels. All plain spans of all documents are rewritten into other usual
forms inside their own surroundings (positive), and into look-alikes: broken
checksums, octets over 255, dates, versions, amounts, identifiers (negative). What the generators
propose in these documents by themselves may be personal data in another form, so
it isn't taken for negative unless a check rules it out (``impossible``); the rest stays
unlabelled. A quarter of the documents, by hash, is held out, and only their candidates set the
thresholds, so no text is on both sides. Equal candidates are learned and judged as one that counts
as often as it occurs. Every whole text is searched.

Defined results: a NULL or empty text has no spans; rows are handled one by one, so
repeated rows repeat their result, NULL ids are kept and ties don't arise; where
documents hold no plain span, nothing is learned and only the rules apply. A very long
text is searched whole, in time linear in its length. Output columns replace input columns
of the same name.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from itertools import accumulate, islice

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F, types as T

from condense.llm.rows import arrow_schema, field, map_texts, pieces
from condense.session import ship, written

KINDS = ["email", "ip", "card", "phone"]
EMAIL, IP, CARD, PHONE = range(4)

PRECISION = 0.99
#: Steps of probability in which held-out candidates are counted for the thresholds.
STEPS = 10_000
TRAIN_ROWS = 5_000  # a batch

#: The plain forms (fixed values).
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[int, int, int]  # start, end, kind


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join([c for c in text if "0" <= c <= "9"])


def base_spans(text: str) -> list[Span]:
    """Spans of the plain forms, leftmost and not overlapping within a kind."""
    out: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:  # every address holds an @: look to both sides of it
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, domain.end(), EMAIL))
            done = domain.end()
        at = text.find("@", max(at + 1, done))
    for m in _DOTTED.finditer(text):  # a chain of n numbers holds n // 4 matches side by side
        parts = m.group().split(".") if m.end() - m.start() > 6 else ()
        if len(parts) > 3:
            start = m.start()
            for i in range(0, len(parts) - 3, 4):
                four = parts[i : i + 4]
                end = start + sum(map(len, four)) + 3
                if all(len(p := n.lstrip("0")) < 4 and int(p or 0) <= 255 for n in four):
                    out.append((start, end, IP))
                start = end + 1
    for m in _CARD.finditer(text):
        if m.end() - m.start() > 11:
            digits = _digits(m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), CARD))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m.group())) <= 15:
                out.append((m.start(), m.end(), PHONE))
    return sorted(out, key=lambda s: (s[0], s[2]))


def described(spans: Sequence[Span]) -> str:
    return ",".join([f"{KINDS[k]}:{s}:{e}" for s, e, k in sorted(spans, key=lambda s: (s[0], s[2], s[1]))])


_CHAIN = re.compile(r"[0-9][0-9 ()./_-]{5,}[0-9]")
_NUMBER = re.compile(r"[0-9]+")
#: Characters of one number at most.
NUMBER_CHARS = 62
#: Signs of an address in another form: an at-form, or a spelled dot.
_SIGN = re.compile(r"(?i)[(\[{]at[)\]}]| at | @|@ |[(\[{]dot[)\]}]|\[\.\]| dot ")
_SPELLED = re.compile(
    r"(?i)[A-Z0-9._%+-]{1,64} ?(?:@|\(at\)|\[at\]|\{at\}|(?<= )at) ?[A-Z0-9-]{1,63}"
    r"(?: ?(?:\.|\(dot\)|\[dot\]|\{dot\}|\[\.\]|(?<= )dot) ?[A-Z0-9-]{2,63})+"
)
_HEXES = re.compile(r":[0-9A-Fa-f:]{1,37}")


def candidates(text: str) -> list[Span]:
    """Overlapping spans that may be personal data in another form."""
    found: set[Span] = set()
    for m in _CHAIN.finditer(text):
        groups = [(g.start(), g.end()) for g in _NUMBER.finditer(text, m.start(), m.end())]
        for i, (first, _) in enumerate(groups):  # numbers may stand side by side: every run of groups
            start, n = first, 0
            if start and text[start - 1] == "(":
                start -= 1
            if start and text[start - 1] == "+":
                start -= 1
            for low, end in groups[i : i + 19]:
                n += end - low
                if n > 19 or end - first > NUMBER_CHARS:
                    break
                if 7 <= n <= 15:
                    found.add((start, end, PHONE))
                if n >= 12:
                    found.add((first, end, CARD))
    done = 0
    for sign in _SIGN.finditer(text):
        at = sign.start()
        if at >= done:
            low = max(done, at - 140)
            for m in _SPELLED.finditer(text, low, min(len(text), at + 140)):
                found.add((m.start(), m.end(), EMAIL))
            done = at + 1
    if text.count(":") > 1:
        for m in _HEXES.finditer(text):
            if m.group().count(":") > 1:
                start = m.start()
                while start > max(0, m.start() - 4) and text[start - 1] in "0123456789abcdefABCDEF":
                    start -= 1
                found.add((start, m.end(), IP))
    return sorted(found)


def apart(found: Sequence[Span], plain: Sequence[Span]) -> list[Span]:
    """The spans that overlap none of the plain ones, which are ordered by start."""
    starts = [s for s, _, _ in plain]
    ends = list(accumulate((e for _, e, _ in plain), max))  # the furthest end so far
    out = []
    for span in found:
        before = bisect_left(starts, span[1])
        if not before or ends[before - 1] <= span[0]:
            out.append(span)
    return out


FEATURES = 24


def features(text: str, span: Span) -> list[float]:
    """Format and context of a candidate."""
    start, end, kind = span
    inner = text[start:end]
    digits = _digits(inner)
    groups = re.findall(r"[0-9]+", inner) or [""]
    before, after = text[start - 1 : start], text[end : end + 1]
    left = text[max(0, start - 24) : start].lower()
    hexes = re.findall(r"[0-9A-Fa-f]+", inner)

    def side(c: str) -> float:
        return 0.0 if not c or c.isspace() else 1.0 if c in ".,;:!?)]}\"'|" else 2.0 if c.isalpha() else 3.0

    year = any(len(g) == 4 and g[:2] in ("19", "20") for g in groups)
    return [
        float(kind),
        float(end - start),
        float(len(digits)),
        float(len(groups)),
        float(len(groups[0])),
        float(len(groups[-1])),
        float(max(map(len, groups))),
        float(min(map(len, groups))),
        float(inner.count(" ")),
        float(inner.count("-")),
        float(inner.count(".")),
        float(inner.count("/") + inner.count("_")),
        float(inner.count("(")),
        float(inner[:1] == "+" or inner[:2] == "00"),
        float(luhn(digits)) if digits else 0.0,
        float(len({len(g) for g in groups}) == 1),
        float(inner.count(":")),
        float(max(map(len, hexes), default=0)),
        float(bool(re.search(r"@|\(at\)|\[at\]|\{at\}", inner))),
        float(len(inner.rpartition(" ")[2])),
        float(year),
        side(before),
        side(after),
        float(any(w in left for w in ("tel", "phone", "fon", "call", "mail", "card", "tarjeta", "karte", "carte", "ip", "fax"))),
    ]


def _rewritten(span_text: str, kind: int, dice: np.random.Generator) -> list[tuple[str, int]]:
    """Other forms of a plain span (1) and look-alikes of it (0)."""
    digits = _digits(span_text)
    roll = "".join(str(d) for d in dice.integers(0, 10, 24))
    date = f"20{roll[:2]}-{1 + int(roll[2:4]) % 12:02d}-{1 + int(roll[4:6]) % 28:02d}"
    fakes = [date, f"{date} {roll[6:8]}-{roll[8:10]}", f"{roll[:1]}.{roll[1:3]}.{roll[3:8]}", roll[: 8 + int(roll[0])], f"{roll[:3]}/{roll[3:8]}"]
    if kind == EMAIL:
        name, _, domain = span_text.partition("@")
        spelled = domain.replace(".", " dot ")
        return [
            (f"{name} at {spelled}", 1),
            (f"{name} [at] {domain.replace('.', ' [dot] ')}", 1),
            (f"{name}(at){domain.replace('.', '(dot)')}", 1),
            (f"{name} @ {domain}", 1),
            (f"{name}(at){domain}", 1),
            (f"{name} [at] {domain}", 1),
            (f"{name} at {domain}", 1),
            (f"{name}@ {domain}", 1),
            (f"{name} AT {spelled.replace(' dot ', ' Dot ')}", 1),
            (f"{name}(AT){domain.replace('.', '(DOT)')}", 1),
            (f"{name} at the dot {domain.split('.')[0]}", 0),
        ]
    if kind == PHONE:
        country, rest = digits[: len(digits) - 10], digits[-10:]
        broken = [f"{rest[:5]} {rest[5:6]} {rest[6:]}", f"{rest[:4]}.{rest[4:9]}"]
        return [
            (f"({rest[:3]}) {rest[3:6]}-{rest[6:]}", 1),
            (f"{rest[:3]}-{rest[3:6]}-{rest[6:]}", 1),
            (f"{rest[:3]}.{rest[3:6]}.{rest[6:]}", 1),
            (f"00{country or '1'} {rest[:3]} {rest[3:6]} {rest[6:]}", 1),
            *[(f, 0) for f in broken + fakes[:3]],
        ]
    if kind == CARD:
        wrong = digits[:-1] + str((int(digits[-1]) + 1 + int(roll[0]) % 8) % 10)
        four = [digits[i : i + 4] for i in range(0, len(digits), 4)]
        return [
            (".".join(four), 1),
            ("/".join(four), 1),
            ("_".join(four), 1),
            *[(f, 0) for f in (wrong, ".".join(wrong[i : i + 4] for i in range(0, len(wrong), 4)), "x" + digits + "f", roll[:16])],
        ]
    octets = span_text.split(".")
    six = ":".join(f"{int(o):x}{roll[i]}" for i, o in enumerate(octets)) + "::" + roll[4]
    clock = f"{int(roll[:2]) % 24:02d}:{int(roll[2:4]) % 60:02d}:{int(roll[4:6]) % 60:02d}"
    return [(f"2001:{six}", 1), (f"fe80::{int(octets[0]):x}:{int(octets[-1]):x}", 1), (clock, 0), (f"{roll[0]}:{roll[1]}:{roll[2]}", 0), *[(f, 0) for f in fakes[3:]]]


def _beside(form: str, label: int, left: str, right: str, dice: np.random.Generator) -> tuple[str, int, str, str]:
    """The form with another number of its kind, or the number of an item, at its side."""
    other = _NUMBER.sub(lambda m: "".join(str(d) for d in dice.integers(0, 10, len(m.group()))), form)
    gap = (" ", " / ", "  ", " - ")[dice.integers(4)]
    place = dice.integers(4)
    if place == 0:
        return form, label, f"{left}{dice.integers(1, 100)} ", right
    return (form, label, left + other + gap, right) if place == 1 else (form, label, left, gap + other + right) if place == 2 else (
        form, label, left + other + gap, gap + other + right
    )


_DATE = re.compile(r"(?:19|20)[0-9]{2}[-./](?:0?[1-9]|1[0-2])[-./](?:0?[1-9]|[12][0-9]|3[01])(?![0-9])")
_CLOCK = re.compile(r"[0-9]{1,2}(?::[0-9]{1,2})+")


def impossible(text: str, span: Span) -> bool:
    """Whether a check rules out that a candidate is what its generator takes it for."""
    inner = text[span[0] : span[1]]
    if span[2] == CARD:
        return not luhn(_digits(inner))
    if span[2] == PHONE:
        return _DATE.match(inner) is not None
    if span[2] == IP:
        try:
            ipaddress.IPv6Address(inner)
        except ValueError:
            return True
        return _CLOCK.fullmatch(inner) is not None
    return False


#: ``pick`` is a hash of the document, ``n`` the number of the candidate in it.
TRAIN = [field("features", "array_double"), field("label", "double"), field("kind", "int"), field("pick", "long"), field("n", "int")]


def training_candidates(df: DataFrame, text: str = "text") -> DataFrame:
    """Labelled candidates from all documents."""
    ship(df.sparkSession)
    part = df.select(F.col(text).alias("text"))
    schema = arrow_schema(TRAIN)

    def labelled(value: str) -> Iterator[tuple]:
        plain = base_spans(value)
        said = value.encode("utf-8", "surrogatepass")
        dice = np.random.default_rng(zlib.crc32(said))
        for span in apart(candidates(value), plain):
            if impossible(value, span):
                yield features(value, span), 0.0, span[2]
        for start, end, kind in plain:
            left, right = value[max(0, start - 60) : start], value[end : end + 60]
            forms = [(form, label, left, right) for form, label in _rewritten(value[start:end], kind, dice)]
            if kind in (CARD, PHONE):
                forms += [_beside(*form, dice) for form in forms if form[1]]
            for form, label, left, right in forms:
                made = left + form + right
                for span in candidates(made):
                    shared = min(span[1], len(left) + len(form)) - max(span[0], len(left))
                    if shared > 0:
                        exact = shared >= 0.9 * len(form) and span[1] - span[0] <= 1.1 * len(form) + 1
                        yield features(made, span), float(label and exact and span[2] == kind), span[2]

    def numbered(value: str) -> Iterator[tuple]:
        pick = int.from_bytes(hashlib.sha256(value.encode("utf-8", "surrogatepass")).digest()[:7])
        for n, row in enumerate(labelled(value)):
            yield *row, pick, n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                rows = (r for t in part.column("text").to_pylist() if t for r in numbered(t))
                while some := list(islice(rows, TRAIN_ROWS)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*some), schema)], schema=schema)

    return part.mapInArrow(run, T.StructType(TRAIN))


def thresholds(scored: list[tuple], precision: float = PRECISION) -> list[float]:
    """Per kind, the lowest probability from which held-out candidates reach ``precision``; over 1 if none does.

    A candidate is its kind, probability and label, and how many there are of it (1 if left out).
    """
    out = []
    for kind in range(len(KINDS)):
        own = sorted(((p, y, *n) for k, p, y, *n in scored if k == kind), reverse=True)
        best, good, n = 1.1, 0.0, 0
        for at, (p, y, *more) in enumerate(own, 1):
            count = more[0] if more else 1
            good += y * count
            n += count
            tied = at < len(own) and own[at][0] == p
            if not tied and n >= 20 and good >= precision * n:
                best = max(p, 0.5)
        out.append(best)
    return out


class Model:
    """Boosted trees and the threshold of each kind."""

    def __init__(self, trees: GBTClassificationModel | None, least: Sequence[float]):
        self.trees, self.least = trees, list(least)


def fit(df: DataFrame, text: str = "text") -> Model:
    held = (F.pmod("pick", F.lit(4)) == 0).alias("held")
    rows = training_candidates(df, text).groupBy("features", "kind", "label", held).agg(F.count(F.lit(1)).alias("n"))
    rows = rows.orderBy("features", "kind", "label", "held").withColumn("vector", array_to_vector("features"))
    rows = written(rows, "pii-train")
    seen = {(r["kind"], r["label"]): r["n"] for r in rows.groupBy("kind", "label").agg(F.sum("n").alias("n")).collect()}
    if min(sum(n for (_, label), n in seen.items() if label == y) for y in (0.0, 1.0)) < 20:
        return Model(None, [1.1] * len(KINDS))
    # every kind counts alike, or the many runs of digit groups decide how addresses are scored
    totals = [sum(n for (k, _), n in seen.items() if k == kind) for kind in range(len(KINDS))]
    share = F.element_at(F.array(*[F.lit(sum(totals) / max(1, n)) for n in totals]), F.col("kind") + 1)
    rows = rows.withColumn("weight", F.col("n") * share / len(KINDS))
    trees = GBTClassifier(featuresCol="vector", weightCol="weight", maxDepth=4, maxIter=20, stepSize=0.3, seed=5).fit(rows.filter(~F.col("held")))
    step = (F.floor(vector_to_array("probability")[1] * STEPS) / STEPS).alias("p")
    scored = trees.transform(rows.filter("held")).groupBy("kind", step, "label").agg(F.sum("n").alias("n"))
    return Model(trees, thresholds([tuple(r) for r in scored.collect()]))


FOUND = [
    *[field(f"n_{k}", "long") for k in KINDS],
    field("base", "string"),
    field("_row", "long"),
    T.StructField(
        "_spans",
        T.ArrayType(T.StructType([field("start", "int"), field("end", "int"), field("kind", "int"), field("features", "array_double")])),
    ),
]


def search(df: DataFrame, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """Per row: counts and description of the plain spans, and the candidates that overlap none of them."""

    def make():
        from pyspark import TaskContext

        task, n = TaskContext.get().partitionId(), 0

        def rows(texts: list[str]):
            nonlocal n
            counts, described_, numbers, spans = [[] for _ in KINDS], [], [], []
            for t in texts:
                plain = base_spans(t)
                for k in range(len(KINDS)):
                    counts[k].append(sum(1 for s in plain if s[2] == k))
                described_.append(described(plain))
                free = apart(candidates(t), plain)
                spans.append([{"start": s[0], "end": s[1], "kind": s[2], "features": features(t, s)} for s in free])
                numbers.append((task << 36) + n)
                n += 1
            return [*counts, described_, numbers, spans]

        return rows

    return map_texts(df, text, df.columns if keep is None else keep, FOUND, make)


def find(df: DataFrame, model: Model, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """``keep`` columns, ``n_email`` to ``n_phone``, ``base`` and ``spans`` (all spans, described)."""
    results = [*[f"n_{k}" for k in KINDS], "base", "spans"]
    keep = [c for c in (df.columns if keep is None else keep) if c not in results]
    names = {f"_k{i}": c for i, c in enumerate(keep)}
    given = df.select(*[F.col(f"`{c}`").alias(k) for k, c in names.items()], F.col(f"`{text}`").alias("_value"))
    back = [*[F.col(k).alias(c) for k, c in names.items()], *results]
    rows = search(given, "_value", list(names))
    if model.trees is None:
        return rows.withColumn("spans", F.col("base")).select(*back)
    rows = written(rows, "pii-spans")
    single = rows.filter(F.size("_spans") > 0).select("_row", F.explode("_spans").alias("s")).select("_row", "s.*")
    scored = model.trees.transform(single.withColumn("vector", array_to_vector("features"))).withColumn(
        "p", vector_to_array("probability")[1]
    )
    least = F.element_at(F.array(*[F.lit(t) for t in model.least]), F.col("kind") + 1)
    taken = scored.filter(F.col("p") >= least).select("_row", "start", "end", "kind", "p")
    # a document's accepted spans, the most probable of overlapping ones first
    by_row = taken.groupBy("_row").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("p")).alias("q"), "start", "end", "kind"))).alias("found")
    )
    empty = F.array().cast("array<struct<q:double,start:int,end:int,kind:int>>")
    apart = F.aggregate(
        "found",
        empty,
        lambda got, s: F.when(
            F.exists(got, lambda g: (g["start"] < s["end"]) & (s["start"] < g["end"])), got
        ).otherwise(F.concat(got, F.array(s))),
    )
    names = F.array(*[F.lit(k) for k in KINDS])
    say = lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])
    added = by_row.select("_row", F.transform(apart, say).alias("added"))
    both = F.concat(F.filter(F.split("base", ","), lambda x: x != ""), F.coalesce("added", F.array().cast("array<string>")))
    place = lambda x: F.struct(
        F.element_at(F.split(x, ":"), 2).cast("int").alias("start"), F.array_position(names, F.element_at(F.split(x, ":"), 1)).alias("kind"), x.alias("said")
    )
    ordered = F.transform(F.array_sort(F.transform(both, place)), lambda s: s["said"])
    out = rows.drop("_spans").join(added, "_row", "left")
    return out.withColumn("spans", F.when(F.col("added").isNull(), F.col("base")).otherwise(F.array_join(ordered, ","))).select(*back)


def redact(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``df`` with every found span in ``text`` replaced by ``[KIND]``; other columns as they are."""
    whole = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row"), F.col(f"`{text}`").alias("__value"))
    found = find(whole, model, "__value", ["__row"])
    given = F.coalesce(F.col("__row")[text], F.lit(""))
    both = found.select("__row", F.concat("spans", F.lit("\x00"), given).alias("__both"))

    def make():
        return lambda rows: [[_masked(*r.split("\x00", 1)) for r in rows]]

    masked = map_texts(both, "__both", ["__row"], [field("__masked", "string")], make)
    kept = {c: F.col("__row")[c].alias(c) for c in df.columns}
    kept[text] = F.when(F.col("__row")[text].isNotNull(), F.col("__masked")).alias(text)
    return masked.select(*kept.values())


def _masked(spans: str, text: str) -> str:
    """``text`` without its spans; what has become a plain form by that (its neighbours are gone) goes, too."""
    text = _cut(spans, text)
    while left := base_spans(text):
        text = _cut(described(left), text)
    return text


def _cut(spans: str, text: str) -> str:
    out, at = [], 0
    parts = [s.split(":") for s in spans.split(",") if s]
    for kind, start, end in sorted(((k, int(s), int(e)) for k, s, e in parts), key=lambda p: (p[1], -p[2])):
        if end <= at:
            continue
        out.append(text[at : max(at, start)])
        if start >= at:
            out.append(f"[{kind.upper()}]")
        at = end
    return "".join([*out, text[at:]])
