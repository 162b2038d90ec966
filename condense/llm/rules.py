"""Quality rules: text statistics, and decision lists learned from labelled statistics.

Sequential covering: a rule is a conjunction of threshold conditions on
statistics. It is grown on two thirds of the labelled rows by adding the
condition with the highest information gain, then pruned on the last third by
dropping final conditions while that does not hurt its precision there. What a
rule covers is taken out and the next one is grown, until no rule reaches the
precision asked for. The ordered list is emitted as one Spark ``CASE WHEN``.

Learning takes a bounded number of labelled rows (``MAX_ROWS``); statistics and
verdicts cover every row and the whole text.

Defined results: a NULL or empty text has no words, so its counts are 0 and it
fails the base check. Labels without a document, NULL labels and NULL ids are
not learned from; a document labelled twice counts twice. Without any labelled
row, or with one class only, the list is empty and only the base check rejects.
Equal gains are settled by the order of the statistics, then by the threshold.
Columns of the input that are named like a statistic give way to it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from condense.llm.rows import field, map_texts, words_of

#: Rows that a list is learned from at most, chosen by a hash of their id.
MAX_ROWS = 20_000

SYMBOLS = "#*$%&|<>"

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
EXTRA = ["n_code_points", "n_lines", "n_distinct_words", "n_upper", "n_digits", "n_marks", "n_stops"]

#: What conditions look at: shares, so that they mean the same in a short and in a long text.
FEATURES = {
    "symbols_per_word": ("n_symbols", "n_words"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "chars_per_word": ("word_chars", "n_words"),
    "distinct_share": ("n_distinct_words", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "digit_share": ("n_digits", "word_chars"),
    "mark_share": ("n_marks", "word_chars"),
    "words_per_line": ("n_words", "n_lines"),
    "stops_per_word": ("n_stops", "n_words"),
    "n_words": ("n_words", None),
}


def text_counts(text: str) -> tuple[int, ...]:
    """COUNTS and EXTRA of one text."""
    words = words_of(text)
    n = len(words)
    repeated = 0
    if n > 2:
        windows = list(zip(words, words[1:], words[2:]))
        seen = Counter(windows)
        if len(seen) < len(windows):
            covered = bytearray(n)
            for i, w in enumerate(windows):
                if seen[w] > 1:
                    covered[i : i + 3] = b"\1\1\1"
            repeated = sum(covered)
    lines = [line for line in text.split("\n") if words_of(line)] if "\n" in text else [text] * bool(n)
    ascii_text = text.encode("ascii", "ignore")
    of = np.bincount(np.frombuffer(ascii_text, dtype=np.uint8), minlength=128)
    return (
        n,
        sum(map(len, words)),
        int(of[_SYMBOL_CODES].sum()),
        len(lines) - len(set(lines)),
        repeated,
        len(text),
        len(lines),
        len(set(words)),
        int(of[65:91].sum()),
        int(of[48:58].sum()),
        int(of[_MARK_CODES].sum()),
        int(of[46]),
    )


_SYMBOL_CODES = [ord(c) for c in SYMBOLS]
_MARK_CODES = [ord(c) for c in "!?;:"]


def statistics(df: DataFrame, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """``keep`` columns (all by default) with the counts of each whole text."""
    names = COUNTS + EXTRA
    return map_texts(
        df,
        text,
        df.columns if keep is None else keep,
        [field(n, "long") for n in names],
        lambda: lambda texts: list(zip(*map(text_counts, texts))) or [[] for _ in names],
    )


def feature(name: str) -> Column:
    above, below = FEATURES[name]
    value = F.col(above).cast("double")
    return value if below is None else value / F.greatest(F.col(below), F.lit(1))


def base_failed() -> Column:
    """Too few words, or more than half of the words in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = feature(self.name)
        return value >= self.threshold if self.above else value < self.threshold

    def holds(self, table: dict[str, np.ndarray]) -> np.ndarray:
        value = table[self.name]
        return value >= self.threshold if self.above else value < self.threshold


Rule = tuple[Condition, ...]


def verdict(rules: Iterable[Rule]) -> Column:
    """True where no rule rejects: an ordered conditional expression."""
    chain = None
    for rule in rules:
        test = rule[0].column()
        for condition in rule[1:]:
            test = test & condition.column()
        chain = F.when(test, F.lit(False)) if chain is None else chain.when(test, F.lit(False))
    return F.lit(True) if chain is None else chain.otherwise(F.lit(True))


def _covered(rule: Rule, table: dict[str, np.ndarray], rows: np.ndarray) -> np.ndarray:
    for condition in rule:
        rows = rows & condition.holds(table)
    return rows


def _grow(table: dict[str, np.ndarray], bad: np.ndarray, rows: np.ndarray, least: int) -> Rule:
    rule: Rule = ()
    while True:
        p, n = int((rows & bad).sum()), int((rows & ~bad).sum())
        if p < least or n == 0:
            return rule
        worth, best = 1e-9, None
        for name, all_values in table.items():
            values, is_bad = all_values[rows], bad[rows]
            order = np.argsort(values, kind="stable")
            values, is_bad = values[order], is_bad[order]
            cuts = np.flatnonzero(np.diff(values) > 0) + 1  # a threshold lies between two different values
            if not len(cuts):
                continue
            low_bad = np.concatenate([[0], np.cumsum(is_bad)])[cuts]
            low_all = cuts
            for above in (True, False):
                q = p - low_bad if above else low_bad
                m = (p + n - low_all) - q if above else low_all - q
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(q >= least, q * (np.log2(q / (q + m)) - np.log2(p / (p + n))), 0.0)
                k = int(np.argmax(gain))
                if gain[k] > worth:
                    middle = (values[cuts[k] - 1] + values[cuts[k]]) / 2
                    worth, best = float(gain[k]), Condition(name, above, float(middle))
        if best is None or best in rule:
            return rule
        rule, rows = rule + (best,), rows & best.holds(table)


def _prune(rule: Rule, table: dict[str, np.ndarray], bad: np.ndarray, rows: np.ndarray) -> Rule:
    def value(r: Rule) -> float:
        hit = _covered(r, table, rows)
        p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
        return (p - n) / (p + n) if p + n else -1.0

    best = rule
    for length in range(len(rule) - 1, 0, -1):
        if value(rule[:length]) > value(best):
            best = rule[:length]
    return best


def learn(
    table: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.97, least: int = 5, max_rules: int = 24
) -> list[Rule]:
    """Ordered rules for the bad rows; a rule stays only if ``precision`` holds on all rows it is first to cover."""
    left = np.ones(len(bad), dtype=bool)
    holdout = np.arange(len(bad)) % 3 == 2
    rules: list[Rule] = []
    while len(rules) < max_rules:
        rule = _grow(table, bad, left & ~holdout, least)
        if not rule:
            break
        rule = _prune(rule, table, bad, left & holdout)
        hit = _covered(rule, table, left)
        kept_out = hit & holdout
        if (hit & bad).sum() < precision * hit.sum() or (kept_out & bad).sum() < precision * kept_out.sum():
            break
        rules.append(rule)
        left &= ~hit
    return rules


def training_rows(df: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """Features and label of at most ``max_rows`` labelled documents that pass the base check."""
    wanted = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .select("doc_id", F.col("quality").cast("int").alias("__quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "__quality")
        .limit(max_rows)
    )
    chosen = statistics(df.select("doc_id", "text").join(F.broadcast(wanted), "doc_id"), keep=["doc_id", "__quality"])
    return chosen.filter(~base_failed()).select("doc_id", "__quality", *[feature(n).alias(n) for n in FEATURES])


def learn_from(df: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> list[Rule]:
    got = training_rows(df, labels, max_rows).orderBy(F.xxhash64("doc_id"), "doc_id", "__quality").toPandas()
    if got.empty:
        return []
    return learn({n: got[n].to_numpy(dtype=float) for n in FEATURES}, (got["__quality"] == 0).to_numpy())


def judge(df: DataFrame, rules: Sequence[Rule], keep: Sequence[str] | None = None) -> DataFrame:
    """Counts of every text, ``base_failed`` and ``kept``."""
    counted = statistics(df, keep=keep).withColumn("base_failed", base_failed())
    return counted.withColumn("kept", ~F.col("base_failed") & verdict(rules))
