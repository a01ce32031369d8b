"""Quality rules as a short-circuit cascade, in DataFrame expressions alone.

A rule is a rejection test with an expression. On a random sample of about
``SAMPLE_ROWS`` rows, spread over the whole table, each rule's selectivity (share
rejected) and cost are measured: the least time of ``RUNS`` evaluations, less that
of an evaluation that tests nothing, so that the start of a job isn't the rule's
cost. The rules are then ordered by rejection per cost and nested into one CASE, so that a
document pays only for the rules up to the first that rejects it. The verdict
is the conjunction of all rules, so the order can change the time, never the rows.

Words are ``[^\\x20\\x09-\\x0D]+``. Defined results: null text is a text without
words; a document without words fails the base rule; repeated rows are judged
each on their own; an empty table gives no rows; columns other than the id and
the text are ignored.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[ \t-\r]"
SYMBOLS = r"[#*$%&|<>]"
#: Expected rows of the sample on which costs and selectivities are measured, and evaluations of each rule.
SAMPLE_ROWS, RUNS, SEED = 2000, 3, 7


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def n_repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in ``words``.

    Windows are keyed by a 64-bit hash of their words. Texts without a repeated
    window stop at a distinct count; the others sort their windows once.
    """
    windows = F.when(
        F.size(words) >= 3,
        F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))),
    ).otherwise(F.array().cast("array<bigint>"))

    def covered(keys: Column) -> Column:
        by_key = F.array_sort(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
        repeated = let(
            by_key,
            lambda s: F.filter(s, lambda x, n: ((n > 0) & (F.get(s, n - 1)["k"] == x["k"])) | F.coalesce(F.get(s, n + 1)["k"] == x["k"], F.lit(False))),
        )
        places = F.array_sort(F.transform(repeated, lambda x: x["i"]))
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(
            places,
            start,
            lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).cast("long").alias("n")),
            lambda acc: acc["n"],
        )

    return let(windows, lambda keys: F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0).cast("long")).otherwise(covered(keys)))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text and the base counts of each text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    pieces = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.split(text, SPACE).alias("pieces"))
    words = pieces.select("doc_id", "text", F.array_remove("pieces", "").alias("words"), (F.length("text") - F.size("pieces") + 1).cast("long").alias("word_chars"))
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^ \t-\r]"))
    return words.select(
        "doc_id",
        "text",
        F.size("words").cast("long").alias("n_words"),
        "word_chars",
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        n_repeat_words(F.col("words")).alias("n_repeat_words"),
    )


@dataclass(frozen=True)
class Rule:
    """``rejects`` is an expression over the columns of :func:`measures`."""

    name: str
    rejects: str


#: The production rules; ratios are written without division, as counts may be 0.
RULES = (
    Rule("symbols", "n_symbols > n_words"),
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 40 * n_words"),
    Rule("duplicate_lines", r"2 * n_dup_lines > size(split(text, '\n'))"),
    Rule("shouting", r"2 * regexp_count(text, '\\p{Lu}') > regexp_count(text, '\\p{L}')"),
    Rule("few_letters", r"2 * regexp_count(text, '\\p{L}') < word_chars"),
    Rule("ellipsis_lines", r"2 * regexp_count(text, '(?m)(?:\\.\\.\\.|…)[ \\t]*$') > size(split(text, '\n'))"),
)


@dataclass(frozen=True)
class Measured:
    rule: Rule
    cost: float
    rejected: float

    @property
    def rank(self) -> float:
        """Rejections per cost; a cost below a millisecond can't be told from none."""
        return self.rejected / max(self.cost, 1e-3)


def measure_rules(sample: DataFrame, rules: tuple[Rule, ...] = RULES, runs: int = RUNS) -> tuple[list[Measured], dict[int, int]]:
    """Each rule's seconds, less those of testing nothing, and share of rejections on the sample; and how many rows each set of rules rejects together (bit k for the k-th rule)."""
    sample = sample.cache()
    try:
        total = max(1, sample.count())

        def seconds(expression: str) -> tuple[float, int]:
            took = []
            for _ in range(runs):
                began = time.perf_counter()
                n = sample.agg(F.sum(F.expr(expression).cast("int"))).first()[0] or 0
                took.append(time.perf_counter() - began)
            return min(took), n

        seconds("n_words < 0")  # compiles and reads once, so that the first rule doesn't pay for it
        nothing = seconds("n_words < 0")[0]
        found = [(rule, *seconds(rule.rejects)) for rule in rules]
        together = reduce(lambda a, x: a.bitwiseOR(x), (F.when(F.expr(r.rejects), 1 << k).otherwise(0) for k, r in enumerate(rules)), F.lit(0))
        masks = {r["mask"]: r["n"] for r in sample.groupBy(together.alias("mask")).agg(F.count("*").alias("n")).collect()}
    finally:
        sample.unpersist()
    return [Measured(rule, max(0.0, took - nothing), n / total) for rule, took, n in found], masks


def order_rules(measured: list[Measured], masks: dict[int, int] | None = None) -> list[Rule]:
    """Most rejection per cost first; ties keep the given order.

    With ``masks`` a rule counts with what it rejects of the rows that the rules before it have left, so one that only
    rejects what another has rejected already comes last; without, each counts alone.
    """
    if masks is None:
        return [x.rule for x in sorted(measured, key=lambda x: -x.rank)]
    left, order = list(range(len(measured))), []
    gone = 0
    total = max(1, sum(masks.values()))
    while left:
        caught = {k: sum(n for m, n in masks.items() if m >> k & 1 and not m & gone) / total for k in left}  # noqa: B023
        best = max(left, key=lambda k: Measured(measured[k].rule, measured[k].cost, caught[k]).rank)  # noqa: B023
        order.append(measured[best].rule)
        gone |= 1 << best
        left.remove(best)
    return order


def cascade(rules: list[Rule]) -> Column:
    """The name of the first rule that rejects, else null; later rules aren't evaluated then."""
    found = F.lit(None).cast("string")
    for rule in reversed(rules):
        found = F.when(F.expr(rule.rejects), F.lit(rule.name)).otherwise(found)
    return found


BASE_FAILED = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, the base counts, base_failed, and kept: neither the base nor a rule rejects."""
    share = min(1.0, sample_rows / max(1, docs.count()))
    # the cascade sees what the base leaves, so its rules are measured on that; the sample's counts are kept before the base
    # is asked, as a filter right on them would be pushed below and split a text anew for each of its words
    sample = measures(docs.sample(share, SEED), id_col, text_col).cache()
    try:
        order = order_rules(*measure_rules(sample.where(f"not ({BASE_FAILED})"), rules))
    finally:
        sample.unpersist()
    judged = measures(docs, id_col, text_col).withColumn("base_failed", F.expr(BASE_FAILED))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.when(F.col("base_failed"), False).otherwise(cascade(order).isNull()).alias("kept"),
    )
