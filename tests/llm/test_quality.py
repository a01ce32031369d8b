import re
import unicodedata
from collections import Counter

from admitflow.llm.quality import RULES, Measured, Rule, measure_rules, measures, order_rules, quality
from admitflow.session import read

SCHEMA = "doc_id long, text string, n_words string, kept int"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {w for w, n in Counter(windows).items() if n > 1}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    covered = {i + k for i, w in enumerate(windows) if w in twice for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def rejected(text, n, chars, symbols, dup_lines):
    """The production rules, character by character."""
    split = text.split("\n")
    letters = [c for c in text if unicodedata.category(c).startswith("L")]
    upper = [c for c in text if unicodedata.category(c) == "Lu"]
    ellipses = [x for x in split if x.rstrip(" \t").endswith(("...", "…"))]
    return symbols > n or chars < 2 * n or chars > 40 * n or 2 * dup_lines > len(split) or 2 * len(upper) > len(letters) or 2 * len(letters) < chars or 2 * len(ellipses) > len(split)


def check(rows, got):
    want = {i: brute(t) for i, t in rows}
    for r in got:
        n, chars, symbols, lines, repeats = want[r.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, lines, repeats), r.doc_id
        assert r.base_failed == (n < 50 or 100 * repeats > 50 * n)
        text = dict(rows)[r.doc_id] or ""
        assert r.kept == (not r.base_failed and not rejected(text, n, chars, symbols, lines)), r.doc_id


def test_small(spark):
    prose = " ".join(f"word{i} flows" for i in range(40))
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, "a b c a b c a b c"), (5, "x\n\nx\nx y\n y\x0b\x0cz"), (6, "é🎉 b\r\nc d"),
        (7, "a a a a"), (8, prose), (9, prose.upper() + "!!"), (10, "w*** " * 60), (11, "one two " * 30_000), (12, prose), (12, prose), (None, "q"),
        (13, " ".join(f"w{i}" for i in range(60)) + "\na b c d\n" * 2),
    ]
    got = quality(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)).collect()
    assert len(got) == len(rows)
    check(rows, got)
    kept = {r.doc_id for r in got if r.kept}
    assert 8 in kept and 12 in kept and not kept & {9, 10, 11}


def test_empty(spark):
    assert quality(spark.createDataFrame([], SCHEMA)).count() == 0


def test_order_is_by_rejection_per_cost_and_leaves_the_verdict(spark):
    rules = [Rule(x, "false") for x in "abc"]
    assert [r.name for r in order_rules([Measured(rules[0], 1, 0.1), Measured(rules[1], 1, 0.5), Measured(rules[2], 0.1, 0.2)])] == ["c", "b", "a"]
    docs = spark.createDataFrame([(i, f"w{i} *** && a b") for i in range(30)], "doc_id long, text string")
    assert len(measure_rules(measures(docs))[0]) == len(RULES)
    assert quality(docs).exceptAll(quality(docs, tuple(reversed(RULES)))).count() == 0


def test_order_counts_what_is_left(spark):
    """By data: b rejects most, c only rows of b's, so c comes last although it rejects more than a."""
    rules = tuple(Rule(*x) for x in (("a", "n_words % 10 = 3"), ("b", "n_words % 10 < 3"), ("c", "n_words % 10 < 2")))
    docs = spark.createDataFrame([(i, "w " * (60 + i)) for i in range(40)], "doc_id long, text string")
    measured, masks = measure_rules(measures(docs), rules)
    assert [m.rejected for m in measured] == [0.1, 0.3, 0.2] and masks == {0: 24, 1: 4, 2: 4, 6: 8}
    even = [Measured(m.rule, 1.0, m.rejected) for m in measured]
    assert [r.name for r in order_rules(even, masks)] == ["b", "a", "c"] and [r.name for r in order_rules(even)] == ["b", "c", "a"]
    dear = [Measured(m.rule, 1.0 if m.rule.name != "b" else 10.0, m.rejected) for m in measured]
    assert [r.name for r in order_rules(dear, masks)] == ["c", "a", "b"]


def test_whole_table(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    check([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], quality(docs).collect())
