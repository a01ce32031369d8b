import re

import pytest

from admitflow.llm.licenses import BASE, burden, evaluate, postfix, scan_licenses, tagged
from admitflow.session import read

SCHEMA = "doc_id long, text string, labels int, score string"


def brute(text):
    """Base part of a text, word by word."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = [(i, label) for p, label in BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def expected(words):
    """Value of an expression by recursive descent: an own reading of its grammar."""
    at = 0

    def either():
        nonlocal at
        v = both()
        while at < len(words) and words[at] == "or":
            at += 1
            v = min(v, both())
        return v

    def both():
        nonlocal at
        v = excepted()
        while at < len(words) and words[at] == "and":
            at += 1
            v = max(v, excepted())
        return v

    def excepted():
        nonlocal at
        v = one()
        while at < len(words) and words[at] == "with":
            at += 1
            one()
            v = min(v, 0.5)
        return v

    def one():
        nonlocal at
        at += 1
        if words[at - 1] == "(":
            v = either()
            at += 1
            return v
        return burden(words[at - 1])

    return either()


CASES = {
    "": ("", 0.0),
    "no licence here": ("", 0.0),
    "Released under the MIT License.": ("mit", 0.2),
    "Licensed under CC BY-NC 4.0.": ("cc-by,cc-by-nc", 0.8),
    "GNU General Public License, version 3": ("gpl,gpl-3.0", 0.7),
    "GNU Lesser General Public License": ("gpl,lgpl", 0.5),
    "All rights reserved.": ("reserved", 1.0),
    "under the MIT License or the Apache License, Version 2.0": ("apache-2.0,mit", 0.2),
    "the GNU GPL or the MIT License, at your option": ("gpl,mit", 0.2),
    "the GNU GPL and the MIT License": ("gpl,mit", 0.7),
    "GNU General Public License with the Classpath exception": ("classpath-exception-2.0,gpl", 0.5),
    "MIT License for some. All rights reserved for others": ("mit,reserved", 1.0),
    "// SPDX-License-Identifier: MIT OR GPL-2.0-only\nMIT": ("gpl-2.0-only,mit", 0.2),
    "# SPDX-License-Identifier: (MIT AND GPL-2.0-or-later) WITH Classpath-exception-2.0 */": ("classpath-exception-2.0,gpl-2.0-or-later,mit", 0.5),
    "SPDX-License-Identifier:\nMIT": ("", 0.0),
    "SPDX-License-Identifier: OR": ("", 0.0),
    "SPDX-License-Identifier: LicenseRef-x": ("licenseref-x", 0.5),
    "cc by cc by cc by": ("cc-by", 0.2),
}


def test_cases(spark):
    rows = list(enumerate(CASES)) + [(90, None), (None, "All rights reserved"), (91, "x " * 50_000 + "ALL—RIGHTS reserved all rights\nreserved"), (92, "ÀLL rights reserved ccé by"), (3, list(CASES)[3])]
    got = scan_licenses(spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA)).collect()
    assert len(got) == len(rows)
    for (i, text), r in zip(rows, got, strict=True):
        assert (r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (i, *brute(text)), text
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        if text in CASES:
            assert (r.labels, r.score) == CASES[text], text


def test_empty(spark):
    assert scan_licenses(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize(("tokens", "out"), [("a or b and c", "a b c and or"), ("( a or b ) and c", "a b or c and"), ("a and b or c with d", "a b and c d with or"), ("a or", "a"), ("a b", "a"), ("( a or b", "a b or"), ("a )", "a"), ("or a", ""), ("( ( a ) )", "a")])
def test_shunting_yard(tokens, out):
    assert postfix(tokens.split()) == out.split()


def test_values_agree_with_recursive_descent():
    import random

    rng = random.Random(4)

    def expression(depth):
        if depth == 0:
            return [rng.choice(["mit", "gpl-2.0-only", "cc-by-nc-4.0", "reserved", "odd"])]
        inner = [*expression(depth - 1), rng.choice(["or", "and", "with"]), *expression(rng.randrange(depth))]
        return ["(", *inner, ")"] if rng.random() < 0.5 else inner

    for _ in range(300):
        tokens = expression(rng.randrange(5))
        assert evaluate(postfix(tokens))[0] == expected(tokens), tokens


def test_tag_tokens():
    assert tagged(": (MIT OR Apache-2.0+) and X */ rest") == ["(", "mit", "or", "apache-2.0+", ")", "and", "x"]


def test_whole_table(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    want = {r.doc_id: brute(r.text) for r in docs.select("doc_id", "text").collect()}
    got = scan_licenses(docs).collect()
    assert {r.doc_id: tuple(r)[1:6] for r in got} == want
    assert all(0 <= r.score <= 1 and (r.score > 0) == bool(r.labels) for r in got)
