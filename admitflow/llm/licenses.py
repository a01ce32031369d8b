"""Licence scan: notices and identifier tags by an Aho-Corasick automaton, licence expressions by a shunting-yard parser.

Texts are lower-cased (A-Z) and cut into words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.
One pass of the automaton over a text's words finds every phrase of ``BASE``
(general notices) and ``NOTICES`` (the exact licences), and the tag "SPDX
license identifier". What follows a tag on its line is a licence expression;
in prose, notices that only an "or", "and" or "with" stands between (besides
the words of ``FILLERS``) are one expression too. A shunting-yard parser turns
an expression into postfix order (``with`` binds closest, then ``and``, then
``or``) and evaluates its burden: the lesser of two sides of an ``or``, the
greater of an ``and``, and at most weak copyleft for a licence ``with`` an
exception. The score of a document is the greatest burden of its expressions,
as each of them binds: 0 without any, 0.2 permissive, 0.5 weak and 0.7 strong
copyleft, 0.8 with a ban on trade or changes, 1 all rights reserved.

Defined results: null and empty texts have no words and score 0; a word that
is no licence ends an expression; brackets left open are closed at its end; a
tag without an expression gives no label; repeated rows keep a row each; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: General notices and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notices of exact licences and their labels.
NOTICES = {
    "mit license": "mit", "permission is hereby granted free of charge": "mit", "apache license": "apache", "apache license version 2 0": "apache-2.0", "apache 2 0": "apache-2.0",
    "bsd license": "bsd", "bsd 2 clause": "bsd-2-clause", "bsd 3 clause": "bsd-3-clause", "redistribution and use in source and binary forms": "bsd", "isc license": "isc", "boost software license": "bsl-1.0",
    "zlib license": "zlib", "unlicense": "unlicense", "cc0": "cc0-1.0", "creative commons zero": "cc0-1.0", "public domain": "public-domain",
    "cc by nc": "cc-by-nc", "cc by nd": "cc-by-nd", "cc by sa": "cc-by-sa", "cc by nc sa": "cc-by-nc-sa", "cc by nc nd": "cc-by-nc-nd",
    "creative commons attribution": "cc-by", "creative commons attribution sharealike": "cc-by-sa", "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution share alike": "cc-by-sa", "creative commons attribution non commercial": "cc-by-nc", "creative commons attribution noderivatives": "cc-by-nd",
    "lesser general public license": "lgpl", "library general public license": "lgpl", "affero general public license": "agpl", "gnu gpl": "gpl", "gnu lgpl": "lgpl", "gnu agpl": "agpl",
    "general public license version 2": "gpl-2.0", "general public license version 3": "gpl-3.0", "lesser general public license version 3": "lgpl-3.0", "affero general public license version 3": "agpl-3.0",
    "mozilla public license": "mpl", "eclipse public license": "epl", "classpath exception": "classpath-exception-2.0", "linking exception": "linking-exception",
}
TAG = "spdx license identifier"
#: Words that may stand beside an operator between two notices of one expression.
FILLERS = frozenset("a an any at by choice either gnu higher later license licence licenses of only option or-later the under version v your 0 1 2 3 4".split())
#: Burdens by the start of a label, the longest that fits; other identifiers count as weak copyleft.
BURDEN = {
    "mit": 0.2, "apache": 0.2, "bsd": 0.2, "isc": 0.2, "bsl": 0.2, "zlib": 0.2, "unlicense": 0.2, "0bsd": 0.2, "cc0": 0.1, "public-domain": 0.1, "cc-by": 0.2, "cc-by-sa": 0.5,
    "cc-by-nc": 0.8, "cc-by-nd": 0.8, "lgpl": 0.5, "mpl": 0.5, "epl": 0.5, "gpl": 0.7, "agpl": 0.7, "reserved": 1.0,
}
OTHER, EXCEPTED = 0.5, 0.5
RANK = {"or": 1, "and": 2, "with": 3}

_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_TOKEN = re.compile(r"[ \t]*([()]|[A-Za-z0-9.+:-]*[A-Za-z0-9+])")


def burden(label: str) -> float:
    """Burden of one licence."""
    starts = [k for k in BURDEN if label == k or label.startswith((f"{k}-", f"{k}+"))]
    return BURDEN[max(starts, key=len)] if starts else OTHER


def postfix(tokens: list[str]) -> list[str]:
    """The longest start of ``tokens`` that is an expression, in postfix order (shunting-yard); operators and brackets as themselves, all else as licences."""
    out: list[str] = []
    held: list[str] = []
    whole: list[str] = []
    operand = True
    for t in tokens:
        if operand:
            if t == "(":
                held.append(t)
                continue
            if t in RANK or t == ")":
                break
            out.append(t)
            operand = False
        elif t == ")":
            if "(" not in held:
                break
            while (top := held.pop()) != "(":
                out.append(top)
        elif t in RANK:
            while held and held[-1] != "(" and RANK[held[-1]] >= RANK[t]:
                out.append(held.pop())
            held.append(t)
            operand = True
        else:
            break
        if not operand:
            whole = out + [h for h in reversed(held) if h != "("]
    return whole


def evaluate(rpn: list[str]) -> tuple[float, list[str]]:
    """Burden and licences of an expression in postfix order."""
    stack: list[float] = []
    for t in rpn:
        if t in RANK:
            b, a = stack.pop(), stack.pop()
            stack.append(min(a, b) if t == "or" else max(a, b) if t == "and" else min(a, EXCEPTED))
        else:
            stack.append(burden(t))
    return stack[0] if stack else 0.0, [t for t in rpn if t not in RANK]


def tagged(line: str) -> list[str]:
    """Tokens of the licence expression that a tag's line begins with."""
    at, found = 0, []
    line = line.lstrip(" \t:=\"'")
    while m := _TOKEN.match(line, at):
        found.append(m[1].lower())
        at = m.end()
    return found


def automaton() -> ahocorasick.Automaton:
    """All phrases with a space on either side; a value is (words, base label, other label, is the tag)."""
    a = ahocorasick.Automaton()
    for p in {*BASE, *NOTICES, TAG}:
        a.add_word(f" {p} ", (p.count(" ") + 1, BASE.get(p), NOTICES.get(p), p == TAG))
    a.make_automaton()
    return a


def scan_text(text: str | None, phrases: ahocorasick.Automaton) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score) of one text."""
    words = (text or "").encode("utf-8", "replace").translate(_WORDS).split()
    # a byte is a character here, so places are those of the bytes
    flat = f" {b' '.join(words).decode('latin-1')} "
    base: list[tuple[int, str]] = []
    terms: list[tuple[int, int, str]] = []
    tags: list[int] = []
    seen = at = 0
    for end, (n, general, exact, tag) in phrases.iter(flat):
        seen, at = seen + flat.count(" ", at, end), end
        start = seen - n
        if general:
            base.append((start, general))
        if tag:
            tags.append(seen)
        else:
            terms.append((start, -n, exact or general))
    labels = {x for _, x in base}
    score = 0.0
    # of notices that overlap the first counts, the longest of those at one place
    chain: list[str] = []
    last = None
    for start, n, label in sorted(terms):
        if last is not None and start < last:
            continue
        between = [w.decode("latin-1") for w in words[last:start]] if chain and start - last <= 8 else []
        operators = [w for w in between if w in RANK]
        if len(operators) == 1 and all(w in RANK or w in FILLERS for w in between):
            chain += [operators[0], label]
        else:
            value, names = evaluate(postfix(chain))
            score, labels, chain = max(score, value), labels | set(names), [label]
        last = start - n
    value, names = evaluate(postfix(chain))
    score, labels = max(score, value), labels | set(names)
    if tags:
        ends = set(tags)
        for k, m in enumerate(_WORD.finditer(text), 1):  # words of the text as it is, capitals too
            if k in ends:
                stop = text.find("\n", m.end())
                value, names = evaluate(postfix(tagged(text[m.end() : stop if stop >= 0 else len(text)])))
                score, labels = max(score, value), labels | set(names)
    starts = [s for s, _ in base]
    return len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), score


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_base, first_word, last_word, base_labels, labels and score of every document. No shuffle: each text is judged alone."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = automaton()
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        for batch in batches:
            found = list(zip(*(scan_text(t.as_py(), phrases) for t in batch.column(1)), strict=True)) if batch.num_rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(found, kinds, strict=True))], [id_col, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(scan, f"`{id_col}` {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double")
