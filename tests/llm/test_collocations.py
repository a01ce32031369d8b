import re
from collections import Counter
from itertools import product

import pyarrow as pa
import pytest

from admitflow.llm.collocations import Trie, Words, collocations, frequent_phrases

SCHEMA = "doc_id long, text string, lang string, n int, phrase string"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def counts(rows):
    n, f = Counter(), Counter()
    for _, text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang if lang is not None else "und"] += len(words)
            for m in range(1, 6):
                for i in range(len(words) - m + 1):
                    f[lang if lang is not None else "und", tuple(words[i : i + m])] += 1
    return n, f


def brute(rows, least, top=2000):
    n, f = counts(rows)
    f = {k: a for k, a in f.items() if a >= least}
    out = []
    for (lang, words), a in f.items():
        if len(words) < 2 or any(g == lang and len(w) > len(words) and b >= a and words in {w[i : i + len(words)] for i in range(len(w) - len(words) + 1)} for (g, w), b in f.items()):
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, words[:k]] * f[lang, words[k:]]), k) for k in range(1, len(words)))
        out.append((lang, " ".join(words), a, f[lang, words[:k]], f[lang, words[k:]], n[lang], score))
    ranked = []
    for lang in {o[0] for o in out}:
        mine = sorted((o for o in out if o[0] == lang), key=lambda o: (-o[6], -o[2], o[1].encode()))[:top]
        ranked += [(lang, rank, *o[1:]) for rank, o in enumerate(mine, 1)]
    return sorted(ranked)


ROWS = (
    [(i, "New York, is big. New\tYork  is big", "en") for i in range(8)]
    + [(20 + i, "é à é à é à; new york", "fr") for i in range(5)]
    + [(30, None, "en"), (31, "", "en"), (32, " \t\n", None), (33, "x " * 4000, None), (34, "y y y y y y y", ""), (35, "A b C d e f g " * 9, "und"), (36, "one", "en"), (None, "New York", "en"), (36, "one", "en")]
    + [(40 + i, f"the w{i % 3} of the w{i % 3} of", "en") for i in range(12)]
)


@pytest.mark.parametrize(("buckets", "shard"), [(None, 500_000), (3, 500_000), (16, 5)])
def test_equals_brute_force(spark, buckets, shard):
    """Whatever the buckets and shards: 8 buckets hide nothing, and tries of about five phrases count the same."""
    docs = spark.createDataFrame([(i, t, lang, 1, "p") for i, t, lang in ROWS], SCHEMA).repartition(3)
    for least in (3, 8):
        got = sorted(map(tuple, collocations(docs, least, buckets=buckets, shard_phrases=shard).collect()))
        assert got == brute(ROWS, least)
        if shard == 5:
            break


def test_counts_and_top(spark):
    docs = spark.createDataFrame([(i, t, lang, 1, "p") for i, t, lang in ROWS], SCHEMA)
    n, f = counts(ROWS)
    assert {(r.lang, tuple(r.phrase.split(" "))): (r.m, r.a, r.n) for r in frequent_phrases(docs, 4).collect()} == {(g, w): (len(w), a, n[g]) for (g, w), a in f.items() if a >= 4}
    assert sorted(map(tuple, collocations(docs, 2, top=2).collect())) == brute(ROWS, 2, 2)


def test_empty(spark):
    assert collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        frequent_phrases(spark.createDataFrame([], SCHEMA), 128)


def test_products_beyond_64_bits(spark):
    docs = spark.createDataFrame([(1, "a b. " * 3 + "c. " * 10, "en", 1, "p")], SCHEMA)
    big = 3_000_000_000
    found = frequent_phrases(docs, 3).where("lang = 'en'").collect()
    assert {r.phrase: (r.a, r.n) for r in found} == {"a": (3, 16), "b": (3, 16), "a b": (3, 16), "c": (10, 16)}
    exact = spark.sql(f"SELECT (CAST({big} AS DECIMAL(19, 0)) * CAST({big * 9} AS DECIMAL(19, 0)) * 1000BD) div (CAST({big} AS DECIMAL(19, 0)) * CAST({big + 1} AS DECIMAL(19, 0))) AS x").first().x
    assert exact == 1000 * big * big * 9 // (big * (big + 1))


def test_trie_holds_its_phrases_and_no_others():
    letters = "a b c d e f g h".split()
    phrases = [" ".join(p) for m in (1, 2, 3) for k, p in enumerate(product(letters, repeat=m)) if k % 3 == 0] + ["a b c d e", "z"]
    langs = ["x" if k % 2 else "y" for k in range(len(phrases))]
    trie = Trie(pa.array(langs), pa.array(phrases))
    for lang in ("x", "y", "none"):
        import numpy as np

        got = np.zeros(len(phrases), np.int64)
        text = " ".join(" ".join(p) for p in product(letters, repeat=3)) + ". a b c d e f"
        trie.count(lang, Words(pa.array([text, None, "z"]).fill_null("")), got)
        _, f = counts([(0, text, lang), (1, "z", lang)])
        assert got.tolist() == [f[lang, tuple(p.split())] if g == lang else 0 for g, p in zip(langs, phrases, strict=True)]


def test_texts_are_read_twice_however_many_candidates(spark):
    """The passes over the texts don't grow with the phrases that are counted."""
    reads = spark.sparkContext.accumulator(0)
    rows = [(i, t, lang, 1, "p") for i, t, lang in ROWS]

    def seen(row):
        reads.add(1)
        return row

    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 3).map(seen), SCHEMA)
    n, f = counts(ROWS)
    for shard in (5, 500_000):
        before = reads.value
        found = {(r.lang, tuple(r.phrase.split(" "))): r.a for r in frequent_phrases(docs, 2, buckets=16, shard_phrases=shard).collect()}
        assert found == {k: a for k, a in f.items() if a >= 2}
        assert reads.value - before == 2 * len(rows)


def test_windows_of_many_words():
    """Numbers of phrases that pass 64 bits are still told apart: 5 of 8,000 different words."""
    import numpy as np

    from admitflow.llm.collocations import LONGEST, bucket_bits, windows

    rng = np.random.default_rng(5)
    pieces = [[f"w{x}" for x in rng.permutation(8000)] * 2] + [[f"w{x}" for x in rng.integers(0, 8000, 7)] for _ in range(300)]
    full = np.full((LONGEST, 1 << 13), 255, np.uint8)
    got = Counter()
    for phrases, begin, n in windows("en", Words(pa.array([". ".join(" ".join(p) for p in pieces)])), 16, full):
        assert len(phrases) == len(begin) == len(set(phrases.to_pylist()))
        got.update(dict(zip(phrases.to_pylist(), n.tolist(), strict=True)))
    want = Counter(w.encode() for p in pieces for w in p)
    want.update(" ".join(p[i : i + LONGEST]).encode() for p in pieces for i in range(len(p) - 1))
    assert got == want
    assert [bucket_bits(x) for x in (0, 1 << 24, 1 << 30, 10 << 30, 52 << 30)] == [16, 21, 26, 26, 27]


def test_counts_by_times():
    """A trie counts a piece's beginnings as often as the piece is said to be there."""
    import numpy as np

    trie, got = Trie(pa.array(["x"] * 3), pa.array(["a b", "a b c", "b c"])), np.zeros(3, np.int64)
    trie.count("x", Words(pa.array(["a b", "a b c d", "b c", "q"])), got, np.array([1 << 40, 5, 7, 9]))
    assert got.tolist() == [(1 << 40) + 5, 5, 7]
