import re

import numpy as np
import xxhash

from admitflow.llm.components import components
from admitflow.llm.simhash import fingerprint, links, near_duplicates
from admitflow.session import read

SCHEMA = "doc_id long, text string, fp string, component_id int"


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    ids = list(prints)
    top = {i: i for i in ids}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[:n]:
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def verify(docs, got):
    prints = {i: brute_print(t) for i, t in docs}
    want = brute_components(prints)
    assert len(got) == len(docs)
    for r in got:
        assert r.fingerprint == f"{prints[r.doc_id]:016x}"
        assert r.component_id == want[r.doc_id]


def test_small(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(1, None), (2, " "), (3, "One two"), (4, "one TWO"), (5, base), (6, base + " x"), (7, base.upper()), (8, "é É ß"), (9, "é É ß"), (10, "a b c " * 40_000), (11, "one")]
    verify(rows, near_duplicates(spark.createDataFrame([(*r, "c", 1) for r in rows], SCHEMA)).collect())


def test_repeated_rows_and_empty(spark):
    got = near_duplicates(spark.createDataFrame([(1, "a b c", "", 0), (1, "a b c", "", 0), (None, "q", "", 0)], SCHEMA)).collect()
    assert sorted((r.doc_id or -1, r.component_id) for r in got if r.doc_id) == [(1, 1), (1, 1)] and len(got) == 3
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_links_connect_what_is_near_in_any_block_size(spark):
    rng = np.random.default_rng(3)
    values = set()
    for centre in rng.integers(0, 1 << 63, 12, dtype=np.uint64).tolist():
        for _ in range(60):
            v = centre
            for bit in rng.integers(0, 64, rng.integers(0, 5)).tolist():
                v ^= 1 << bit
            values.add(v)
    want = brute_components({v: v for v in values})
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    for block in (8192, 16):
        roots = {r.node: r.root for r in components(links(spark.createDataFrame(signed, "fp long"), block)).collect()}
        groups: dict = {}
        for (s,) in signed:
            groups.setdefault(roots.get(s, s), set()).add(s % (1 << 64))
        expected: dict = {}
        for v, root in want.items():
            expected.setdefault(root, set()).add(v)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_chain_of_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 101: 100}


def test_whole_table(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    verify([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], near_duplicates(docs).collect())
    assert fingerprint(None) == 0
