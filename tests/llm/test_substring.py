import hashlib
import random
import re

import pytest

from admitflow.llm.substring import SuffixAutomaton, remove_repeats
from admitflow.session import read

SCHEMA = "doc_id long, text string, row long, spans string"


def brute(docs):
    """(id, text) rows to (id, n_words, n_removed, digest), by a table of all windows."""
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in docs]
    least: dict = {}
    for i, words in split:
        for at in range(len(words) - 49):
            w = tuple(words[at : at + 50])
            if i is not None and least.get(w, i) >= i:
                least[w] = i
    out = []
    for i, words in split:
        gone = set()
        for at in range(len(words) - 49):
            if i is not None and least[tuple(words[at : at + 50])] < i:
                gone.update(range(at, at + 50))
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def key(r):
    return (r[0] is None, r[0] or 0, *r[1:])


def check(spark, docs, **options):
    got = remove_repeats(spark.createDataFrame([(*d, 1, "c") for d in docs], SCHEMA), **options).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=key) == sorted(brute(docs), key=key)
    for r in got:
        assert hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256


def corpus():
    rng = random.Random(2)
    say = lambda n: [f"w{rng.randrange(40)}é" for _ in range(n)]
    passage, base = say(70), say(300)
    docs = []
    for i in range(40):
        docs.append((i, " ".join(say(rng.randrange(5, 60)) + passage[rng.randrange(4) : 66 + rng.randrange(4)] + say(rng.randrange(60)))))
    for i in range(40, 60):
        near = list(base)
        near[rng.randrange(300)] = "edit"
        docs.append((i, "\n".join(near[rng.randrange(3) :])))
    docs += [(60 + k, " ".join(base)) for k in range(4)]
    docs += [(70, None), (71, ""), (72, "few words"), (73, " \x0b".join(say(49))), (74, " ".join(["same"] * 400)), (75, " ".join(["same"] * 120)), (76, "x " * 30_000)]
    docs += [(80, " ".join(base[:100])), (80, " ".join(base[:100])), (80, " ".join(say(80))), (None, " ".join(base)), (None, " ".join(base)), (5, " ".join(base[50:150]))]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("shard_texts", [256, 2])
def test_against_brute_force(spark, shard_texts):
    check(spark, corpus(), shard_texts=shard_texts)


@pytest.mark.parametrize("shard_texts", [256, 1])
def test_stretch_repeated_within_its_least_document(spark, shard_texts):
    rng = random.Random(9)
    say = lambda n: [f"v{rng.randrange(5000)}" for _ in range(n)]
    docs = []
    for k in range(0, 60, 3):
        passage = say(60)
        copy = say(60) + passage + say(60)
        docs += [(k + 1, " ".join(say(60) + passage + say(60))), (k + 2, " ".join(copy + copy)), (k + 2, " ".join(say(70) + copy + say(9)))]
    check(spark, docs, shard_texts=shard_texts)


def test_empty(spark):
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_automaton():
    rng = random.Random(4)
    for _ in range(60):
        texts = [[rng.randrange(3) for _ in range(rng.randrange(1, 14))] for _ in range(4)]
        a = SuffixAutomaton()
        for label, t in enumerate(texts):
            a.add(t, label)
        a.settle()
        for label, t in enumerate(texts):
            for size in (1, 2, 3, 5):
                want = [at for at in range(len(t) - size + 1) if any(t[at : at + size] == u[k : k + size] for u in texts[:label] for k in range(len(u)))]
                assert a.repeats(t, label, size) == want


def test_whole_table(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in remove_repeats(docs, with_text=False).collect()]
    assert sorted(got) == sorted(brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]))
