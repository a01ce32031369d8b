import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from admitflow.llm.mixing import DIMS, fit_topics, frequent_terms, mix, pair_counts, places, rake, topic
from admitflow.session import read

SCHEMA = "doc_id long, text string, source string, lang string, share double, tokens string"
COLS = [f"mix_{d}" for d in DIMS]


def brute(rows, targets, flatten=0.5, share=0.5):
    """Probability by cell, raked in numpy. rows: (source, lang, topic, tokens)."""
    values = [sorted({r[k] for r in rows}) for k in range(3)]
    table = np.zeros([len(v) for v in values])
    for r in rows:
        table[tuple(values[k].index(r[k]) for k in range(3))] += r[3]
    total = table.sum()
    w = table / total
    want = []
    for k, d in enumerate(DIMS):
        axes = tuple(x for x in range(3) if x != k)
        t = np.array([targets[d][v] for v in values[k]]) if d in targets else (w**flatten).sum(axis=axes)
        t = np.where(w.sum(axis=axes) > 0, t, 0)
        want.append(t / t.sum())
    for _ in range(100_000):
        for k in range(3):
            shape = [1, 1, 1]
            shape[k] = -1
            now = w.sum(axis=tuple(x for x in range(3) if x != k))
            w = w * np.divide(want[k], now, out=np.zeros_like(now), where=now > 0).reshape(shape)
        now = [w.sum(axis=tuple(x for x in range(3) if x != k)) for k in range(3)]
        if max(np.abs(np.divide(a, b, out=np.ones_like(a), where=b > 0) - 1).max() for a, b in zip(now, want, strict=True)) < 1e-9:
            break
    else:
        raise AssertionError("the brute force has not met its targets")
    rate = np.divide(w, table, out=np.zeros_like(w), where=table > 0)
    low, high = 0.0, total * 1e6
    for _ in range(300):
        mid = (low + high) / 2
        low, high = (mid, high) if (np.minimum(1, mid * rate) * table).sum() < share * total else (low, mid)
    p = np.minimum(1, low * rate)
    return lambda s, la, t: p[values[0].index(s), values[1].index(la), values[2].index(t)]


def check(got, targets):
    p = brute([(*[r[c] for c in COLS], r.mix_tokens) for r in got], targets)
    for r in got:
        assert r.mix_probability == pytest.approx(p(*[r[c] for c in COLS]), abs=1e-4)


def test_small(spark):
    rows = [(i, "word " * (1 + i % 7) + ("a | b" if i % 3 else "x"), f"s{i % 4}", ["en", "de"][i % 5 > 1], 1.0, "t") for i in range(400)]
    rows += [(1000, None, "s1", "en", 0.0, ""), (1001, "", None, None, 0.0, ""), (1002, "word " * 30_000, "s2", None, 0.0, ""), (1002, "word " * 30_000, "s2", None, 0.0, ""), (None, "a b", "s3", "de", 0.0, "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mix(docs)
    assert got.columns[: len(docs.columns)] == docs.columns
    got = got.collect()
    assert len(got) == len(rows)
    check(got, {})
    assert len({r.mix_sampled for r in got if r.doc_id == 1002}) == 1
    targets = {"lang": {"en": 0.7, "de": 0.2, "unknown": 0.1}}
    check(mix(docs, targets).collect(), targets)
    with pytest.raises(ValueError, match="no positive target"):
        mix(docs, {"lang": {"en": 1.0}})


def test_empty(spark):
    assert mix(spark.createDataFrame([], SCHEMA)).count() == 0
    assert mix(spark.createDataFrame([(1, None, "s", "en", 0.0, "")], SCHEMA)).first().mix_sampled is False


def test_whole_table(spark, sf_dir):
    got = mix(read(spark, sf_dir, "documents"))
    check(got.collect(), {})
    kept = got.agg((F.sum(F.expr("mix_tokens * mix_probability")) / F.sum("mix_tokens")).alias("e"), (F.sum(F.expr("if(mix_sampled, mix_tokens, 0)")) / F.sum("mix_tokens")).alias("s")).first()
    assert kept.e == pytest.approx(0.5, abs=1e-4) and 0.2 < kept.s < 0.8


def test_topics_are_groups_of_terms(spark):
    """Terms that stand together are one topic, whichever of them a document has."""
    themes = [["engines", "pistons", "gearbox"], ["gardens", "flowers", "compost"], ["sonatas", "violins", "quartet"], ["harvest", "tractor", "granary"]]
    rows = [(i, ("filler " * 3 + " ".join(themes[i % 4][k] for k in range(3) if k != i // 4 % 3) + " ") * 4, "s", "en", 0.0, "") for i in range(120)]
    rows += [(200 + i, f"filler {t[2]} and more", "s", "en", 0.0, "") for i, t in enumerate(themes)]
    rows += [(300, "nothing of these", "s", "en", 0.0, ""), (301, None, "s", "en", 0.0, "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    known = fit_topics(docs, n=4)
    assert {t: known[t][0] for theme in themes for t in theme} == {t: known[theme[0]][0] for theme in themes for t in theme} and len({v[0] for v in known.values()}) == 4
    got = {r.doc_id: r.t for r in docs.select("doc_id", topic(F.col("text"), known).alias("t")).collect()}
    assert all(got[i] == known[themes[i % 4][0]][0] for i in range(120)) and all(got[200 + i] == known[t[0]][0] for i, t in enumerate(themes)) and got[300] is None and got[301] is None


def test_topics_are_counted_over_all_rows(spark):
    """Counts of terms and of their pairs are those of the whole table, whatever its size."""
    stems = ["alpha", "gamma", "delta", "theta", "kappa", "sigma", "omega"]
    texts = [" ".join(s + "abcdefghi"[i // (k + 2) % 9] for k, s in enumerate(stems)) + " twice" * (2 * (i % 5 == 0)) for i in range(9001)] + [None, ""]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = [set((t or "").split()) for t in texts]
    many = Counter(w for f in found for w in f)
    known = fit_topics(docs, n=5)
    assert {w: v[1] for w, v in known.items()} == {w: pytest.approx(math.log(len(texts) / k), rel=1e-12) for w, k in many.items()}
    assert frequent_terms(docs) == ({w: many[w] for w in known}, len(texts))
    names = list(known)
    pairs = Counter((a, b) for f in found for a in f for b in f if names.index(a) < names.index(b))
    got = pair_counts(docs.select(places(F.col("text"), names).alias("places"))).collect()
    assert {(names[r.a], names[r.b]): r.n for r in got} == pairs


def test_most_documents_have_a_topic(spark, sf_dir):
    got = mix(read(spark, sf_dir, "documents")).where("mix_tokens >= 50").groupBy().agg(F.avg(F.expr("if(mix_topic = 'unknown', 1, 0)")).alias("none"), F.countDistinct("mix_topic").alias("n")).first()
    assert got.none < 0.05 and got.n > 6


def test_many_cells_are_joined(spark):
    rows = [(i, "word " * (1 + i % 7), f"s{i % 4}", ["en", "de"][i % 5 > 1], 1.0, "t") for i in range(200)]
    docs = spark.createDataFrame(rows, SCHEMA)
    check(mix(docs, small_cells=0).collect(), {})


def test_results_replace_columns_of_their_names(spark):
    docs = spark.createDataFrame([(1, "a b c", "s", "en", 7, "x")], "doc_id long, text string, source string, lang string, Mix_Tokens long, mix_id string")
    got = mix(docs)
    assert len({c.lower() for c in got.columns}) == len(got.columns) and got.first()["mix_tokens"] == 3 and got.first()["mix_id"] == "x"


def test_targets_that_cannot_be_met_are_named(spark):
    docs = spark.createDataFrame([(1, "a b c", "s1", "en", 0.0, ""), (2, "a b c", "s2", "de", 0.0, "")], SCHEMA)
    targets = {"source": {"s1": 0.9, "s2": 0.1}, "lang": {"en": 0.1, "de": 0.9}}
    with pytest.raises(RuntimeError, match="can't be met .*source s2"):
        mix(docs, targets, strict=True)
    with pytest.warns(UserWarning, match="source s1 is off by"):
        assert mix(docs, targets).count() == 2


def test_slow_targets_are_met_all_the_same(spark):
    """Cells that hardly connect take many rounds: no limit ends them early."""
    cells = spark.createDataFrame([("a", "x", "t", 1000), ("a", "y", "t", 20), ("b", "y", "t", 1000), ("b", "z", "t", 20), ("c", "z", "t", 1000), ("c", "x", "t", 30)], "mix_source string, mix_lang string, mix_topic string, tokens long")
    targets = {"mix_source": {"a": 0.5, "b": 0.3, "c": 0.2}, "mix_lang": {"x": 0.4, "y": 0.3, "z": 0.3}}
    rows = rake(cells, tuple(COLS), targets, strict=True).collect()
    for d, want in targets.items():
        for v, t in want.items():
            assert sum(r.share for r in rows if r[d] == v) == pytest.approx(t, rel=2e-5)
