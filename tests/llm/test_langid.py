import math
import pickle
import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd

from admitflow.llm.langid import LETTERS, LONGEST, WEIGHTS, Model, fit, grams, identify, predict
from admitflow.session import read

SCHEMA = "doc_id long, text string, lang string, score int"


def test_small(spark):
    rows = [(i, f"the house of the river {i}", "en", 0) for i in range(30)] + [(i, f"das Haus am Fluß {i}", "de", 0) for i in range(30, 60)]
    rows += [(100, None, "en", 0), (101, "", "en", 0), (102, "12 34 !!", "de", 0), (103, "Hausfluß", None, 0), (104, "rivers houses", "zz", 0), (105, "the " * 50_000, None, 0), (105, "the " * 50_000, None, 0), (None, "the", "en", 0)]
    got = identify(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (100, 101, 102))
    assert by[103].lang_pred == "de" and by[104].lang_pred in ("en", "zz") and by[105].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)


def test_empty(spark):
    assert identify(spark.createDataFrame([], SCHEMA)).count() == 0
    assert identify(spark.createDataFrame([(1, "word", None, 0)], SCHEMA).select("doc_id", "text", "lang")).first().lang_pred == "und"


def test_backoff_uses_the_longest_known_gram():
    counts = pd.DataFrame([("a", 0, "foo", 9), ("b", 0, "bar", 9), ("a", 3, "^xy", 5), ("b", 2, "yz", 5), ("a", 2, "vv", 5), ("a", 1, "q", 4), ("b", 1, "r", 4)], columns=["lang", "kind", "term", "n"])
    model = Model(["b", "a"], ((k, own) for k, own in counts.groupby("kind")))
    assert model.word("foo").argmax() == 0 and model.word("bar").argmax() == 1
    assert model.word("xyz").argmax() == 0  # its 3-gram decides, not its 2-gram
    assert model.word("wyz").argmax() == 1
    assert model.word("rr").argmax() == 1


def test_held_out_accuracy(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    held = [r for r in identify(docs).collect() if r.held_out and r.lang_pred != "und" and truth[r.doc_id]]
    assert sum(truth[r.doc_id] == r.lang_pred for r in held) > 0.9 * len(held)


def brute_predict(rows, text, sample):
    """The language of the highest score by plain dictionaries. rows: (text, lang) of the training fold."""
    counts: dict = {}
    for t, lang in sample:
        for w in LETTERS.findall(t.lower()):
            counts.setdefault(0, Counter())[w, lang] += 1
            for n in range(1, LONGEST + 1):
                for g in grams(w, n):
                    counts.setdefault(n, Counter())[g, lang] += 1
    langs = sorted({lang for _, lang in sample})
    often = Counter()
    for (w, _), n in counts[0].items():
        often[w] += n
    counts[0] = Counter({k: n for k, n in counts[0].items() if often[k[0]] > 1})
    vocabulary = {k: {t for t, _ in c} for k, c in counts.items()}
    size = {k: {la: sum(n for (_, x), n in c.items() if x == la) + 0.5 * len(vocabulary[k]) for la in langs} for k, c in counts.items()}

    def of(kind, term):
        row = [math.log((counts[kind][term, la] + 0.5) / size[kind][la]) for la in langs]
        return [x - max(row) for x in row]

    total = [0.0] * len(langs)
    for w in LETTERS.findall(text.lower()):
        for n in (0, *range(min(LONGEST, len(w) + 2), 0, -1)):
            found = [g for g in ([w] if n == 0 else grams(w, n)) if g in vocabulary[n]]
            if found:
                each = [of(n, g) for g in found]
                total = [a + (1 if n == 0 else WEIGHTS[n]) * sum(e[k] for e in each) / len(each) for k, a in enumerate(total)]
                break
    return langs[max(range(len(langs)), key=lambda k: total[k])], total


def test_against_brute_force(spark):
    rng = random.Random(4)
    roots = {"en": ["house", "river", "thing", "walk"], "de": ["haus", "fluss", "ding", "gang"], "fr": ["maison", "fleuve", "chose", "marche"]}
    rows = []
    for i in range(90):
        lang = ["en", "de", "fr"][i % 3]
        rows.append((i, " ".join(rng.choice(roots[lang]) + rng.choice(["", "s", "en", "er", "e"]) for _ in range(8)), lang, 0))
    rows += [(200 + k, " ".join(rng.choice(sum(roots.values(), [])) + rng.choice("xyz") for _ in range(6)), None, 0) for k in range(20)]
    sample = [(t, la) for i, t, la, _ in rows if la and zlib.crc32(str(i).encode()) % 5]
    for r in identify(spark.createDataFrame(rows, SCHEMA)).collect():
        lang, total = brute_predict(rows, dict((i, t) for i, t, _, _ in rows)[r.doc_id], sample)
        if sorted(total)[-1] - sorted(total)[-2] > 1e-4:
            assert r.lang_pred == lang


def test_many_languages_are_bounded(spark):
    rows = [(i, f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)} common", f"l{i % 300:03d}", 0) for i in range(1800)]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = fit(docs, max_model=3000)
    assert len(model.langs) == 300 and sum(len(t[2]) for t in model.tables.values()) <= 3000
    assert predict(docs, model).where("lang_pred = 'und'").count() == 0
    sparse = pickle.loads(pickle.dumps(model))
    sparse.full = {}
    for word in ("wordaa", "common", "worzz", "q", "commons"):
        assert np.allclose(model.word(word), sparse.word(word), atol=1e-4)


def test_fit_on_all_documents(spark):
    """Without a sample the model holds the counts of all labelled documents outside the test fold, the most frequent terms first."""
    rng = random.Random(9)
    rows = [(i, " ".join(f"w{chr(97 + rng.randrange(26))}{chr(97 + int(26 * rng.random() ** 2))}" for _ in range(3)), ["en", "de"][i % 2], 0) for i in range(9000)]
    words = Counter((lang, w) for i, t, lang, _ in rows if zlib.crc32(str(i).encode()) % 5 for w in t.split())
    docs = spark.createDataFrame(rows, SCHEMA)
    for most in (40_000, 100):
        ranked = {la: sorted((-n, w) for (x, w), n in words.items() if x == la)[:most] for la in ("de", "en")}
        terms, first, lang, more, _ = fit(docs, sample_docs=None, max_entries=most).tables[0]
        got = {(("de", "en")[lang[j]], w): more[j] for w, k in terms.items() for j in range(first[k], first[k + 1])}
        assert got.keys() == {(la, w) for la, own in ranked.items() for _, w in own}
        assert all(math.isclose(v, math.log((words[k] + 0.5) / 0.5), rel_tol=1e-5) for k, v in got.items())
