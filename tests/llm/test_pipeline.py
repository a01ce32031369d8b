import random
import zlib

import corpus_pipeline
from admitflow.llm.decontam import find, index
from admitflow.llm.simhash import keep_one
from admitflow.session import read


def similar(texts, least):
    """Pairs of ids (in order) with their Jaccard similarity over sets of 5-word shingles."""
    sets, where = {}, {}
    for i, t in texts.items():
        words = (t or "").lower().split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}
        for s in sets[i]:
            where.setdefault(s, []).append(i)
    pairs = {(i, j) for ids in where.values() for i in ids for j in ids if i < j}
    found = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i, j in pairs}
    return {k: v for k, v in found.items() if v >= least}


def test_near_copies_in_any_block_size(spark):
    rng = random.Random(5)
    say = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    docs = [(k, " ".join(say(rng.randrange(1, 300)))) for k in range(60)]
    for g in range(12):
        base = say(200)
        for k in range(12):
            copy = list(base)
            for _ in range(g % 4):
                copy[rng.randrange(200)] = "edit"
            docs.append((100 + 20 * g + k, " ".join(copy)))
    alike = similar(dict(docs), 0.8)
    texts = spark.createDataFrame(docs, "doc_id long, text string")
    for block in (8192, 5):
        kept = {r.doc_id for r in keep_one(texts, block=block).collect()}
        assert kept == {k for k in range(60)} | {100 + 20 * g for g in range(12)}
        assert not [p for p in alike if kept >= set(p)]


def test_keep_one_passes_any_columns(spark):
    rows = [(1, "a b c d e f", 5, {"k": "v"}), (1, "a b c d e f", 5, {"k": "v"}), (1, "a b c d e f", 6, {"k": "v"}), (2, "A b c d e f", 7, None), (3, None, 8, None), (4, " ", 9, None), (None, "lone text", 1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __row int, `class.fp` map<string,string>")
    for most in (2_000_000, 0):
        got = keep_one(docs, max_broadcast=most)
        assert got.dtypes == docs.dtypes
        kept = sorted((r.doc_id or 0, r["__row"]) for r in got.collect())
        assert kept in ([(0, 1), (1, 5), (3, 8)], [(0, 1), (1, 6), (3, 8)])
    assert keep_one(docs.limit(0)).count() == 0


def test_keep_one(spark):
    docs = spark.createDataFrame([(3, "a b c d", 1), (2, "A b c d", 2), (2, "A b c d", 2), (2, "other words in here entirely", 3), (None, "a b c d", 4), (None, "alone text with more words", 5), (9, None, 6), (8, "", 7)], "doc_id long, text string, label int")
    assert sorted((r.doc_id or 0, r.label) for r in keep_one(docs).collect()) == [(0, 5), (2, 2), (2, 3), (8, 7)]


def test_stages(spark, sf_dir, tmp_path):
    docs = read(spark, sf_dir, "documents")
    rows, frame = {r.doc_id: r for r in docs.collect()}, docs
    items = index([(r.item_id, r.text) for r in read(spark, sf_dir, "benchmark").collect()])
    seen = [rows]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, frame, sf_dir).write.parquet(f"{tmp_path}/{name}")
        frame = spark.read.parquet(f"{tmp_path}/{name}")
        assert frame.dtypes == docs.dtypes
        got = frame.collect()
        assert len(got) == len({r.doc_id for r in got})
        seen.append({r.doc_id: r for r in got})
    _, known, single, clean, masked = seen
    assert set(known) == {i for i, r in rows.items() if r.text and any(c.isalpha() for c in r.text)}
    alike = similar({i: r.text for i, r in known.items()}, 0.6)
    assert not [(i, j) for (i, j), v in alike.items() if v >= 0.9 and i in single and j in single]
    sure = [(i, j) for (i, j), v in alike.items() if v >= 0.8]
    assert sum(i in single and j in single for i, j in sure) <= 0.05 * len(sure)
    partners = {i for pair in alike for i in pair}
    assert set(known) - set(single) <= partners
    assert set(clean) == {i for i, hits in zip(single, find([r.text for r in single.values()], items), strict=True) if not hits}
    assert set(masked) == set(clean) and all(r.n_chars == len(r.text) for r in masked.values())
    assert all("token = \"" not in r.text for r in masked.values())
    final = corpus_pipeline.run(spark, sf_dir)
    assert final.columns[: len(docs.columns)] == docs.columns
    assert {r.doc_id for r in final.collect()} <= set(masked)


def test_stages_on_odd_tables(spark, sf_dir):
    """Nulls in any column, empty and long texts, ties, repeated rows, clashing names and an empty table."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, __row int, __secret_text string, __chars int, mix_tokens string"
    stems = {"en": ["the", "house", "river", "walks"], "de": ["das", "haus", "fluss", "geht"]}

    def say(lang, k):
        rng = random.Random(k)
        return " ".join(rng.choice(stems[lang]) + rng.choice(["", "a", "e", "i", "o"]) + rng.choice(["", "n", "r"]) for _ in range(40))

    rows = [(k, say(la, k), la, f"s{k % 2}", None, k, "x", 1, "t") for k, la in enumerate(["en", "de"] * 12)]
    rows += [(100, None, None, None, 0, 1, "x", 1, "t"), (101, "", "en", "s", 0, 1, "x", 1, "t"), (102, "12 34", "en", "s", 5, 1, "x", 1, "t"), (None, say("en", 50), None, None, None, 1, None, None, None)]
    rows += [(7, say("de", 7), "de", "s1", None, 7, "x", 1, "t")] * 2 + [(103, 'token = "abcDEF123456789" ' + say("en", 77), "en", "s", 9, 1, "x", 1, "t"), (104, "the house " * 20_000, "en", "s", 9, 1, "x", 1, "t")]
    docs = spark.createDataFrame(rows, schema)
    frame = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, sf_dir)
        assert frame.dtypes == docs.dtypes, name
        empty = stage(spark, docs.limit(0), sf_dir)
        assert empty.dtypes == docs.dtypes and empty.count() == 0
    got = {r.doc_id: r for r in frame.collect()}
    assert not {100, 101, 102} & set(got) and {103, 104, None} <= set(got) and got[7]["__row"] == 7
    assert got[103].text.startswith("[SECRET]") or "abcDEF123456789" not in got[103].text
    assert got[103].n_chars == len(got[103].text) and got[104].n_chars == 9 and got[103]["__secret_text"] == "x"
    final = corpus_pipeline.STAGES[-1][1](spark, frame, sf_dir)
    assert len({c.lower() for c in final.columns}) == len(final.columns)
    assert {r.doc_id for r in final.collect()} <= set(got)
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), sf_dir).count() == 0


def test_mixing_stage_counts_terms_over_all_rows(spark, sf_dir):
    """A topic has the name of its most frequent term, be it by one row of 6,012."""
    letters = "abcdefghijkl"
    texts = [f"alpha{letters[i % 12] * 3} omega{letters[i % 12] * 3}" for i in range(6000)] + [f"omega{c * 3}" for c in letters]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 2}") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    got = corpus_pipeline.mixing(spark, docs, sf_dir).collect()
    assert len(got) > 2000 and all(r.mix_topic == r.text.split()[-1] for r in got)


def test_language_stage_learns_from_all_documents(spark, sf_dir):
    """A document of 3 x 4,000 in its own letters is known by them alone, if it was learned from."""
    ids = [i for i in range(15_500) if zlib.crc32(str(i).encode()) % 5][:12_000]
    docs = spark.createDataFrame([(i, f"{chr(0x4E00 + k)} " * 60, ["en", "de", "fr"][k % 3]) for k, i in enumerate(ids)], "doc_id long, text string, lang string")
    assert {r.doc_id for r in corpus_pipeline.language_id(spark, docs, sf_dir).collect()} == set(ids)
