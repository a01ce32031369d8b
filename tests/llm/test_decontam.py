import random
import time

from admitflow.llm.decontam import EDITS, decontaminate, find, find_leaks, index, normal
from admitflow.session import read

DOCS, ITEMS = "doc_id long, text string, item_id int, edits string", "item_id long, text string, doc_id int"


def distance(item, text):
    """Fewest edits between item and any stretch of text, by the whole table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def edit(rng, text, n):
    chars = list(text)
    for _ in range(n):
        k = rng.randrange(len(chars))
        if (how := rng.randrange(3)) == 0:
            chars[k] = rng.choice("qxzj")
        elif how == 1:
            del chars[k]
        else:
            chars.insert(k, rng.choice("qxzj"))
    return "".join(chars)


def test_against_brute_force():
    rng = random.Random(5)
    words = ["of", "the", "tion", "ander", "esti", "ronou", "thea", "le", "été"]
    say = lambda n: " ".join(rng.choice(words) + rng.choice(words) for _ in range(n))
    items = [(k, say(rng.randrange(4, 14))) for k in range(12)]
    texts = [say(30) for _ in range(10)]
    for k in range(60):
        i, t = items[k % 12]
        texts.append(f"{say(rng.randrange(12))} {edit(rng, t, rng.randrange(0, max(1, len(t) // 8)))} {say(rng.randrange(12))}")
    ready = index(items)
    budgets = dict(zip(ready.ids, ready.edits.tolist(), strict=True))
    for text, hits in zip(texts, find(texts, ready), strict=True):
        want = {i for i, t in items if distance(normal(t), normal(text)) <= budgets[i]}
        assert {h[0] for h in hits} == want
        for i, a, b, edits in hits:
            assert edits == distance(normal(dict(items)[i]), normal(text[a:b]))
            assert edits <= EDITS * len(dict(items)[i])


def test_small(spark):
    item = "The quick brown fox jumps over the lazy dog, and then it sleeps."
    docs = spark.createDataFrame(
        [(1, None, 0, ""), (2, "", 0, ""), (3, item, 0, ""), (3, item, 0, ""), (4, "x " * 60_000 + item.upper() + " y" * 10, 0, ""), (5, item[:40], 0, ""), (6, f"a {item} b {item}", 0, ""), (None, item.replace("lazy", "lzy\n"), 0, "")],
        DOCS,
    )
    items = spark.createDataFrame([(7, item, 0), (8, None, 0), (9, "short", 0), (10, "", 0)], ITEMS)
    hits = sorted((r.doc_id or 0, r.item_id, r.start, r.end, r.edits) for r in find_leaks(docs, items).collect())
    n = len(item)
    assert hits[1:] == [(3, 7, 0, n, 0), (3, 7, 0, n, 0), (4, 7, 120_000, 120_000 + n, 0), (6, 7, 2, 2 + n, 0), (6, 7, 5 + n, 5 + 2 * n, 0)]
    assert hits[0][:2] == (0, 7) and hits[0][4] == 2  # a letter less, a space more
    kept = decontaminate(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 5]
    assert sorted((r.doc_id or 0, r.item_id, r.start, r.end, r.edits) for r in find_leaks(docs, items.union(items.limit(0)), block_chars=10).collect()) == hits


def test_empty(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    one = spark.createDataFrame([(1, "some text that is long enough", 0, "")], DOCS)
    assert find_leaks(docs, items).count() == 0 and find_leaks(one, items).count() == 0
    assert decontaminate(one, items).count() == 1


def test_whole_table(spark, sf_dir):
    docs, items = read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    hits = {(r.doc_id, r.item_id) for r in find_leaks(docs, items).collect()}
    wanted = [(r.item_id, normal(r.text)) for r in items.collect()]
    for r in docs.select("doc_id", "text").collect():
        assert {i for i, t in wanted if r.text and t in normal(r.text)} <= {i for d, i in hits if d == r.doc_id}


def test_brief_items_are_found_as_whole_words(spark):
    items = spark.createDataFrame([(1, "Ab cd", 0), (2, "x", 0), (3, "Ab cd", 0), (4, "¿no?", 0)], ITEMS)
    docs = spark.createDataFrame([(1, "an AB\ncd ab cdx, zab cd", 0, ""), (2, "y x.", 0, ""), (3, "Sí ¿NO? va", 0, ""), (4, "axa", 0, "")], DOCS)
    got = sorted((r.doc_id, r.item_id, r.start, r.end, r.edits) for r in find_leaks(docs, items).collect())
    assert got == [(1, 1, 3, 8, 0), (1, 3, 3, 8, 0), (2, 2, 2, 3, 0), (3, 4, 3, 7, 0)]
    assert decontaminate(docs, items).count() == 4


def test_items_of_one_frame():
    """Thousands of items share a frame with the text; only the one that is in it is found, and soon."""
    rng = random.Random(6)
    frame = "Question: what is the {} of {}? Answer: {}"
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(9))
    items = [(k, frame.format(word(), word(), word())) for k in range(4000)]
    ready = index(items)
    texts = [f"{frame.format(word(), word(), word())} and {edit(rng, items[77 + k][1], 2)} so" for k in range(4)]
    began = time.perf_counter()
    assert [[h[0] for h in hits] for hits in find(texts, ready)] == [[77], [78], [79], [80]]
    assert time.perf_counter() - began < 20
