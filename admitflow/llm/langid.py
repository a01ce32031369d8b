"""Language ID by word-first backoff.

A known word is scored by its log frequency in each language. An unseen word
falls back to the longest of its character n-grams that the model knows, from
``LONGEST`` characters down to one, with less weight for shorter ones.

The classifier is fitted on a bounded sample: about ``sample_docs`` labelled
documents of each language, taken by a hash of the id; where it is None, on all of
them. The model holds at most
``MAX_MODEL`` entries (a term's count in a language), dealt evenly to languages
and kinds, and at most ``max_entries`` of a kind in a language, the most frequent
ones; the rest of the counted terms back off as unseen words do. It is kept
sparse, so that is the size of its broadcast, whatever the number of languages.
Every document is predicted from its whole text.

Defined results: null text, or text without letters, is ``und`` with score 0;
so is every text where nothing could be learned. Ties go to the language first
in the alphabet. Ids that are null count as neither held out nor training
data. Repeated rows are predicted each on their own; an empty table gives no
rows; columns other than the id, text and lang are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LETTERS = re.compile(r"[^\W\d_]+")
LONGEST = 4
#: Weight of a score from an n-gram, by its length; a word's own weight is 1.
WEIGHTS = {n: 0.7 ** (LONGEST + 1 - n) for n in range(1, LONGEST + 1)}
SAMPLE_DOCS, MAX_ENTRIES, MAX_MODEL, MAX_LANGS = 3000, 40_000, 4_000_000, 400
#: Scores that a task remembers (words times languages), and words that count towards the confidence.
REMEMBERED, CONFIDENT_WORDS = 4_000_000, 50
#: Terms times languages of a kind that a task writes out at most (4 bytes each).
DENSE = 4_000_000
#: Parts that the terms of a kind in a language are first ranked in, where they come from all documents.
PARTS = 64
UNKNOWN = "und"


def held_out(doc_id: Column) -> Column:
    """The test fold: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def grams(word: str, n: int) -> list[str]:
    padded = f"^{word}$" if n > 1 else word
    return [padded[i : i + n] for i in range(max(1, len(padded) - n + 1))]


def count_terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(lang, kind, term, n) of the batches; kind 0 is a word, n is an n-gram of n characters."""
    for batch in batches:
        words: dict[str, Counter] = {}
        for text, lang in zip(batch["text"], batch["lang"], strict=True):
            words.setdefault(lang, Counter()).update(LETTERS.findall(text.lower()))
        rows = []
        for lang, counts in words.items():
            for n in range(1, LONGEST + 1):
                found: Counter = Counter()
                for word, times in counts.items():
                    for gram in grams(word, n):
                        found[gram] += times
                rows += [(lang, n, gram, times) for gram, times in found.items()]
            rows += [(lang, 0, word, times) for word, times in counts.items()]
        yield pd.DataFrame(rows, columns=["lang", "kind", "term", "n"])


class Model:
    """Log frequencies by language, sparse: for each kind the terms' places, and what their languages have above an unseen term."""

    def __init__(self, langs: list[str], kinds: Iterator[tuple[int, pd.DataFrame]]):
        """kinds: the terms of one kind at a time, as lang, term and n."""
        self.langs = sorted(langs)
        self.tables: dict[int, tuple[dict[str, int], np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for kind, own in kinds:
            if kind == 0:  # a word seen once says less than its n-grams
                own = own[own.groupby("term")["n"].transform("sum") > 1]
            own = own.sort_values("term", kind="stable")
            names = own["term"].to_numpy(object)
            first = np.flatnonzero(np.append(True, names[1:] != names[:-1])[: len(names)])
            terms = names[first]
            lang, n = np.searchsorted(self.langs, own["lang"].to_numpy(str)), own["n"].to_numpy(float)
            total = np.bincount(lang, n, minlength=len(self.langs)) + 0.5 * len(terms)
            unseen = np.log(0.5) - np.log(np.maximum(total, 0.5))
            more = (np.log(n + 0.5) - np.log(0.5)).astype(np.float32)
            self.tables[kind] = dict(zip(terms.tolist(), range(len(terms)), strict=True)), np.append(first, len(own)), lang.astype(np.int32), more, unseen
        self.forget()

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("full", "memory", "remembered")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.forget()

    @cached_property
    def full(self) -> dict[int, np.ndarray]:
        """The kinds whose terms x languages are few enough to be written out in a task; the others are scored from their entries."""
        out = {}
        for kind, (terms, first, lang, more, unseen) in self.tables.items():
            if len(terms) * len(self.langs) <= DENSE:
                scores = np.tile(unseen.astype(np.float32), (len(terms), 1))
                scores[np.repeat(np.arange(len(terms)), np.diff(first)), lang] += more
                out[kind] = scores - scores.max(axis=1, keepdims=True) if len(terms) else scores
        return out

    def scores(self, kind: int, places: list[int]) -> np.ndarray:
        """The terms' log frequencies relative to each one's likeliest language."""
        if (full := self.full.get(kind)) is not None:
            return full[places]
        _, first, lang, more, unseen = self.tables[kind]
        out = np.tile(unseen.astype(np.float32), (len(places), 1))
        for row, k in enumerate(places):
            out[row, lang[first[k] : first[k + 1]]] += more[first[k] : first[k + 1]]
        return out - out.max(axis=1, keepdims=True)

    def forget(self) -> None:
        self.memory: dict[str, int] = {}
        self.remembered = np.zeros((0, len(self.langs)), np.float32)

    def word(self, word: str) -> np.ndarray:
        """Log frequencies relative to the likeliest language."""
        for n in (0, *range(min(LONGEST, len(word) + 2), 0, -1)):
            places = self.tables[n][0] if n in self.tables else {}
            found = [k for gram in ([word] if n == 0 else grams(word, n)) if (k := places.get(gram)) is not None]
            if found:
                return WEIGHTS.get(n, 1.0) * self.scores(n, found).mean(axis=0)
        return np.zeros(len(self.langs), np.float32)

    def words(self, words: np.ndarray) -> np.ndarray:
        if len(self.memory) * len(self.langs) > REMEMBERED:
            self.forget()
        new = [w for w in words if w not in self.memory]
        if new:
            self.memory.update(zip(new, range(len(self.memory), len(self.memory) + len(new)), strict=True))
            self.remembered = np.concatenate([self.remembered, [self.word(w) for w in new]]).astype(np.float32)
        return self.remembered[[self.memory[w] for w in words]]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        split = [LETTERS.findall(t.lower()) if t else [] for t in texts]
        lengths = np.array([len(x) for x in split])
        langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.langs or not lengths.sum():
            return langs, scores
        codes, unique = pd.factorize(np.array([w for x in split for w in x], dtype=object))
        by_word = self.words(unique)
        full = np.flatnonzero(lengths)
        starts = np.concatenate([[0], np.cumsum(lengths[full])[:-1]])
        sums = np.column_stack([np.add.reduceat(by_word[:, k][codes].astype(float), starts) for k in range(len(self.langs))])
        best = sums.argmax(axis=1)
        scaled = (sums - sums.max(axis=1, keepdims=True)) * np.minimum(1, CONFIDENT_WORDS / lengths[full])[:, None]
        chance = 1 / np.exp(scaled).sum(axis=1)
        scores[full] = np.clip(chance, 0, 1)
        for i, k in zip(full.tolist(), best.tolist(), strict=True):
            langs[i] = self.langs[k]
        return langs, scores


def fit(docs: DataFrame, sample_docs: int | None = SAMPLE_DOCS, max_entries: int = MAX_ENTRIES, max_model: int = MAX_MODEL, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learns from text and lang of labelled documents outside the test fold: about ``sample_docs`` of each language, or all where it is None."""
    known = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    known = known.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = known.groupBy("lang").count().limit(MAX_LANGS + 1).collect()  # one row a language
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"over {MAX_LANGS} languages")
    if not sizes:
        return Model([], iter(()))
    if sample_docs is not None:
        share = {r["lang"]: min(1.0, sample_docs / r["count"]) for r in sizes}
        dealt = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
        wanted = F.create_map(*[F.lit(x) for pair in share.items() for x in pair])
        known = known.where(dealt < F.element_at(wanted, F.col("lang")))
    counts = known.select("text", "lang").mapInPandas(count_terms, "lang string, kind int, term string, n long").groupBy("lang", "kind", "term").agg(F.sum("n").alias("n"))
    max_entries = min(max_entries, max(1, max_model // (len(sizes) * (LONGEST + 1))))
    part = F.pmod(F.hash("term"), F.lit(PARTS))
    # a term among the most frequent ones is also among those of its part, so no task ranks all terms of a language
    for by in ([("lang", "kind", part)] if sample_docs is None else []) + [("lang", "kind")]:
        top = Window.partitionBy(*by).orderBy(F.desc("n"), "term")
        counts = counts.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= max_entries).drop("rank")
    table = counts.toArrow()
    by_kind = ((k, table.filter(pc.equal(table["kind"], k)).select(["lang", "term", "n"]).to_pandas()) for k in range(LONGEST + 1))
    return Model([r["lang"] for r in sizes], by_kind)


PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double"


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred and score (0 to 1) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                langs, scores = model.predict(part.column(2).to_pylist())
                yield pa.record_batch([part.column(0), part.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return given.mapInArrow(run, PREDICTED)


def identify(docs: DataFrame, **options) -> DataFrame:
    """Fits on the labelled documents outside the test fold and predicts all."""
    return predict(docs, fit(docs, **options))


def keep_identified(docs: DataFrame, least_score: float = 0.5, text_col: str = "text", **options) -> DataFrame:
    """The documents, with all their columns, whose language is known with at least ``least_score``."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, text_col=text_col, **options))
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                langs, scores = model.predict(part.column(place).to_pylist())
                yield part.filter(pa.array((np.array(langs) != UNKNOWN) & (scores >= least_score), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
