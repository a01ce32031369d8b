"""Substring dedup with suffix automata of reference shards.

A window of ``WINDOW`` = 50 words is removed if its word sequence also starts in a
document with a smaller id. Every window has an anchor: its 12-word sequence of
least hash. Equal windows have equal anchors, so all that can repeat a window
lies in the stretches around equal anchors, and consecutive windows of one
anchor form one stretch. Most stretches are settled as a whole: an anchor of one
document repeats nothing, and a stretch equal to one of a smaller document
repeats it all. The different stretches of one anchor are a reference shard:
its suffix automaton, with the least document of each state, is built where the
shard is, and the stretches stream through it for their matching statistics; a
window is removed if the state of its 50 words has a smaller document. A shard
holds each stretch once, at its least place; what is found comes back as
fingerprints, by which every place in that document loses the window.

The reference is the corpus itself, so automata aren't broadcast to all
documents (that would grow with the square of the corpus): each is built once,
where the shuffle by anchor has brought the stretches that can match it. A
shard has at most ``SHARD_TEXTS`` stretches; an anchor with more is split by
128-bit fingerprints of its windows, whose least document is a grouped minimum.

Words are ``[^\\x20\\x09-\\x0D]+`` and are compared by 64-bit hashes. Defined
results: null text has no words; documents of equal id don't remove each
other's windows; a null id is neither smaller nor larger than any, so its
document keeps all; repeated rows keep a row each; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from admitflow.session import cut

WINDOW, ANCHOR = 50, 12
#: Stretches in one automaton; more are split by window fingerprints.
SHARD_TEXTS = 256
REMEMBERED = 500_000
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


class WordHashes(dict):
    """64-bit hashes of words; forgets all beyond a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()  # bytes: the ASCII white space alone


def row_of(joined: bytes) -> int:
    """Tells apart rows of one id: the start of their words' digest."""
    return int.from_bytes(hashlib.sha256(joined).digest()[:4], "little")


class Ranges:
    """Hashes of any range of words: sums of word x power, moved back by the inverse power."""

    powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, hashes: np.ndarray, base: int = BASES[0]):
        n = len(hashes)
        known = self.powers.get(base)
        if known is None or len(known[0]) < n + 1:
            size = max(n + 1, 1 << 15)
            inverse = np.uint64(pow(base, -1, 1 << 64))
            ones = lambda b: np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)]))
            known = self.powers[base] = (ones(np.uint64(base)), ones(inverse))
        self.back = known[1]
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * known[0][:n])])

    def of(self, start: np.ndarray, length) -> np.ndarray:
        h = (self.sums[start + length] - self.sums[start]) * self.back[start]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))


def stretches(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, hash of the stretch, first window, number of windows) of consecutive windows with one anchor."""
    n = len(hashes) - WINDOW + 1
    if n < 1:
        return (np.zeros(0, np.int64),) * 4
    ranges = Ranges(hashes)
    grams = ranges.of(np.arange(len(hashes) - ANCHOR + 1), ANCHOR)
    place = np.lib.stride_tricks.sliding_window_view(grams, WINDOW - ANCHOR + 1).argmin(axis=1) + np.arange(n)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    many = np.diff(np.append(first, n))
    return grams[place[first]].view(np.int64), ranges.of(first, many + WINDOW - 1).view(np.int64), first, many


#: A place is the first window times PLACE plus the number of windows: one number is half as large to shuffle.
PLACE = 1 << 31
PARTS = "doc_id long, row long, anchor array<long>, stretch array<long>, place array<long>"
START, NUMBER = "int(shiftright(place, 31)) as start", f"int(place & {PLACE - 1}L) as n"


def hashed(words: list[bytes], memory: WordHashes) -> np.ndarray:
    return np.fromiter(map(memory.__getitem__, words), np.uint64, len(words))


def find_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memory = WordHashes()
    for batch in batches:
        rows, columns = [], [[], [], []]
        for text in batch.column(1):
            words = words_of(text.as_py())
            rows.append(row_of(b" ".join(words)) if len(words) >= WINDOW else 0)
            anchor, stretch, first, many = stretches(hashed(words, memory) if len(words) >= WINDOW else np.zeros(0, np.uint64))
            for column, values in zip(columns, (anchor, stretch, first * PLACE + many), strict=True):
                column.append(values)
        offsets = pa.array(np.cumsum([0] + [len(x) for x in columns[0]]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, np.int64), *c]))) for c in columns]
        yield pa.record_batch([batch.column(0), pa.array(rows, pa.int64()), *lists], names=["doc_id", "row", "anchor", "stretch", "place"])


SLICES = "anchor long, doc_id long, row long, start int, words array<long>, print_a long, print_b long"


def slice_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of the wanted stretches; for crowded anchors a fingerprint of each window instead."""
    memory = WordHashes()
    for batch in batches:
        out: list[tuple] = []
        for doc, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            words = words_of(text.as_py())
            row = row_of(b" ".join(words)) if len(words) >= WINDOW else 0
            wanted = [w for w in wanted if w["row"] == row]
            if not wanted:
                continue
            hashes = hashed(words, memory)
            prints = None
            for w in wanted:
                start, n = w["start"], w["n"]
                if not w["crowded"]:
                    out.append((w["anchor"], doc, row, start, hashes[start : start + n + WINDOW - 1].view(np.int64), None, None))
                    continue
                prints = prints or [Ranges(hashes, b) for b in BASES]
                at = np.arange(start, start + n)
                a, b = (p.of(at, WINDOW).view(np.int64).tolist() for p in prints)
                out += [(w["anchor"], doc, row, k, None, x, y) for k, x, y in zip(at.tolist(), a, b, strict=True)]
        columns = list(zip(*out, strict=True)) or [()] * 7
        kinds = (*[pa.int64()] * 3, pa.int32(), pa.list_(pa.int64()), pa.int64(), pa.int64())
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in SLICES.split(", ")])


class SuffixAutomaton:
    """All substrings of several word sequences; ``least`` is the smallest label of a state's occurrences."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.least = [-1], [0], [None]

    def _state(self, length: int, link: int, arrows: dict[int, int]) -> int:
        self.next.append(arrows)
        self.length.append(length)
        self.link.append(link)
        self.least.append(None)
        return len(self.next) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        """A copy of q that holds only what is reached from p by one word."""
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def add(self, words: list[int], label: int) -> None:
        last = 0
        for word in words:
            q = self.next[last].get(word)
            if q is not None:  # known from an earlier sequence
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, word, q)
            else:
                p, new = last, self._state(self.length[last] + 1, 0, {})
                while p >= 0 and word not in self.next[p]:
                    self.next[p][word] = new
                    p = self.link[p]
                if p >= 0:
                    q = self.next[p][word]
                    self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
                last = new
            if self.least[last] is None or label < self.least[last]:
                self.least[last] = label

    def settle(self) -> None:
        """Hands the labels on to the shorter suffixes."""
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            up, label = self.link[state], self.least[state]
            if up > 0 and (self.least[up] is None or label < self.least[up]):
                self.least[up] = label

    def repeats(self, words: list[int], label: int, size: int) -> list[int]:
        """Starts of the windows of ``size`` words that occur under a smaller label, by matching statistics."""
        state = length = 0
        found = []
        for at, word in enumerate(words):
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state, length = self.next[state][word], length + 1
            while self.length[self.link[state]] >= size if state else False:
                state = self.link[state]
                length = self.length[state]
            if length >= size and self.least[state] is not None and self.least[state] < label:
                found.append(at - size + 1)
        return found


def search_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for texts in batch.column(0).to_pylist():
            automaton = SuffixAutomaton()
            for t in texts:
                automaton.add(t["words"], t["doc_id"])
            automaton.settle()
            for t in texts:
                at = np.array(automaton.repeats(t["words"], t["doc_id"], WINDOW), np.int64)
                if len(at):
                    prints = Ranges(np.array(t["words"], np.int64).view(np.uint64)).of(at, WINDOW).view(np.int64)
                    out += [(t["doc_id"], x) for x in prints.tolist()]
        columns = list(zip(*out, strict=True)) or [()] * 2
        yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "print"])


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


def cut_out(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = WordHashes()
        for batch in batches:
            counts, removed, digests, texts = [], [], [], []
            for text, spans, prints in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3), strict=True):
                words = words_of(text.as_py())
                joined = b" ".join(words)
                counts.append(len(words))
                gone = 0
                if (spans or prints.is_valid and len(prints)) and len(words) >= WINDOW:
                    row = row_of(joined)
                    depth = np.zeros(len(words) + 1, np.int64)
                    if prints.is_valid and len(prints):  # every place of a window that was found at one of them
                        own = Ranges(hashed(words, memory)).of(np.arange(len(words) - WINDOW + 1), WINDOW).view(np.int64)
                        at = np.flatnonzero(np.isin(own, prints.values.to_numpy()))
                        depth[at] += 1
                        depth[at + WINDOW] -= 1
                    for s in spans or ():
                        if s["row"] == row:
                            depth[s["start"]] += 1
                            depth[s["start"] + s["n"] + WINDOW - 1] -= 1
                    kept = np.flatnonzero(np.cumsum(depth[:-1]) == 0)
                    gone = len(words) - len(kept)
                    if gone:
                        joined = b" ".join([words[k] for k in kept.tolist()])
                removed.append(gone)
                digests.append(hashlib.sha256(joined).hexdigest())
                texts.append(joined.decode() if with_text else None)
            yield pa.record_batch([batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests), pa.array(texts, pa.string())], names=[x.split()[0] for x in RESULT.split(", ")])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True, shard_texts: int = SHARD_TEXTS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept_text (kept words joined by a space) of every document."""
    everything = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    given = everything.where("doc_id is not null")  # the same rows in both joins below, so that the texts are shuffled once
    parts = cut(given.mapInArrow(find_parts, PARTS))
    each = parts.select("doc_id", "row", F.inline(F.arrays_zip("anchor", "stretch", "place")))
    # 1. anchors of more than one document
    # (cut, as a join can split a crowded anchor only where both of its sides come straight from a shuffle)
    shared = cut(each.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("anchor"))
    near = cut(each.join(shared, "anchor"))  # a part of all stretches; its uses below would each shuffle all of them again
    # 2. stretches that a smaller document has word for word
    firsts = cut(near.groupBy("anchor", "stretch").agg(F.min(F.struct("doc_id", "row", "place")).alias("first")))
    again = near.join(firsts, ["anchor", "stretch"]).where("doc_id > first.doc_id").drop("first").selectExpr("doc_id", "row", START, NUMBER)
    # 3. the different stretches of an anchor: a reference shard
    crowds = cut(firsts.groupBy("anchor").agg(F.count("*").alias("texts")).where("texts > 1"))
    wanted = firsts.join(crowds, "anchor").select("anchor", "first.*", (F.col("texts") > shard_texts).alias("crowded"))
    wanted = wanted.selectExpr("anchor", "doc_id", "row", START, NUMBER, "crowded")
    by_doc = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("row", "anchor", "start", "n", "crowded")).alias("wanted"))
    slices = given.join(by_doc, "doc_id").select("doc_id", "text", "wanted").mapInArrow(slice_words, SLICES)
    shards = slices.where("words is not null").groupBy("anchor").agg(F.collect_list(F.struct("doc_id", "row", "start", "words")).alias("texts"))
    matched = shards.select("texts").mapInArrow(search_shards, "doc_id long, print long")
    prints = slices.where("words is null").select("print_a", "print_b", "doc_id")
    least = prints.groupBy("print_a", "print_b").agg(F.min("doc_id").alias("least"))
    split = prints.join(least, ["print_a", "print_b"]).where("doc_id > least").selectExpr("doc_id", "print_a as print")
    # a stretch was searched at its first place only: its document loses the windows found at all places
    found = again.selectExpr("doc_id", "struct(row, start, n) as span", "cast(null as long) as print").unionByName(matched.union(split), allowMissingColumns=True)
    spans = found.groupBy("doc_id").agg(F.collect_list("span").alias("spans"), F.collect_list("print").alias("prints"))
    unnamed = everything.where("doc_id is null").withColumns({k: F.lit(None).cast(dict(spans.dtypes)[k]) for k in ("spans", "prints")})
    result = given.join(spans, "doc_id", "left").select("doc_id", "text", "spans", "prints").unionByName(unnamed).mapInArrow(cut_out(with_text), RESULT)
    return result if with_text else result.drop("kept_text")
