"""Benchmark decontamination by the q-gram lemma.

An item of m characters found in a text with at most e edits shares at least
``m - q + 1 - e * q`` q-grams with that place, all of them on e + 1 neighbouring
diagonals (text position less item position). So the shared q-grams are counted
in overlapping bands of 2 (e + 1) diagonals, stepping by e + 1, which hold any
such stretch whole; bands that reach the bound are verified by an alignment
within the band. Nothing within the edit budget is missed.

Both sides are compared in lower case with each white-space character as a
space, character by character, so that places are those of the given text. The
budget is ``EDITS`` of an item's length, less for items so short that the bound
would fall below ``LEAST_SHARED``. Items under q + LEAST_SHARED - 1 characters have
no such bound: they are found exactly, as whole words, by one automaton.

Many items of one frame ("Question: ... Answer: ...") share its q-grams with every
text that has the frame. Their bands are then aligned side by side, as rows of
one array, and leave it once they exceed their budget; texts are looked at in
parts, so that the shared q-grams at hand stay below ``MAX_POSTINGS``.

The items of at most ``block_chars`` characters are broadcast at a time; a larger
benchmark is dealt by a hash of the item into blocks that pass one by one.

Defined results: null and empty texts and items match nothing; repeated
documents and repeated items each give their rows; overlapping places of an
item in a document count once, the one with fewest edits (then the first);
empty tables give no hits; other columns are ignored, or kept by
:func:`decontaminate`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Q, EDITS, LEAST_SHARED = 8, 0.10, 3
#: Characters of items in one broadcast, and of texts that are looked at together.
BLOCK_CHARS, CHUNK_CHARS = 2 << 20, 1 << 17
#: Shared q-grams of a part of the texts (a single text is always one part), and cells of one alignment array.
MAX_POSTINGS, MAX_CELLS = 1 << 20, 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
FILTER_BITS = 20
SPACES = {c: " " for c in (*range(0, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)}
OUTSIDE = np.uint32(0xFFFFFFFF)


@cache
def lower_table() -> np.ndarray:
    """The normal form of every code point that has one; built once a worker."""
    table = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000 and len(low := chr(c).lower()) == 1:
            table[c] = ord(low)
    table[list(SPACES)] = ord(" ")
    return table


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def characters(chars: np.ndarray) -> str:
    return chars.tobytes().decode("utf-32-le", "surrogatepass")


def normal(text: str) -> str:
    return characters(lower_table()[codes(text)])


def qgram_hashes(chars: np.ndarray, q: int = Q) -> np.ndarray:
    """The hash of each q-gram (q a power of 2), by doubling."""
    h, width, base = chars.astype(np.uint64), 1, BASE
    while width < q:
        h = h[:-width] * base + h[width:]
        width, base = 2 * width, np.uint64(int(base) ** 2 % (1 << 64))
    return h ^ (h >> np.uint64(31))


def slots(hashes: np.ndarray) -> np.ndarray:
    return ((hashes * BASE) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


@dataclass
class Items:
    """A block of items: their texts, budgets, bounds and the postings of their q-grams."""

    ids: list
    texts: list[str]
    edits: np.ndarray
    shared: np.ndarray
    seen: np.ndarray
    grams: np.ndarray
    first: np.ndarray
    item: np.ndarray
    place: np.ndarray
    brief: list[tuple]  # (id, text) of the items too short for the bound

    @cached_property
    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        by_text: dict[str, list] = {}
        for i, text in self.brief:
            by_text.setdefault(text, []).append(i)
        for text, ids in by_text.items():
            found.add_word(text, (len(text), ids))
        found.make_automaton()
        return found

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "automaton"}


def index(rows: list[tuple]) -> Items:
    kept = [(i, normal(t.strip())) for i, t in rows if t and len(t.strip()) >= Q + LEAST_SHARED - 1]
    texts = [t for _, t in kept]
    lengths = np.array([len(t) for t in texts], np.int64)
    edits = np.minimum((EDITS * lengths).astype(np.int64), (lengths - Q + 1 - LEAST_SHARED) // Q)
    hashes = [qgram_hashes(codes(t)) for t in texts]
    h = np.concatenate([np.zeros(0, np.uint64), *hashes])
    item = np.repeat(np.arange(len(texts)), lengths - Q + 1) if texts else np.zeros(0, np.int64)
    place = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(x)) for x in hashes)])
    order = np.argsort(h, kind="stable")
    grams, first = np.unique(h[order], return_index=True)
    seen = np.zeros(1 << FILTER_BITS, bool)
    seen[slots(grams)] = True
    brief = [(i, normal(t.strip())) for i, t in rows if t and 0 < len(t.strip()) < Q + LEAST_SHARED - 1]
    return Items([i for i, _ in kept], texts, edits, lengths - Q + 1 - edits * Q, seen, grams, np.append(first, len(h)), item[order], place[order], brief)


def align(pattern: np.ndarray, text: np.ndarray, low: int, high: int, budget: int) -> tuple[int, int, int] | None:
    """Fewest edits between the whole pattern and a stretch of the text, with text position
    less pattern position in low..high throughout: (start, end, edits), or None above the budget."""

    def rows(p: np.ndarray, t: np.ndarray, lo: int, width: int, start: np.ndarray) -> np.ndarray | None:
        padded = np.full(len(p) + width, OUTSIDE, np.uint32)  # t[lo : lo + m + width], outside of the text no character
        a, b = max(lo, 0), min(lo + len(padded), len(t))
        if b > a:
            padded[a - lo : b - lo] = t[a:b]
        steps, cost = np.arange(width), start
        for i in range(len(p)):
            new = cost + (padded[i : i + width] != p[i])
            new[:-1] = np.minimum(new[:-1], cost[1:] + 1)
            cost = np.minimum.accumulate(new - steps) + steps
            if i % 4 == 3 and cost.min() > budget:  # the least cost of a row never falls
                return None
        return cost

    m, width = len(pattern), high - low + 1
    cost = rows(pattern, text, low, width, np.zeros(width, np.int64))
    if cost is None or cost.min() > budget:
        return None
    best = int(cost.argmin())
    end = m + low + best
    # backwards from that end: the diagonal in reversed positions is (n - end) there
    lo = len(text) - m - high
    start = np.full(width, budget + m + 1, np.int64)
    start[len(text) - end - lo] = 0
    back = rows(pattern[::-1], text[::-1], lo, width, start)
    begin = len(text) - (m + lo + int(back.argmin()))
    return max(begin, 0), min(end, len(text)), int(cost[best])


def budgets_left(patterns: list[np.ndarray], windows: list[np.ndarray], widths: np.ndarray, budgets: np.ndarray) -> np.ndarray:
    """Which patterns align with their window within their budget: row by row for all of one array, and rows beyond their budget leave.

    A window holds the text under diagonal 0 first; ``widths`` are the diagonals of each band.
    """
    good = np.zeros(len(patterns), bool)
    lengths = np.array([len(p) for p in patterns])
    order = np.lexsort((lengths, widths))
    at = 0
    while at < len(order):
        width = int(widths[order[at]])
        most = max(1, MAX_CELLS // (int(lengths.max()) + width))
        own = order[at : at + most]
        own = own[widths[own] == width]
        at += len(own)
        longest = int(lengths[own].max())
        p, t = np.full((len(own), longest), OUTSIDE, np.uint32), np.full((len(own), longest + width), OUTSIDE - 1, np.uint32)
        for row, k in enumerate(own.tolist()):
            p[row, : lengths[k]] = patterns[k]
            t[row, : min(len(windows[k]), longest + width)] = windows[k][: longest + width]
        cost, steps, alive = np.zeros((len(own), width), np.int64), np.arange(width), np.arange(len(own))
        for i in range(longest):
            new = cost + (t[alive, i : i + width] != p[alive, i, None])
            new[:, :-1] = np.minimum(new[:, :-1], cost[:, 1:] + 1)
            cost = np.minimum.accumulate(new - steps, axis=1) + steps
            over = cost.min(axis=1) > budgets[own[alive]]
            done = ~over & (lengths[own[alive]] == i + 1)
            good[own[alive[done]]] = True
            if (over | done).any():
                left = ~(over | done)
                alive, cost = alive[left], cost[left]
                if not len(alive):
                    break
    return good


def whole_words(text: str, items: Items) -> list[tuple]:
    """Exact places of the brief items that begin and end with a word."""
    inside = lambda k: 0 <= k < len(text) and text[k].isalnum()
    found = []
    for last, (size, ids) in items.automaton.iter(text):
        first = last - size + 1
        if not (inside(first - 1) and inside(first)) and not (inside(last) and inside(last + 1)):
            found += [(i, first, last + 1, 0) for i in ids]
    return found


def find(texts: list[str | None], items: Items, brief: bool = True) -> list[list[tuple]]:
    """For each text its hits: (item_id, start, end, edits); without ``brief`` the items too short for the bound are left out."""
    found: list[list[tuple]] = [[] for _ in texts]
    if brief and items.brief:
        for row, text in enumerate(texts):
            if text:
                found[row] += whole_words(normal(text), items)
    if not items.ids:
        return found
    chunk: list[int] = []
    size = 0
    for row, text in enumerate(texts):
        if text and len(text) >= Q:
            chunk.append(row)
            size += len(text)
        if size >= CHUNK_CHARS or row == len(texts) - 1:
            look(chunk, [texts[k] for k in chunk], items, found)
            chunk, size = [], 0
    return found


def look(rows: list[int], texts: list[str], items: Items, found: list[list[tuple]]) -> None:
    if not rows:
        return
    starts = np.cumsum([0] + [len(t) + 1 for t in texts])
    chars = lower_table()[codes("\0".join(texts))]
    chars[starts[1:-1] - 1] = OUTSIDE  # between the texts stands what no text or item has
    h = qgram_hashes(chars)
    at = np.flatnonzero(items.seen[slots(h)])
    gram = np.minimum(np.searchsorted(items.grams, h[at]), len(items.grams) - 1)
    real = items.grams[gram] == h[at]
    at, gram = at[real], gram[real]
    if not len(at):
        return
    many = items.first[gram + 1] - items.first[gram]
    if many.sum() > MAX_POSTINGS and len(rows) > 1:
        half = len(rows) // 2
        look(rows[:half], texts[:half], items, found)
        look(rows[half:], texts[half:], items, found)
        return
    posting = np.repeat(items.first[gram], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    doc = np.repeat(np.searchsorted(starts, at, side="right") - 1, many)
    item = items.item[posting]
    diagonal = np.repeat(at, many) - starts[doc] - items.place[posting]
    step = items.edits[item] + 1
    band = np.floor_divide(diagonal, step)
    span = int(np.abs(band).max()) + 2
    key = ((doc * len(items.ids) + item) * (2 * span)) + band + span
    keys, counts = np.unique(np.concatenate([key, key - 1]), return_counts=True)
    pair = keys // (2 * span)
    keys = keys[counts >= items.shared[pair % len(items.ids)]]
    # what is left is counted by places of the item, so that a repeated q-gram counts once
    of_band = np.concatenate([np.isin(key, keys), np.isin(key - 1, keys)])
    bands, places = np.concatenate([key, key - 1])[of_band], np.concatenate([items.place[posting]] * 2)[of_band]
    keys, counts = np.unique(np.unique(np.stack([bands, places]), axis=1)[0], return_counts=True)
    keys = keys[counts >= items.shared[keys // (2 * span) % len(items.ids)]]
    hits: dict[tuple[int, int], list] = {}
    asked: list[tuple] = []  # doc, item, low, high, pattern, window
    for k in keys.tolist():
        pair, band = divmod(k, 2 * span)
        doc, item = divmod(pair, len(items.ids))
        text, wanted, budget = chars[starts[doc] : starts[doc + 1] - 1], items.texts[item], int(items.edits[item])
        low = (band - span) * (budget + 1)
        high = low + 2 * (budget + 1) - 1
        begin = max(low, 0)
        near = text[begin : max(high, 0) + len(wanted) + 1]
        same = characters(near).find(wanted)
        if same >= 0:
            hits.setdefault((doc, item), []).append((0, begin + same, begin + same + len(wanted)))
        elif budget:
            window = np.concatenate([np.full(begin - low, OUTSIDE, np.uint32), near]) if low < 0 else near
            asked.append((doc, item, low, high, codes(wanted), window))
    if asked:
        good = budgets_left([x[4] for x in asked], [x[5] for x in asked], np.array([x[3] - x[2] + 1 for x in asked]), items.edits[[x[1] for x in asked]])
        for doc, item, low, high, pattern, _ in (x for x, g in zip(asked, good.tolist(), strict=True) if g):
            if place := align(pattern, chars[starts[doc] : starts[doc + 1] - 1], low, high, int(items.edits[item])):
                hits.setdefault((doc, item), []).append((place[2], place[0], place[1]))
    for (doc, item), places in sorted(hits.items()):
        kept: list[tuple] = []
        for edits, a, b in sorted(places):
            if all(b <= x or a >= y for _, x, y in kept):
                kept.append((edits, a, b))
        found[rows[doc]] += [(items.ids[item], a, b, edits) for edits, a, b in sorted(kept, key=lambda x: x[1])]


def blocks(benchmark: DataFrame, id_col: str, text_col: str, block_chars: int) -> Iterator[Items]:
    """The items in blocks of about ``block_chars`` characters, each small enough to broadcast."""
    items = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // block_chars)
    for k in range(n):
        own = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k)
        yield index(sorted(map(tuple, own.collect()), key=lambda r: (str(r[0]), r[1])))


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, start, end (code points, end exclusive) and edits of every item found in a document."""
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, item_id long, start long, end long, edits long"
    out = None
    for items in blocks(benchmark, item_col, item_text_col, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(doc, *hit) for doc, hits in zip(batch.column(0).to_pylist(), find(batch.column(1).to_pylist(), shared.value), strict=True) for hit in hits]
                columns = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "item_id", "start", "end", "edits"])

        hits = given.mapInArrow(run, schema)
        out = hits if out is None else out.union(hits)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents in which no item is found, with all their columns. Items too short for the bound are no evidence and remove nothing."""
    place = docs.columns.index(text_col)
    for items in blocks(benchmark, item_col, item_text_col, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = [not hits for hits in find(batch.column(place).to_pylist(), shared.value, brief=False)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
