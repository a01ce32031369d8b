"""Phrase collocations: counts through double-array tries of Apriori-safe candidates.

Texts are lower-cased (A-Z), split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and
those into words ``[^\\x20\\x09]+``; everything counts by language (null: und).

1. A first pass adds up, for every length of 1 to ``LONGEST`` words, how many
   phrases fall into each bucket of a hash. A bucket's sum is at least the count
   of each phrase in it, so a phrase is *safe* to leave out if its own bucket, or
   that of any phrase inside it (Apriori), stays below ``least``. Blocks of text give
   their filled buckets as saturated bytes, which are added up by range of buckets.
2. A second pass takes from each position the longest phrase that is left, its
   *window* (every shorter one that starts there is left as well), and the single
   words. A task hands on each different one once, with its occurrences.
3. Windows are dealt into shards by their first two words, so all that begin alike
   meet. A shard puts the beginnings of its windows, which are its candidates, into
   a double-array trie over words and lets numpy advance the states of all
   windows at once, a word a level; accepting states add up the occurrences. Single
   words, which more than one shard's windows begin with, are added up by themselves.

So the texts are read once for their size and twice for their words, however many
candidates there are, and tries are built side by side by the tasks that have
their windows. What tasks hand on is packed by range or shard, so it is few rows, and grows
with their texts; a shard is one of ``SHARDS`` or of as many as there are shuffle partitions.

The buckets follow the size of the texts (``bucket_bits``): one for 16 bytes up to 2**26,
and beyond 32 GB of text 2**27, as a bucket must hold fewer rare phrases than ``least`` to tell
anything. What is broadcast is the buckets' bits (at most 5 * 16 MB).

Defined results: null and empty texts have no words; a row's language is part of
every count, and a literal language ``und`` is that of null; ties of the cut go
to the shortest first part, ties of rank to count and then to the phrase's UTF-8
bytes; repeated rows count each; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from admitflow.session import checkpoint_dir

#: Words of the longest phrase.
LONGEST = 5
#: Different windows that a task holds before it hands them on.
SHARD_PHRASES = 500_000
#: Bytes of text that a task takes at once, but for longer documents.
BLOCK_BYTES = 6_000_000
#: Buckets of a range, groups of a length's ranges that travel together, groups at most, and shards of the windows at least.
RANGE, GROUPS, PLACES, SHARDS = 1 << 16, 32, 1 << 20, 256
#: Parts of a language that are ranked side by side, and languages whose words are broadcast.
RANKED, MOST_LANGS = 64, 100_000

_BREAK, _SPACE = 10, 32
_CHARS = np.array([c + 32 if 65 <= c <= 90 else _BREAK if chr(c) in ".,;:!?" or 10 <= c <= 13 else _SPACE if c == 9 else c for c in range(256)], np.uint8)


class Words:
    """Words of a block of texts of one language: ``ids`` into ``values`` (distinct words), and the piece of each."""

    def __init__(self, texts: pa.Array):
        raw = pc.binary_join_element_wise(texts.cast(pa.binary()), b"", b"\n")
        offsets = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1]
        b = _CHARS[np.frombuffer(raw.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]]
        full = (b != _BREAK) & (b != _SPACE)
        edge = np.flatnonzero(np.diff(np.concatenate([[False], full, [False]])))
        starts, ends = edge[::2], edge[1::2]
        places = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
        found = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(b[full])]).dictionary_encode()
        self.ids = np.asarray(found.indices)
        self.found = found.dictionary
        # one text that is split again is several times as fast as a list of values
        self.values: list[bytes] = pc.binary_join(pa.ListArray.from_arrays([0, len(self.found)], self.found), b"\n")[0].as_py().split(b"\n") if len(self.found) else []
        self.pieces = np.cumsum(b == _BREAK, dtype=np.int32)[starts]

    def __len__(self) -> int:
        return len(self.ids)

    def whole(self, k: int) -> np.ndarray:
        """For each position that has k words after and with it: are these in one piece."""
        return self.pieces[: len(self.pieces) - k + 1] == self.pieces[k - 1 :]


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Words]]:
    """(language, words) of the batches' texts, in blocks of about ``BLOCK_BYTES``; columns are language and text."""
    for batch in batches:
        sizes = np.cumsum(np.asarray(pc.binary_length(batch.column(1)).fill_null(0), np.int64))
        cuts = np.searchsorted(sizes, np.arange(BLOCK_BYTES, sizes[-1] if len(sizes) else 0, BLOCK_BYTES), "left") + 1
        for at, end in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            if at >= end:
                continue
            langs, texts = batch.column(0).slice(at, end - at), batch.column(1).slice(at, end - at).fill_null("")
            for lang in pc.unique(langs).to_pylist():
                words = Words(texts.filter(pc.equal(langs, lang)))
                if len(words):
                    yield lang, words


def hashes(lang: str, words: Words) -> Iterator[tuple[int, np.ndarray]]:
    """(k, hash of the k words from each position) for k from 1; only buckets are told from these, so equal hashes of different phrases do no harm."""
    h = np.array([xxhash.xxh64_intdigest(w) for w in words.values], np.uint64)[words.ids]
    g = h ^ np.uint64(xxhash.xxh64_intdigest(lang.encode(), 1))
    for k in range(1, LONGEST + 1):
        if k > 1:
            g = (g[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[k - 1 :]) * np.uint64(0xC2B2AE3D27D4EB4F)
            g ^= g >> np.uint64(29)
        if not len(g):
            return
        yield k, g


def _bucket(g: np.ndarray, bits: int) -> np.ndarray:
    return ((g * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - bits)).astype(np.int64)


def parts_of(bits: int) -> int:
    """Ranges of buckets that go in one row, so that a length has GROUPS rows at most, whatever the number of buckets."""
    return max(1, (1 << bits) // (RANGE * GROUPS))


def _packed(kind: int, where: np.ndarray, n: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """Numbers of places, a row for each group of ``parts`` ranges that has any: how many in each range, offsets of two bytes, then the numbers. They grow with the texts of a task, however many places there are."""
    if not len(where):
        return
    group, size = where // (RANGE * parts), RANGE * parts
    cuts = np.flatnonzero(np.diff(group, prepend=-1))
    offsets, ranges = (where % RANGE).astype("<u2"), where % size // RANGE
    data = [np.bincount(ranges[at:end], minlength=parts).astype("<u4").tobytes() + offsets[at:end].tobytes() + n[at:end].tobytes() for at, end in zip(cuts, [*cuts[1:], len(where)], strict=True)]
    yield pa.RecordBatch.from_arrays([pa.array(kind * PLACES + group[cuts], pa.int64()), pa.array(data, pa.binary())], ["place", "data"])


def _unpacked(data: bytes, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Places within its group and numbers of a packed row."""
    many = np.frombuffer(data, "<u4", parts)
    size = int(many.sum())
    return np.frombuffer(data, "<u2", size, 4 * parts) + np.repeat(np.arange(parts) * RANGE, many), np.frombuffer(data[4 * parts + 2 * size :], np.uint8, size)


def dealt(packed: DataFrame) -> DataFrame:
    """Rows of the same range in one task, in which a task holds the sums of its ranges and never all rows of one."""
    return packed.repartition(int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions")), "place")


def _add_up(bits: int, least: int):
    """Saturated bucket sums of each block of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words in blocks(batches):
            for k, g in hashes(lang, words):
                where, n = np.unique(_bucket(g[words.whole(k)], bits).astype(np.uint32), return_counts=True)
                yield from _packed(k - 1, where.astype(np.int64), np.minimum(n, least).astype(np.uint8), parts_of(bits))

    return run


def _total(bits: int, least: int):
    """Bits of the buckets that reach ``least``, of all rows of a range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for place, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                where, n = _unpacked(data, parts_of(bits))
                sums = found.setdefault(place, np.zeros(RANGE * parts_of(bits), np.uint8))
                sums[where] = np.minimum(sums[where] + n, least)
        full = {place: np.packbits(sums >= least).tobytes() for place, sums in found.items() if (sums >= least).any()}
        yield pa.RecordBatch.from_arrays([pa.array(list(full), pa.int64()), pa.array(list(full.values()), pa.binary())], ["place", "bits"])

    return run


def full_buckets(rows: DataFrame, bits: int, least: int) -> np.ndarray:
    """For each length a bit array (packed) of the buckets that hold ``least`` or more phrases; at most 5 * 2**27 bits come to the driver."""
    size = RANGE * parts_of(bits)
    ranges = np.zeros((LONGEST, max(1, (1 << bits) // size), size // 8), np.uint8)
    sums = dealt(rows.mapInArrow(_add_up(bits, least), "place bigint, data binary"))
    for r in sums.mapInArrow(_total(bits, least), "place bigint, bits binary").collect():
        ranges[r.place // PLACES, r.place % PLACES] = np.frombuffer(r.bits, np.uint8)
    return ranges.reshape(LONGEST, -1)


def windows(lang: str, words: Words, bits: int, full: np.ndarray) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(different phrases, a hash of their first two words, occurrences): all safe words, then the longest safe phrases of 2 words and more that start at a position."""
    reach, good, begins = np.zeros(len(words), np.int8), None, []
    for k, g in hashes(lang, words):
        where = _bucket(g, bits)
        hit = words.whole(k) & ((full[k - 1, where >> 3] >> (7 - (where & 7)).astype(np.uint8)) & 1).astype(bool)
        good = hit if good is None else hit & good[:-1] & good[1:]
        if not good.any():
            break
        reach[: len(good)] += good
        if k <= 2:
            begins.append(g)
    size = len(words.values)
    for m in range(1, LONGEST + 1):
        at = np.flatnonzero(reach > 0 if m == 1 else reach == m)
        if not len(at):
            continue
        if m == 1:
            n, place = np.bincount(words.ids[at], minlength=size), np.zeros(size, np.int64)
            place[words.ids[at]] = at
            place, n = place[n > 0], n[n > 0]
        else:
            # exact numbers of the different phrases, made small again before they pass 64 bits
            code, top = words.ids[at].astype(np.int64), size
            for j in range(1, m):
                if top * size >= 1 << 63:
                    code = np.unique(code, return_inverse=True)[1]
                    top = len(at)
                code, top = code * size + words.ids[at + j], top * size
            _, first, n = np.unique(code, return_index=True, return_counts=True)
            place = at[first]
        parts = [words.found.take(pa.array(words.ids[place + j])) for j in range(m)]
        yield parts[0] if m == 1 else pc.binary_join_element_wise(*parts, b" "), begins[min(m, 2) - 1][place], n


def _list(bits: int, full, shards: int, most: int):
    """The windows of each task by shard and language, each once where they fit, as occurrences, offsets and bytes; and the words of each language in shard -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many: dict[str, int] = {}
        waiting: list[pa.Table] = []

        def rows(where: list[int], langs: list[str], sizes: list[int], data: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(where, pa.int64()), pa.array(langs, pa.string()), pa.array(sizes, pa.int64()), pa.array(data, pa.binary())], ["place", "lang", "size", "data"])

        def flush() -> Iterator[pa.RecordBatch]:
            found = pa.concat_tables(waiting).group_by(["place", "phrase"], use_threads=False).aggregate([("n", "sum")])
            waiting.clear()
            found = found.take(np.argsort(found.column("place").to_numpy(), kind="stable")).combine_chunks()
            place, n, phrase = found.column("place").to_numpy(), found.column("n_sum").to_numpy(), found.column("phrase").chunk(0)
            offsets = np.frombuffer(phrase.buffers()[1], np.int32)[phrase.offset : phrase.offset + len(phrase) + 1]
            cuts, text, langs = np.flatnonzero(np.diff(place, prepend=-1)), phrase.buffers()[2], list(many)
            ends = [*cuts[1:], len(place)]
            data = [n[at:end].tobytes() + (offsets[at : end + 1] - offsets[at]).tobytes() + text[offsets[at] : offsets[end]].to_pybytes() for at, end in zip(cuts, ends, strict=True)]
            yield rows(place[cuts] % shards, [langs[k] for k in place[cuts] // shards], ends - cuts, data)

        for lang, words in blocks(batches):
            many[lang] = many.get(lang, 0) + len(words)
            mine = list(many).index(lang) * shards
            for phrases, begin, n in windows(lang, words, bits, full.value):
                waiting.append(pa.table({"place": mine + _bucket(begin, 32) % shards, "phrase": phrases, "n": n.astype(np.int64)}))
            if sum(map(len, waiting)) > most:
                yield from flush()
        if waiting:
            yield from flush()
        if many:
            yield rows([-1] * len(many), list(many), [0] * len(many), [np.int64(n).tobytes() for n in many.values()])

    return run


def _unlisted(size: int, data: bytes) -> pa.Table:
    buffer, at = pa.py_buffer(data), 8 * size
    phrases = pa.Array.from_buffers(pa.binary(), size, [None, buffer.slice(at, 4 * (size + 1)), buffer.slice(at + 4 * (size + 1))])
    return pa.table({"phrase": phrases, "n": np.frombuffer(data, np.int64, size)})


def _shard(found: dict[str, list[pa.Table]], least: int) -> Iterator[pa.RecordBatch]:
    """(language, phrase, count) of the phrases of a shard that reach ``least``."""
    longer: dict[str, tuple[pa.Array, np.ndarray]] = {}
    langs, begun = [], []
    for lang, tables in found.items():
        once = pa.concat_tables(tables).group_by("phrase", use_threads=False).aggregate([("n", "sum")]).combine_chunks()
        phrase, n = once.column("phrase").chunk(0).cast(pa.string()), once.column("n_sum").to_numpy()
        more = pc.match_substring(phrase, " ")
        words = pc.and_(pc.invert(more), pa.array(n >= least))
        yield _found(pa.array([lang] * pc.sum(words).as_py(), pa.string()), phrase.filter(words), n[words.to_numpy(zero_copy_only=False)])
        phrase, n = phrase.filter(more), n[more.to_numpy(zero_copy_only=False)]
        if len(phrase):
            longer[lang] = phrase, n
            split = pc.split_pattern(phrase, " ")
            size = pc.list_value_length(split)
            parts = [pc.binary_join(pc.list_slice(split.filter(pc.greater_equal(size, m)), 0, m), " ") for m in range(2, LONGEST + 1)]
            begun.append(pc.unique(pa.concat_arrays(parts)))
            langs += [lang] * len(begun[-1])
    if not longer:
        return
    langs, begun = pa.array(langs, pa.string()), pa.concat_arrays(begun)
    trie, counts = Trie(langs, begun), np.zeros(len(begun), np.int64)
    for lang, (phrase, n) in longer.items():
        trie.count(lang, Words(phrase), counts, n)
    some = np.flatnonzero(counts >= least)
    yield _found(langs.take(some), begun.take(some), counts[some])


def _found(langs: pa.Array, phrases: pa.Array | None, numbers: np.ndarray) -> pa.RecordBatch:
    """(language, phrase, its count, null), or (language, null, null, words)."""
    nulls, numbers = pa.nulls(len(langs), pa.int64()), pa.array(numbers, pa.int64())
    phrase = pa.nulls(len(langs), pa.string()) if phrases is None else phrases
    return pa.RecordBatch.from_arrays([langs, phrase, *((nulls, numbers) if phrases is None else (numbers, nulls))], ["lang", "phrase", "a", "n"])


def _count(least: int):
    """The phrases that reach ``least`` of each shard, whose rows follow each other, and all words of each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many: dict[str, int] = {}
        found: dict[str, list[pa.Table]] = {}
        last = None
        for batch in batches:
            for place, lang, size, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if place < 0:
                    many[lang] = many.get(lang, 0) + int(np.frombuffer(data, np.int64)[0])
                    continue
                if place != last:
                    yield from _shard(found, least)
                    found, last = {}, place
                found.setdefault(lang, []).append(_unlisted(size, data))
        yield from _shard(found, least)
        if many:
            yield _found(pa.array(list(many)), None, np.array(list(many.values())))

    return run


class Trie:
    """Double-array trie of phrases: from state s word w leads to ``base[s] + w`` where ``check`` there is s.

    States are dealt level by level: those with several next words first, most
    words first, each at the first base where all its places are free; then
    those with one next word fill the gaps.
    """

    def __init__(self, langs: pa.Array, phrases: pa.Array):
        """Languages and phrases (words joined by single spaces) of the same rows; a phrase's number is its row."""
        coded = langs.dictionary_encode()
        self.langs = {lang: k for k, lang in enumerate(coded.dictionary.to_pylist(), 1)}
        split = pc.split_pattern(phrases, " ")
        flat = split.flatten().dictionary_encode()
        # words of many phrases get the small symbols, so that the places of one state's next words lie close together
        often = np.argsort(-np.bincount(np.asarray(flat.indices), minlength=len(flat.dictionary)), kind="stable")
        symbol = np.empty(len(often), np.int64)
        symbol[often] = np.arange(len(self.langs) + 1, len(self.langs) + 1 + len(often))
        self.words = dict(zip(flat.dictionary.cast(pa.binary()).to_pylist(), symbol.tolist(), strict=True))
        words, size = np.diff(np.asarray(split.offsets)), len(phrases)
        table = np.full((size, LONGEST + 1), -1, np.int64)
        table[:, 0] = np.asarray(coded.indices) + 1
        row = np.repeat(np.arange(size), words)
        table[row, 1 + np.arange(len(row)) - np.repeat(np.cumsum(words) - words, words)] = symbol[np.asarray(flat.indices)]
        # nodes: 0 is the root; a node is told by its parent and its symbol
        node, ends = np.zeros(size, np.int64), np.zeros(size, np.int64)
        symbols = len(self.words) + len(self.langs) + 1
        parents, letters, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 1
        for level in range(LONGEST + 1):
            here = np.flatnonzero(words >= level)
            if not len(here):
                break
            keys, inverse = np.unique(node[here] * symbols + table[here, level], return_inverse=True)
            node[here] = n + inverse
            parents.append(keys // symbols)
            letters.append(keys % symbols)
            n += len(keys)
            done = here[words[here] == level]
            ends[done] = node[done]
        slot = self._place(np.concatenate(parents), np.concatenate(letters), n, symbols)
        self.accept = np.full(len(self.check), -1, np.int32)
        self.accept[slot[ends]] = np.arange(size)

    def _place(self, parents: np.ndarray, letters: np.ndarray, n: int, symbols: int) -> np.ndarray:
        """Fills ``base`` and ``check``; gives the state of each node."""
        order = np.lexsort((letters, parents))
        parents, letters, children = parents[order], letters[order], order + 1
        owners, begins, counts = np.unique(parents, return_index=True, return_counts=True)
        used = np.zeros(2 * n + 2 * symbols + 64, bool)
        used[0] = True  # the root's own place
        base, slot = np.zeros(n, np.int64), np.zeros(n, np.int64)
        # states of about as many next words look for their places one behind the other, so none looks at the full part again
        begun: dict[int, int] = {}
        for k in np.argsort(-counts, kind="stable"):
            if counts[k] < 2:
                break
            c = letters[begins[k] : begins[k] + counts[k]]
            kind = int(counts[k]).bit_length()
            at = max(begun.get(kind, 0), 1 - int(c[0]))
            while True:
                if at + 64 + symbols >= len(used):
                    used = np.concatenate([used, np.zeros(len(used), bool)])
                free = np.flatnonzero(~used[(at + np.arange(64))[:, None] + c].any(axis=1))
                if len(free):
                    at += int(free[0])
                    break
                at += 64
            begun[kind] = at
            used[at + c] = True
            base[owners[k]] = at
            slot[children[begins[k] : begins[k] + counts[k]]] = at + c
        single = np.flatnonzero(counts == 1)
        if len(used) - np.count_nonzero(used) < len(single):
            used = np.concatenate([used, np.zeros(len(single), bool)])
        gaps = np.flatnonzero(~used)[: len(single)]
        used[gaps] = True
        base[owners[single]] = gaps - letters[begins[single]]
        slot[children[begins[single]]] = gaps
        length = int(np.flatnonzero(used)[-1]) + 1
        self.base, self.check = np.zeros(length, np.int32), np.full(length, -1, np.int32)
        self.base[slot] = base
        self.check[slot[children]] = slot[parents]
        return slot

    def step(self, states: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the states go on, their next states)."""
        after = self.base[states] + symbols
        inside = (after >= 0) & (after < len(self.check)) & (symbols > 0)
        alive = inside & (self.check[np.where(inside, after, 0)] == states)
        return alive, after[alive]

    def count(self, lang: str, words: Words, counts: np.ndarray, times: np.ndarray | None = None) -> None:
        """Adds the occurrences of the phrases in a block to ``counts``: the states of all positions advance a word a level.

        With ``times``, a number for each piece, only phrases that start with a piece count, as often as that.
        """
        if lang not in self.langs:
            return
        symbol = np.array([self.words.get(w, 0) for w in words.values], np.int64)[words.ids]
        _, start = self.step(np.zeros(1, np.int64), np.array([self.langs[lang]]))
        places = np.arange(len(words)) if times is None else np.flatnonzero(np.diff(words.pieces, prepend=-1))
        states = np.full(len(places), start[0] if len(start) else -1)
        for k in range(LONGEST):
            on = np.flatnonzero(places + k < len(words))
            on = on[words.pieces[places[on] + k] == words.pieces[places[on]]]
            alive, after = self.step(states[on], symbol[places[on] + k])
            places, states = places[on[alive]], after
            if times is not None:
                times = times[on[alive]]
            if not len(places):
                break
            ends = self.accept[states]
            if times is None:
                counts += np.bincount(ends[ends >= 0], minlength=len(counts))
            else:
                np.add.at(counts, ends[ends >= 0], times[ends >= 0])


def bucket_bits(size: int) -> int:
    """Buckets of a length for so many bytes of text, as a power of two."""
    return max(min(26, max(16, (size // 16).bit_length())), min(27, (size // 512).bit_length()))


def frequent_phrases(docs: DataFrame, least: int = 100, text_col: str = "text", lang_col: str = "lang", buckets: int | None = None, shard_phrases: int = SHARD_PHRASES) -> DataFrame:
    """(lang, phrase, m, a, n): phrases of m = 1 to 5 words that occur ``least`` times or more, their count, and all words of the language.

    ``least`` is at most 127 (bucket sums are saturated bytes); phrases that are rarer than 127 but not than ``least`` need no other way.
    """
    if not 1 <= least <= 127:
        raise ValueError("least is between 1 and 127")
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    bits = buckets
    if bits is None:
        bits = bucket_bits(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    full = spark.sparkContext.broadcast(full_buckets(rows, bits, least))
    shards = max(SHARDS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    listed = dealt(rows.mapInArrow(_list(bits, full, shards, shard_phrases), "place bigint, lang string, size bigint, data binary"))
    schema = "lang string, phrase string, a bigint, n bigint"
    folder = f"{checkpoint_dir(spark)}/phrases-{uuid.uuid4().hex}"
    listed.sortWithinPartitions("place").mapInArrow(_count(least), schema).write.parquet(folder)
    found = spark.read.schema(schema).parquet(folder)
    totals = found.where("phrase IS NULL").select("lang", "n")
    counts = found.where("phrase IS NOT NULL").drop("n")
    # dealt by language, all phrases would lie in as many tasks as there are languages
    totals = F.broadcast(totals) if totals.count() <= MOST_LANGS else totals
    return counts.join(totals, "lang").select("lang", "phrase", F.size(F.split("phrase", " ")).cast("bigint").alias("m"), "a", "n")


def _part(begin: Column | int, length: Column | int) -> Column:
    return F.array_join(F.slice(F.split("phrase", " "), begin, length), " ")


def collocations(docs: DataFrame, least: int = 100, top: int = 2000, text_col: str = "text", lang_col: str = "lang", **how) -> DataFrame:
    """The ``top`` collocations of each language: lang, rank, phrase, a, l, r, n and score.

    A candidate has 2 to 5 words; its score is that of its weakest cut, floor(1000 * a * n / (l * r)) in exact decimals. Candidates that
    a longer one holds as often as they occur go.
    """
    found = frequent_phrases(docs, least, text_col, lang_col, **how)
    counts = found.select("lang", "phrase", "a")
    longer = found.where("m >= 2")
    # as counts never grow with length, it is enough to look one word further
    inside = found.where("m >= 3").select("lang", F.explode(F.array(_part(1, F.col("m").cast("int") - 1), _part(2, F.col("m").cast("int") - 1))).alias("phrase"), F.col("a").alias("held")).groupBy("lang", "phrase").agg(F.max("held").alias("held"))
    kept = longer.join(inside, ["lang", "phrase"], "left").where("held IS NULL OR held < a").drop("held")
    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("m").cast("int") - 1))).withColumn("head", _part(1, F.col("k"))).withColumn("tail", _part(F.col("k") + 1, F.col("m").cast("int")))
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("head"), F.col("a").alias("l")), ["lang", "head"]).join(counts.select("lang", F.col("phrase").alias("tail"), F.col("a").alias("r")), ["lang", "tail"])
    exact = F.expr("(CAST(a AS DECIMAL(19, 0)) * CAST(n AS DECIMAL(19, 0)) * 1000BD) div (CAST(l AS DECIMAL(19, 0)) * CAST(r AS DECIMAL(19, 0)))")
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(exact.alias("score"), "k", "l", "r")).alias("cut"))
    order = F.col("score").desc(), F.col("a").desc(), F.col("phrase")
    ranked = best.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
    # the first of each part of a language hold the first of all
    for part in ([F.pmod(F.xxhash64("phrase"), F.lit(RANKED))], []):
        ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("lang", *part).orderBy(*order))).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
