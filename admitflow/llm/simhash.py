"""SimHash near-duplicates by bit-sliced comparison.

Equal fingerprints are one class. Two different fingerprints with at most
``RADIUS`` = 3 differing bits agree on 3 of the 6 blocks that the 64 bits are cut
into, so classes are compared within the groups that agree on 3 blocks (20
choices). In a group the fingerprints are stored as 64 vertical bit planes; a
query's distances to 64 fingerprints at a time are kept in carry-save bitwise
counters, and a query's block is abandoned once all of it exceeds the radius.
A group hands on the links of a spanning forest, never all pairs. A group of
more than ``BLOCK`` fingerprints is dealt by hash into blocks and compared
block against block in separate tasks, so no task holds more than two blocks.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; shingles are 3 words,
fewer words are one shingle. Defined results: null or wordless text has
fingerprint zero and links like any other; repeated rows keep a row each; a
null id counts only where a component has no other (its id is null then); an
empty table gives no rows; columns other than the id and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from admitflow.llm.components import components
from admitflow.session import cut, fresh

SEED, SHINGLE, RADIUS = 42, 3, 3
#: Cuts of the 64 bits into 6 blocks; a group agrees on 3 of them.
CUTS = (0, 11, 22, 33, 44, 54, 64)
BLOCK, SMALL, QUERIES_AT_ONCE = 8192, 48, 64


def masks() -> list[int]:
    blocks = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(CUTS, CUTS[1:], strict=False)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [signed(a | b | c) for a, b, c in combinations(blocks, 3)]


def fingerprint(text: str | None) -> int:
    """A text's fingerprint as a signed 64-bit number."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and the ASCII white space alone
    if not words:
        return 0
    if len(words) < SHINGLE:
        words = [b" ".join(words), b"", b""]
        shingles = [words[0]]
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(SHINGLE)), strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, SEED) for s in shingles], dtype=np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row: Column | None = None) -> DataFrame:
    """doc_id, row (a given mark of the row) and fp (signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([fingerprint(t.as_py()) for t in batch.column(2)], pa.int64())
            yield pa.record_batch([batch.column(0), batch.column(1), found], names=["doc_id", "row", "fp"])

    mark = F.lit(0).cast("long") if row is None else row
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), mark.alias("row"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, row long, fp long")


def planes(values: np.ndarray) -> np.ndarray:
    """The vertical form of n fingerprints of w words: 64 w rows of bits, one bit a fingerprint."""
    values = values.reshape(len(values), -1) if len(values) else values.reshape(0, values.shape[1] if values.ndim > 1 else 1)
    bits = np.unpackbits(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), 8 * values.shape[1]), axis=1, bitorder="little").T
    bits = np.pad(bits, ((0, 0), (0, -bits.shape[1] % 64)))
    return np.ascontiguousarray(np.packbits(bits, axis=1, bitorder="little")).view(np.uint64)


FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


class Distances:
    """Bitwise counters of many distances at once, and the sticky bits of those above ``radius``.

    The counters start so far up that the carry out of the last one means a distance of radius + 1.
    """

    def __init__(self, shape, radius: int):
        bits = max(1, radius.bit_length())
        head = (1 << bits) - 1 - radius
        self.counters = [np.full(shape, FULL if head >> k & 1 else 0, np.uint64) for k in range(bits)]
        self.over = np.zeros(shape, np.uint64)

    def add(self, carry: np.ndarray) -> None:
        for counter in self.counters:
            rest = counter & carry
            counter ^= carry
            carry = rest
        self.over |= carry

    def keep(self, live: np.ndarray) -> None:
        self.counters = [c[live] for c in self.counters]
        self.over = self.over[live]


def within_many(vertical: np.ndarray, n: int, queries: np.ndarray, radius: int) -> np.ndarray:
    """Boolean queries x values: distance at most ``radius``. Queries whose whole block exceeds it are dropped on the way."""
    queries = queries.reshape(len(queries), -1)
    out = np.zeros((len(queries), n), bool)
    alive = np.arange(len(queries))
    flags = np.unpackbits(np.ascontiguousarray(queries).view(np.uint8).reshape(len(queries), -1), axis=1, bitorder="little")
    found = Distances((len(queries), vertical.shape[1]), radius)
    for k in range(len(vertical)):
        found.add(vertical[k][None, :] ^ np.where(flags[alive, k, None] == 1, FULL, np.uint64(0)))
        if k % 8 == 7 and k >= radius and k < len(vertical) - 1:
            live = ~(found.over == FULL).all(axis=1)
            if not live.any():
                return out
            if live.sum() < 0.7 * len(alive):
                alive = alive[live]
                found.keep(live)
    out[alive] = np.unpackbits((~found.over).view(np.uint8), axis=1, bitorder="little")[:, :n].astype(bool)
    return out


class Roots(dict):
    """Union-find: ``join`` is true where two parts become one."""

    def find(self, v: int) -> int:
        while (up := self.get(v, v)) != v:
            self[v] = v = self.get(up, up)
        return v

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self[b] = a
        return a != b


def forest_large(values: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Spanning links (by position) of a group: some fingerprints are asked at once, and what they reach leaves the block and asks next."""
    links: list[tuple[int, int]] = []
    roots = Roots()
    left, front = np.arange(len(values)), np.zeros(0, np.int64)
    vertical = planes(values)
    while len(left) or len(front):
        if len(front):
            ask, front = front[:QUERIES_AT_ONCE], front[QUERIES_AT_ONCE:]
        else:
            ask, left = left[:QUERIES_AT_ONCE], left[QUERIES_AT_ONCE:]
            vertical = planes(values[left])
            for i, j in np.argwhere(np.triu(within_many(planes(values[ask]), len(ask), values[ask], radius), 1)).tolist():
                if roots.join(int(ask[i]), int(ask[j])):
                    links.append((int(ask[i]), int(ask[j])))
        if not len(left):
            continue
        near = within_many(vertical, len(left), values[ask], radius)
        hit = near.any(axis=0)
        if not hit.any():
            continue
        reached, first = left[hit], near[:, hit].argmax(axis=0)
        links += zip(ask[first].tolist(), reached.tolist(), strict=True)
        roots.update(zip(reached.tolist(), ask[first].tolist(), strict=True))
        parts = np.array([roots.find(a) for a in ask.tolist()])
        # what several parts reach joins them
        for i, j in np.argwhere(near[:, hit] & (parts[:, None] != parts[first][None, :])).tolist():
            if roots.join(int(ask[i]), int(reached[j])):
                links.append((int(ask[i]), int(reached[j])))
        front, left = np.concatenate([front, reached]), left[~hit]
        vertical = planes(values[left])
    return links


def forest_small(groups: list[np.ndarray], radius: int = RADIUS) -> list[list[tuple[int, int]]]:
    """The same for each of many groups of at most SMALL values, whose pairs share one set of planes."""
    found: list[list[tuple[int, int]]] = [[] for _ in groups]
    pairs = [np.triu_indices(len(g), 1) for g in groups]
    owner = np.repeat(np.arange(len(groups)), [len(i) for i, _ in pairs])
    i, j = (np.concatenate([p[k] for p in pairs]) for k in (0, 1))
    differ = np.concatenate([g[p[0]] ^ g[p[1]] for g, p in zip(groups, pairs, strict=True)])
    roots = [Roots() for _ in groups]
    for at in range(0, len(owner), 1 << 15):
        vertical = planes(differ[at : at + (1 << 15)])
        counted = Distances(vertical.shape[1], radius)
        for k, row in enumerate(vertical):
            counted.add(row)
            if k % 8 == 7 and k >= radius and (counted.over == FULL).all():
                break
        near = at + np.flatnonzero(np.unpackbits((~counted.over).view(np.uint8), bitorder="little")[: len(owner) - at])
        for o, a, b in zip(owner[near].tolist(), i[near].tolist(), j[near].tolist(), strict=True):
            if roots[o].join(a, b):
                found[o].append((a, b))
    return found


def forests(groups: list[np.ndarray], radius: int = RADIUS) -> Iterator[list[tuple[int, int]]]:
    """Spanning links by position of each group of fingerprints."""
    small = [k for k, g in enumerate(groups) if 1 < len(g) <= SMALL]
    done = dict(zip(small, forest_small([groups[k] for k in small], radius), strict=True)) if small else {}
    for k, g in enumerate(groups):
        yield done.get(k) or (forest_large(g, radius) if len(g) > SMALL else [])


def link_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        groups = [np.unique(batch.column(0)[row].values.to_numpy()).astype(np.int64).view(np.uint64) for row in range(batch.num_rows)]
        ends = [g[list(pair)] for g, found in zip(groups, forests(groups), strict=True) for pair in found]
        ends = np.array(ends, dtype=np.uint64).reshape(-1, 2).view(np.int64)
        yield pa.record_batch([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["a", "b"])


def dealt(keyed: DataFrame, columns: list[str], spread: str, block: int) -> DataFrame:
    """(columns, members): the rows of each group of more than one, a group of over ``block`` as pairs of its blocks. ``spread``: what deals a row to its block."""
    sizes = keyed.groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1")
    shared = keyed.join(sizes, columns).withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    own = F.pmod(F.xxhash64(spread), F.col("blocks")).cast("int")
    rows = shared.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.groupBy(*columns, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).agg(F.collect_list("member").alias("members"))


def links(distinct: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b): links that connect all ``fp`` of ``distinct`` that are RADIUS or fewer bits apart."""
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks())])
    keyed = distinct.select(F.col("fp").alias("member"), F.explode(tables).alias("x")).select("member", "x.t", "x.key")
    return dealt(keyed, ["t", "key"], "member", block).select("members").mapInArrow(link_groups, "a long, b long").distinct()


def labelled_classes(classes: DataFrame, block: int = BLOCK) -> DataFrame:
    """``classes`` (fp and more) with ``label``: one fingerprint of the component."""
    roots = components(links(classes.select("fp"), block)).withColumnsRenamed({"node": "fp", "root": "label"})
    return classes.join(roots, "fp", "left").withColumn("label", F.coalesce("label", "fp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id (smallest doc_id reachable)."""
    printed = cut(fingerprints(docs, id_col, text_col).select("doc_id", "fp"))
    classes = printed.groupBy("fp").agg(F.min("doc_id").alias("least"))
    labelled = labelled_classes(classes, block)
    smallest = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    by_print = labelled.join(smallest, "label").select("fp", "component_id")
    return printed.join(by_print, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- one document of each group of near-duplicates, by shingles of five words


#: A stage takes shingles of 5 words and a similarity (Jaccard, over sets of shingles) of 0.8.
STAGE_SHINGLE, STAGE_WORDS = 5, 8
#: Bits of 512 in which the wide fingerprints of linked texts differ at most: two texts of similarity 0.8 differ in 77.5 on average (arccos(2 J / (1 + J)) / pi), with a deviation of 8.
STAGE_RADIUS = 90
#: Bands of minimal shingle hashes; a pair of similarity 0.8 shares a band in all but 1 of 5,000 cases.
BANDS, ROWS = 16, 4
#: Keys of removed rows that are broadcast at most; more are joined by shuffling.
MAX_BROADCAST_ROWS = 2_000_000
SIGNATURE = "doc_id long, row long, class binary, fp binary, bands array<long>"


def multipliers(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1 << 63, dtype=np.uint64, size=n) | np.uint64(1)


MIX, MIN = multipliers(STAGE_WORDS, 5), multipliers(BANDS * ROWS, 6)


def signature(text: str | None) -> tuple[bytes, bytes, np.ndarray]:
    """The digest of a text's words, its wide fingerprint, and its band keys."""
    words = (text or "").encode().lower().split()
    joined = b" ".join(words)
    size = STAGE_SHINGLE
    shingles = set(map(b" ".join, zip(*(words[k:] for k in range(size)), strict=False))) if len(words) >= size else {joined}
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(s) for s in shingles), np.uint64, len(shingles))
    ones, least = np.zeros(64 * STAGE_WORDS, np.int64), np.full(BANDS * ROWS, FULL)
    for at in range(0, len(hashes), 2048):
        part = hashes[at : at + 2048, None]
        mixed = part * MIX[None, :]
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        ones += np.unpackbits(mixed.view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        order = part * MIN[None, :]
        least = np.minimum(least, (order ^ (order >> np.uint64(31))).min(axis=0))
    bands = [xxhash.xxh3_64_intdigest(band.tobytes(), k) for k, band in enumerate(least.reshape(BANDS, ROWS))]
    return xxhash.xxh3_128_digest(joined), np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), np.array(bands, np.uint64).view(np.int64)


def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [signature(t.as_py()) for t in batch.column(2)]
        classes, fps, bands = zip(*found, strict=True) if found else ((), (), ())
        lists = pa.ListArray.from_arrays(np.arange(0, BANDS * len(found) + 1, BANDS, dtype=np.int32), np.concatenate([np.zeros(0, np.int64), *bands]))
        columns = [batch.column(0), batch.column(1), pa.array(classes, pa.binary()), pa.array(fps, pa.binary()), lists]
        yield pa.record_batch(columns, names=[x.split()[0] for x in SIGNATURE.split(", ")])


def link_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        classes, groups = [], []
        for members in batch.column(0).to_pylist():
            own = {m["class"]: m["fp"] for m in members}
            classes.append(list(own))
            groups.append(np.frombuffer(b"".join(own.values()), np.uint64).reshape(len(own), -1))
        pairs = [(c[i], c[j]) for c, found in zip(classes, forests(groups, STAGE_RADIUS), strict=True) for i, j in found]
        yield pa.record_batch([pa.array([p[k] for p in pairs], pa.binary()) for k in (0, 1)], names=["a", "b"])


def row_mark(docs: DataFrame):
    """A hash of all columns, which tells rows of one id apart."""
    plain = [F.to_json(F.struct(f"`{c}`")) if kind.startswith("map") else F.col(f"`{c}`") for c, kind in docs.dtypes]
    return F.xxhash64(*plain)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, max_broadcast: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: that of the smallest id (of equal ids, by a hash of the row; a null id comes last).

    Texts of equal words are one class. Classes that share a band of minimal
    shingle hashes are compared by wide fingerprints, bit-sliced, and linked at
    STAGE_RADIUS bits or fewer; a group is what is linked. Texts without words
    are one group; repeated rows are one row; an empty table stays empty; all
    columns pass, whatever their names.
    """
    own = fresh(docs)
    marked = docs.withColumns({f"{own}id": F.col(id_col).cast("long"), f"{own}row": row_mark(docs)})
    printed = cut(marked.select(f"{own}id", f"{own}row", F.col(text_col).cast("string")).mapInArrow(signatures, SIGNATURE))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    classes = cut(printed.groupBy("class").agg(F.min(order).alias("least"), F.first("fp").alias("fp"), F.first("bands").alias("bands")))
    keyed = classes.select(F.struct("class", "fp").alias("member"), F.posexplode("bands").alias("band", "key"))
    pairs = dealt(keyed, ["band", "key"], "member", block).select("members").mapInArrow(link_members, "a binary, b binary")
    roots = components(pairs.distinct()).withColumnsRenamed({"node": "class", "root": "label"})
    labelled = classes.select("class", "least").join(roots, "class", "left").withColumn("label", F.coalesce("label", "class"))
    kept = cut(labelled.groupBy("label").agg(F.min("least").alias("least")).select(F.col("least.doc_id").alias("doc_id"), F.col("least.row").alias("row")))
    rows = printed.groupBy("doc_id", "row").agg(F.count("*").alias("n"))
    same = rows["doc_id"].eqNullSafe(kept["doc_id"]) & (rows["row"] == kept["row"])
    removed = cut(rows.join(kept.withColumn("kept", F.lit(True)), same, "left").select(rows["doc_id"], rows["row"], "n", F.coalesce("kept", F.lit(False)).alias("kept")).where("n > 1 or not kept"))
    size = removed.agg(F.count("*").alias("n"), F.count_if("kept").alias("repeated")).first()
    hint = F.broadcast if size["n"] <= max_broadcast else lambda x: x

    def of(keys: DataFrame, how: str) -> DataFrame:
        there = marked[f"{own}id"].eqNullSafe(keys["doc_id"]) & (marked[f"{own}row"] == keys["row"])
        return marked.join(hint(keys), there, how)

    out = of(removed, "left_anti")
    if size["repeated"]:  # one of the rows that are equal in all columns
        out = out.unionByName(of(removed.where("kept"), "left_semi").dropDuplicates([f"{own}id", f"{own}row"]))
    return out.select(*(f"`{c}`" for c in docs.columns))
