"""Sections, chunks and the chunk index."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from admitflow.functions.text import collapse, let


def sections(records: DataFrame, key: str, parts: dict[str, tuple[str, str]]) -> DataFrame:
    """(key, kind, title, body): one row a section that has text. parts: kind to (title, column)."""
    made = F.array(*(F.struct(F.lit(kind).alias("kind"), F.lit(title).alias("title"), collapse(F.col(column)).alias("body")) for kind, (title, column) in parts.items()))
    return records.select(key, F.explode(F.filter(made, lambda s: s["body"] != "")).alias("s")).select(key, "s.*")


def chunk_id(key: Column, kind: Column, index: Column) -> Column:
    return F.concat_ws(":", key.cast("string"), kind, index.cast("string"))


def flat_metadata(values: dict[str, Column]) -> Column:
    """map<string, string>: nulls dropped, scalars as text, nested values as JSON text."""
    text = lambda value: F.get_json_object(F.to_json(F.struct(value.alias("v"))), "$.v")
    made = F.create_map(*[x for name, value in values.items() for x in (F.lit(name), text(value))])
    return F.map_filter(made, lambda _, v: v.isNotNull())


def fixed_chunks(texts: DataFrame, key: str, body: str, size: int = 1200, overlap: int = 160) -> DataFrame:
    """(key, chunk_index, content, content_hash): windows of ``size`` characters that step by ``size - overlap``."""
    step = size - overlap
    clean = texts.select(key, collapse(F.col(body)).alias("body")).where("body <> ''")
    starts = F.sequence(F.lit(0), F.greatest(F.ceil((F.length("body") - overlap) / step).cast("int") - 1, F.lit(0)))
    rows = clean.select(key, "body", F.explode(starts).alias("chunk_index"))
    cut = rows.select(key, "chunk_index", F.substring("body", (F.col("chunk_index") * step + 1).cast("int"), F.lit(size)).alias("content"))
    return cut.withColumn("content_hash", F.sha2("content", 256))


#: White space between two sentences.
BETWEEN = re.compile(r"(?<=[.!?]) (?=[A-Z0-9])")


def chunk_spans(text: str, size: int = 1200, overlap: int = 160) -> list[tuple[int, int]]:
    """(start, end) of the chunks of a text with single spaces.

    As sentences follow each other by one space, every chunk is one slice: from
    its start to the last sentence end within ``size``, found by binary search
    among the ends. The next one starts with the first whole word of the last
    ``overlap`` characters, if the next sentence still fits, else behind the end.
    A sentence of over ``size`` is cut at the last space of each ``size`` characters.
    """
    if len(text) <= size:
        return [(0, len(text))] if text else []
    gaps = [m.start() for m in BETWEEN.finditer(text)]
    starts, ends = np.array([0, *(g + 1 for g in gaps)]), np.array([*gaps, len(text)])
    spans: list[tuple[int, int]] = []
    at = k = 0  # where the chunk starts, and its first whole sentence
    while k < len(ends):
        last = int(np.searchsorted(ends, at + size, side="right")) - 1
        if last >= k:
            end = int(ends[last])
            spans.append((at, end))
            k = last + 1
            at = end + 1
            if overlap and k < len(ends) and end - spans[-1][0] > overlap:
                low = end - overlap + (text[end - overlap] == " ")
                word = text.find(" ", low, end)
                again = word + 1 if word > low else low
                at = again if ends[k] - again <= size else at
            continue
        at, end = int(starts[k]), int(ends[k])
        while end - at > size:
            space = text.rfind(" ", at + 1, at + size)
            cut = space if space > at else at + size
            spans.append((at, cut))
            at = max(cut - overlap, at + 1)
            at += text[at] == " "
        spans.append((at, end))
        k += 1
        at = end + 1
    return spans


SPANS = "array<struct<a:int,b:int>>"
#: A code point that Unicode keeps out of texts: it marks where sentences part.
MARK = "\ufdd0"


def span_array(text: Column, size: int = 1200, overlap: int = 160) -> Column:
    """The spans of :func:`chunk_spans` as an expression: one fold over the sentences of a text with single spaces.

    The state is the start of the open chunk, the last sentence end in it (0: none) and the spans so far. A sentence that fits is added; else the chunk is closed
    and the next one begins in its overlap, where the sentence then fits, or with the sentence; a sentence of over ``size`` is cut on its own.
    """
    state = f"struct<off:int,at:int,last:int,spans:{SPANS}>"
    at_char = lambda i: F.substring(text, (i + 1).cast("int"), F.lit(1))
    span = lambda a, b: F.array(F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"))).cast(SPANS)
    now = lambda off, at, last, spans: F.struct(off.cast("int").alias("off"), at.cast("int").alias("at"), last.cast("int").alias("last"), spans.alias("spans")).cast(state)
    none = F.array().cast(SPANS)

    def again(at: Column, last: Column, end: Column) -> Column:
        """Where the next chunk starts behind (at, last)."""

        def from_low(low: Column) -> Column:
            tail = F.substring(text, (low + 1).cast("int"), (last - low).cast("int"))
            word = F.instr(tail, " ") - 1  # from low on
            start = F.when(word > 0, low + word + 1).otherwise(low)
            return F.when(end - start <= size, start).otherwise(last + 1)

        lapped = let(last - overlap + F.when(at_char(last - overlap) == " ", 1).otherwise(0), from_low)
        return F.when(last == 0, at).when(F.lit(overlap > 0) & (last - at > overlap), lapped).otherwise(last + 1)

    def pieces(start: Column, end: Column) -> Column:
        """Spans of a sentence of over ``size``: cut at the last space of each ``size`` characters."""
        kind = f"struct<at:int,spans:{SPANS}>"

        def cut(acc: Column, _: Column) -> Column:
            at = acc["at"]
            window = F.substring(text, (at + 2).cast("int"), F.lit(size - 1))  # characters at + 1 up to at + size
            space = F.length(window) - F.instr(F.reverse(window), " ")  # place in the window, if there is any
            place = F.when(F.instr(window, " ") > 0, at + 1 + space).otherwise(at + size)

            def onward(p: Column) -> Column:
                go = F.greatest(p - overlap, at + 1)
                return F.struct((go + F.when(at_char(go) == " ", 1).otherwise(0)).cast("int").alias("at"), F.concat(acc["spans"], span(at, p)).alias("spans")).cast(kind)

            return F.when(end - at <= size, acc).otherwise(let(place, onward))

        done = F.aggregate(F.sequence(F.lit(1), F.greatest(end - start - size, F.lit(1))), F.struct(start.cast("int").alias("at"), none.alias("spans")).cast(kind), cut)
        return let(done, lambda d: F.concat(d["spans"], span(d["at"], end)))

    def step(acc: Column, sentence: Column) -> Column:
        start = acc["off"]
        end = start + F.length(sentence)

        def closed(at: Column) -> Column:
            before = F.when(acc["last"] > 0, F.concat(acc["spans"], span(acc["at"], acc["last"]))).otherwise(acc["spans"])
            return F.when(end - at <= size, now(end + 1, at, end, before)).when(end - start <= size, now(end + 1, start, end, before)).otherwise(now(end + 1, end + 1, F.lit(0), F.concat(before, pieces(start, end))))

        return F.when(end - acc["at"] <= size, now(end + 1, acc["at"], end, acc["spans"])).otherwise(let(again(acc["at"], acc["last"], end), closed))

    sentences = F.split(F.regexp_replace(text, "(?<=[.!?]) (?=[A-Z0-9])", MARK), MARK)
    begin = now(F.lit(0), F.lit(0), F.lit(0), none)
    folded = F.aggregate(sentences, begin, step, lambda acc: F.when(acc["last"] > 0, F.concat(acc["spans"], span(acc["at"], acc["last"]))).otherwise(acc["spans"]))
    return F.when(text == "", none).when(F.length(text) <= size, span(F.lit(0), F.length(text))).otherwise(folded)


def sentence_chunks(rows: DataFrame, key: str, size: int = 1200, overlap: int = 160) -> DataFrame:
    """(key, kind, chunk_index, content, content_hash) of sections with course and code as a header."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below size")
    header = F.concat_ws(" ", F.concat(F.lit("Course: "), F.col("course_name")), F.concat(F.lit("CRICOS: "), F.col("cricos")), F.concat(F.lit("Section: "), F.col("title")), F.col("body"))
    clean = rows.select(key, "kind", F.replace(collapse(header), F.lit(MARK), F.lit("")).alias("text"))
    made = clean.select(key, "kind", "text", F.posexplode(span_array(F.col("text"), size, overlap)).alias("chunk_index", "s"))
    content = F.substring("text", F.col("s.a") + 1, F.col("s.b") - F.col("s.a"))
    return made.select(key, "kind", "chunk_index", content.alias("content")).withColumn("content_hash", F.sha2("content", 256))


def is_current(chunks: DataFrame, index: DataFrame, key: str, model: str) -> DataFrame:
    """(key, current): every expected chunk is in the index with its hash, model and vector, and the index has no other of the key.

    Both sides are grouped by the key alone, to the sets of (id, hash) of one document, and then joined by it: one shuffle a side,
    none where both are bucketed by the key. A chunk without id is never current; rows without a key are of no document and left out.
    """
    pairs = F.sort_array(F.collect_set(F.struct("id", "content_hash")))
    named = F.bool_and(F.col("id").isNotNull() & F.col("content_hash").isNotNull())
    want = chunks.where(F.col(key).isNotNull()).groupBy(key).agg(pairs.alias("want"), named.alias("want_named"))
    good = F.bool_and(F.coalesce((F.col("model") == model) & F.col("embedding").isNotNull(), F.lit(False)))
    have = index.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("have_key")).agg(pairs.alias("have"), good.alias("good"))
    same = F.coalesce((F.col("want") == F.col("have")) & F.col("want_named") & F.col("good"), F.lit(False))
    return want.join(have, F.col(key) == F.col("have_key"), "full_outer").select(F.coalesce(F.col(key), F.col("have_key")).alias(key), same.alias("current"))


def replace_chunks(index: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return index.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def bag_of_words(texts: list[str], width: int = 64) -> np.ndarray:
    """Signed hashed bags of words of unit length; the default embedder, which calls no service."""
    out = np.zeros((len(texts), width))
    for row, text in enumerate(texts):
        for word in text.lower().split():
            h = xxhash.xxh64_intdigest(word)
            out[row, h % width] += 1 if h >> 63 else -1
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=out, where=norm > 0).astype(np.float32)


def embed(rows: DataFrame, key: str, text: str, embedder: Callable[[list[str]], np.ndarray] = bag_of_words, batch_size: int = 64) -> DataFrame:
    """(key, embedding) by any ``embedder`` (texts to as many vectors, which is checked), ``batch_size`` texts at a time. Null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, batch_size):
                part = batch.slice(at, batch_size)
                out = np.asarray(embedder([t or "" for t in part.column(1).to_pylist()]), np.float32)
                if out.ndim != 2 or len(out) != part.num_rows:
                    raise ValueError(f"{part.num_rows} texts, but vectors of shape {out.shape}")
                offsets = np.arange(0, out.size + 1, out.shape[1], dtype=np.int32)
                yield pa.record_batch([part.column(0), pa.ListArray.from_arrays(offsets, out.ravel())], names=[key, "embedding"])

    kind = dict(rows.dtypes)[key]
    return rows.select(key, text).mapInArrow(run, f"{key} {kind}, embedding array<float>")


def run_stats(chunks: DataFrame, currency: DataFrame, key: str) -> DataFrame:
    """seen, skipped (current), built and embedded: what an index run does; a dry run ends here."""
    per = chunks.groupBy(key).agg(F.count("*").alias("n")).join(currency, key, "left")
    new = ~F.coalesce(F.col("current"), F.lit(False))
    return per.agg(F.count("*").alias("seen"), F.count_if(~new).alias("skipped"), F.coalesce(F.sum("n"), F.lit(0)).alias("built"), F.coalesce(F.sum(F.when(new, F.col("n"))), F.lit(0)).alias("embedded"))
