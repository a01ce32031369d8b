"""Course names to page addresses, and courses to the page that is read for them."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from admitflow.functions.text import canonical_url, collapse, is_research, match_key

#: Paths of coursework and research pages, what a path and a shared word add to a score, and the least score of a match.
COURSEWORK, RESEARCH = "/courses/courses/pc/", "/courses/courses/pr/"
TOKEN_BONUS, RESEARCH_BONUS, COURSEWORK_BONUS, LEAST_SCORE = 0.08, 0.25, 0.05, 0.72
#: Names of one broadcast block, and slugs that a task compares with them at once.
NAME_BLOCK, SLUG_BATCH = 2048, 256


def slug_of(url: Column) -> Column:
    return match_key(F.replace(F.regexp_replace(F.element_at(F.split(url, "/"), -1), r"\.html", ""), F.lit("-"), F.lit(" ")))


def letter_counts(texts: list[str], letters: dict[str, int]) -> np.ndarray:
    """How often each text has each letter; letters without a column share the last one."""
    out = np.zeros((len(texts), len(letters) + 1), np.uint16)
    for row, t in enumerate(texts):
        for c, n in Counter(t).items():
            out[row, letters.get(c, len(letters))] += n
    return out


def common_letters(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Letters that texts have in common, at most; a row for each of ``a``, a column for each of ``b``."""
    out = np.zeros((len(a), len(b)), np.int32)
    for c in np.flatnonzero(a.any(axis=0) & b.any(axis=0)):
        out += np.minimum(a[:, c][:, None], b[:, c][None, :])
    return out


def subsequence_lengths(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """Length of the longest common subsequence of each pair: all pairs at once, a letter of ``b`` a step, a text of ``a`` in the bits of one word.

    A pair with a longer text than 63 letters gets the length of the shorter one, which is never less.
    """
    out = np.array([min(len(x), len(y)) for x, y in zip(a, b, strict=True)], np.int64)
    short = np.flatnonzero([len(x) <= 63 and len(y) <= 63 for x, y in zip(a, b, strict=True)])
    if not len(short):
        return out
    width = max(len(b[k]) for k in short)
    code = lambda texts: np.array([[ord(c) for c in t.ljust(63, "\0")] for t in texts], np.uint32)
    own, other = np.unique([a[k] for k in short], return_inverse=True), code([b[k] for k in short])[:, :width]
    own_letters = code(own[0])[own[1]]
    bits = np.uint64(1) << np.arange(63, dtype=np.uint64)
    lengths = np.array([len(a[k]) for k in short], np.uint64)
    open_bits = np.full(len(short), ~np.uint64(0))
    for j in range(width):
        match = ((own_letters == other[:, j][:, None]) * bits).sum(axis=1, dtype=np.uint64)
        match[other[:, j] == 0] = 0
        both = open_bits & match
        open_bits = (open_bits + both) | (open_bits & ~match)
    taken = ~open_bits & ((np.uint64(1) << lengths) - np.uint64(1))
    out[short] = np.bitwise_count(taken)
    return out


class Names:
    """A block of names that slugs are compared with."""

    def __init__(self, keys: list[str], research: list[bool]):
        self.keys, self.research = keys, np.array(research, bool)
        self.letters = {c: k for k, (c, _) in enumerate(Counter("".join(keys)).most_common(63))}
        self.counts = letter_counts(keys, self.letters)
        self.lengths = np.array([len(k) for k in keys])
        self.words: dict[str, list[int]] = {}
        for row, k in enumerate(keys):
            for w in set(k.split(" ")):
                self.words.setdefault(w, []).append(row)

    def meet(self, slugs: list[str], kinds: np.ndarray, best: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """(name, slug, score) of the slugs that score best for a name and not below ``best``, which is raised on the way.

        The ratio of matching blocks is at most that of the common letters, and at most
        that of the longest common subsequence. So a pair is left out if either bound, with its
        bonuses, stays below the name's best score so far or below LEAST_SCORE; of the others those of
        the highest bound are worked out first.
        """
        total = self.lengths[:, None] + np.array([len(t) for t in slugs])[None, :]
        shared = np.zeros(total.shape, np.int32)
        for column, t in enumerate(slugs):
            for w in set(t.split(" ")):
                shared[self.words.get(w, []), column] += 1
        bonus = TOKEN_BONUS * shared + np.where(self.research[:, None] & (kinds == 2), RESEARCH_BONUS, np.where(~self.research[:, None] & (kinds == 1), COURSEWORK_BONUS, 0.0))
        bound = 2 * common_letters(self.counts, letter_counts(slugs, self.letters)) / total + bonus
        rows, columns = np.nonzero(bound >= np.maximum(best, LEAST_SCORE)[:, None] - 1e-6)
        bound = 2 * subsequence_lengths([self.keys[r] for r in rows], [slugs[c] for c in columns]) / total[rows, columns] + bonus[rows, columns]
        for k in np.argsort(-bound, kind="stable"):
            row, column = int(rows[k]), int(columns[k])
            if bound[k] < max(best[row], LEAST_SCORE) - 1e-6:
                continue
            score = round(SequenceMatcher(None, self.keys[row], slugs[column]).ratio() + float(bonus[row, column]), 6)
            if score >= max(best[row], LEAST_SCORE):
                best[row] = score
                yield row, column, score


def best_urls(names: DataFrame, urls: DataFrame, block: int = NAME_BLOCK) -> DataFrame:
    """(name, url, score): the best address of each name (names: name; urls: url), if it reaches LEAST_SCORE.

    The score is the ratio of matching blocks, plus a bonus a shared word and one for the
    page's kind; the first address in order wins a tie. Names are a query set: their different
    keys pass in broadcast blocks of ``block``, all different slugs stream past each block, and bounds that
    never fall short of the score leave few pairs to be worked out (:meth:`Names.meet`), so no match is lost.
    A task hands on the best of what it has seen of each name.
    """
    research = is_research(F.col("name"))
    wanted = names.select("name").where("name is not null").distinct().select("name", match_key(F.col("name")).alias("key"), research.alias("research")).where("key <> ''")
    kind = F.when(F.col("url").contains(RESEARCH), 2).when(F.col("url").contains(COURSEWORK), 1).otherwise(0)
    both = F.col("url").contains(RESEARCH) & F.col("url").contains(COURSEWORK)
    pages = urls.select("url").where("url is not null").select("url", slug_of(F.col("url")).alias("slug"), F.explode(F.when(both, F.array(F.lit(1), F.lit(2))).otherwise(F.array(kind))).alias("kind")).where("slug <> ''")
    slugs = pages.groupBy("slug", "kind").agg(F.min("url").alias("url"))
    keys = wanted.select("key", "research").distinct()
    blocks = max(1, -(-keys.count() // block))
    schema = "key string, research boolean, url string, score double"
    out = None
    for b in range(blocks):
        own = keys.where(F.pmod(F.xxhash64("key", "research"), F.lit(blocks)) == b).orderBy("key", "research").collect()
        shared = names.sparkSession.sparkContext.broadcast(Names([r["key"] for r in own], [r["research"] for r in own]))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block, found = shared.value, {}
            best = np.zeros(len(block.keys))
            for batch in batches:
                for at in range(0, batch.num_rows, SLUG_BATCH):
                    some = batch.slice(at, SLUG_BATCH).to_pydict()
                    for row, column, score in block.meet(some["slug"], np.array(some["kind"]), best):
                        found[row] = min(found.get(row, (0.0, "")), (-score, some["url"][column]))
            rows = list(found)
            columns = [[block.keys[r] for r in rows], [bool(block.research[r]) for r in rows], [found[r][1] for r in rows], [-found[r][0] for r in rows]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.bool_(), pa.string(), pa.float64()), strict=True)], ["key", "research", "url", "score"])

        part = slugs.mapInArrow(search, schema) if own else slugs.sparkSession.createDataFrame([], schema)
        out = part if out is None else out.unionAll(part)
    best = out.groupBy("key", "research").agg(F.min_by(F.struct("url", "score"), F.struct(-F.col("score"), "url")).alias("b"))
    return wanted.join(best, ["key", "research"]).select("name", "b.url", "b.score")


def best_candidates(found: DataFrame, seed: str = "seed_id") -> DataFrame:
    """One address a seed of its search results (seed, course_name, cricos, url): the kind of page, the code in the address, shared words, then the shorter one."""
    url = canonical_url(F.col("url"))
    slug = F.lower(F.replace(F.replace(F.element_at(F.split(url, "/"), -1), F.lit(".html"), F.lit("")), F.lit("-"), F.lit(" ")))
    words = F.size(F.array_intersect(F.split(F.lower(collapse(F.col("course_name"))), " "), F.filter(F.split(slug, " "), lambda w: w != "")))
    score = F.when(F.contains(url, F.lit(COURSEWORK)), 20).otherwise(0) + F.when(F.contains(url, F.lit(RESEARCH)) & is_research(F.col("course_name")), 30).otherwise(0)
    score = score + F.when(F.contains(F.lower(url), F.lower(F.col("cricos"))), 5).otherwise(0) + words
    rank = F.row_number().over(Window.partitionBy(seed).orderBy(F.desc("score"), F.length(canonical_url(F.col("url"))), "url"))
    return found.withColumn("score", score).withColumn("__n", rank).where("__n = 1").drop("__n")


def resolve_pages(seeds: DataFrame, matched: DataFrame, searched: DataFrame, name: str = "course_name") -> tuple[DataFrame, DataFrame]:
    """(seeds with ``page_url``, dead letters): the matched address (name, url), else the stored source_url, else the search's (seed_id, url)."""
    m, s = matched.select(F.col("name").alias(name), F.col("url").alias("__m")), searched.select("seed_id", F.col("url").alias("__s"))
    found = seeds.join(m, name, "left").join(s, "seed_id", "left")
    found = found.withColumn("page_url", F.coalesce("__m", F.nullif("source_url", F.lit("")), "__s")).drop("__m", "__s")
    dead = found.where("page_url is null").select(F.lit("discovery").alias("stage"), F.lit("DISCOVERY_NO_MATCH").alias("error_code"), F.lit("no page was found").alias("message"), F.to_json(F.struct("seed_id", name)).alias("payload"), F.lit(True).alias("retryable"))
    return found.where("page_url is not null"), dead


def with_requirements(candidates: DataFrame, requirements: DataFrame, key: str) -> DataFrame:
    """Candidates with their requirement's columns and ``requirement_error``: ``missing_requirement`` where there is none."""
    joined = candidates.join(requirements.withColumn("__has", F.lit(True)), key, "left")
    return joined.withColumn("requirement_error", F.when(F.col("__has").isNull(), "missing_requirement")).drop("__has")


def fetch(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of ``table`` whose key is among ``ids``."""
    return table.join(ids.select(key), key, "left_semi")


def with_list(rows: DataFrame, children: DataFrame, key: str, value: str, order: Sequence[str], name: str) -> DataFrame:
    """``rows`` with the ordered list of their children's values, empty if they have none."""
    kind = dict(children.dtypes)[value]
    lists = children.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("__v")))), lambda s: s["__v"]).alias(name))
    return rows.join(lists, key, "left").withColumn(name, F.coalesce(name, F.array().cast(f"array<{kind}>")))
