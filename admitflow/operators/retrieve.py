"""Keyword, vector and hybrid retrieval for tables of queries."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from admitflow.functions.text import snippet

#: Query vectors in one broadcast block, and keywords of one automaton; more pass block by block.
QUERY_BLOCK, KEYWORD_BLOCK = 4096, 100_000
#: Weights of a keyword's field.
FIELD_WEIGHTS = {"course_name": 0.55, "course_name_raw": 0.45, "cricos": 0.30, "academic_requirement_text": 0.25, "raw_english_requirement": 0.15}
EVIDENCE = "array<struct<text:string,source_url:string,source:string>>"


def hit_names(mask: Column, fields: dict[str, str]) -> Column:
    """The fields of a bit mask, in order."""
    return F.array_compact(F.array(*(F.when(mask.bitwiseAND(F.lit(1 << k)) > 0, n) for k, n in enumerate(fields))))


def keyword_score(mask: Column, fields: dict[str, str], weights: dict[str, float] = FIELD_WEIGHTS) -> Column:
    """Sum of the weights of a bit mask's fields, 1 at most."""
    return F.least(F.lit(1.0), F.round(sum(F.when(mask.bitwiseAND(F.lit(1 << k)) > 0, F.lit(weights[n])).otherwise(0.0) for k, n in enumerate(fields)), 6))


def keyword_hits(rows: DataFrame, words: DataFrame, fields: dict[str, str], keep: Sequence[str], block: int = KEYWORD_BLOCK) -> DataFrame:
    """(keep, keyword, mask): the rows that hold each of ``words`` (keyword) in a field, any case; bit k of the mask is the k-th field.

    A row's fields are lower-cased once and pass one automaton of all keywords of a
    block, so the cost of a row is its length and its hits, whatever the number of keywords; any number passes, in blocks.
    The empty keyword is in every field.
    """
    import ahocorasick

    words = words.select("keyword", F.lower("keyword").alias("low")).where("keyword is not null").distinct()
    blocks = max(1, -(-words.count() // block))
    lows = rows.select(*keep, *(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(f"__low_{k}") for k, c in enumerate(fields.values())))
    kinds = [f for f in lows.schema.fields if f.name in keep]
    out = None
    for b in range(blocks):
        own: dict[str, list[str]] = {}
        for r in words.where(F.pmod(F.xxhash64("keyword"), F.lit(blocks)) == b).orderBy("keyword").collect():
            own.setdefault(r["low"], []).append(r["keyword"])
        shared = rows.sparkSession.sparkContext.broadcast(own)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            automaton = ahocorasick.Automaton()
            for low, names in own.items():
                if low:
                    automaton.add_word(low, names)
            automaton.make_automaton()
            every = dict.fromkeys(own.get("", []), (1 << len(fields)) - 1)
            for batch in batches:
                at, keywords, masks = [], [], []
                texts = [batch.column(len(keep) + k).to_pylist() for k in range(len(fields))]
                for row in range(batch.num_rows):
                    found = dict(every)
                    for k in range(len(fields)):
                        if len(automaton):
                            for _, names in automaton.iter(texts[k][row]):
                                for name in names:
                                    found[name] = found.get(name, 0) | 1 << k
                    at += [row] * len(found)
                    keywords += found
                    masks += found.values()
                rows_hit = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(rows_hit) for c in range(len(keep))), pa.array(keywords, pa.string()), pa.array(masks, pa.int32())], [*keep, "keyword", "mask"])

        part = lows.mapInArrow(search, StructType([*kinds, StructField("keyword", StringType()), StructField("mask", IntegerType())]))
        out = part if out is None else out.unionAll(part)
    return out


def keyword_top(
    rows: DataFrame, specs: DataFrame, fields: dict[str, str], name: str, row_no: str, k: int, weights: dict[str, float] = FIELD_WEIGHTS, by_score: bool = False, block: int = KEYWORD_BLOCK
) -> DataFrame:
    """(spec_id, row_no, name, hit_fields, keyword_score, place): the first ``k`` matching rows of each spec (spec_id, keywords).

    The first by name, then row number, as the limit comes before the score; ``by_score`` ranks by
    score first. Distinct keywords are looked for once, whatever the number of specs that share
    them, and only ids and names are ranked; other columns are joined to what is left.
    """
    asked = specs.select("spec_id", F.explode(F.array_distinct("keywords")).alias("keyword"))
    hits = keyword_hits(rows, asked, fields, [row_no, name], block)
    scored = hits.join(asked, "keyword").groupBy("spec_id", row_no, name).agg(F.bit_or("mask").alias("mask")).withColumn("keyword_score", keyword_score(F.col("mask"), fields, weights))
    order = [F.desc("keyword_score")] * by_score + [F.col(name), F.col(row_no)]
    place = F.row_number().over(Window.partitionBy("spec_id").orderBy(*order))
    top = scored.withColumn("place", place).where(F.col("place") <= k).where("keyword_score > 0")
    return top.select("spec_id", row_no, name, hit_names(F.col("mask"), fields).alias("hit_fields"), "keyword_score", "place")


def match_reason(hits: Column, keywords: Column) -> Column:
    return F.concat(F.lit("Keyword matched "), F.array_join(hits, ", "), F.lit(" for: "), F.array_join(keywords, ", "))


def keyword_evidence(keywords: Column, fields: dict[str, str], url: Column | None = None) -> Column:
    """A snippet of every field that holds text, around its first keyword or else its start: array<struct<text, source_url, source>>."""
    where = F.lit(None).cast("string") if url is None else url
    made = F.array(*(F.struct(snippet(F.col(c), keywords).alias("text"), where.alias("source_url"), F.lit(n).alias("source")) for n, c in fields.items())).cast(EVIDENCE)
    return F.filter(made, lambda e: e["text"] != "")


def dedupe_evidence(evidence: Column, limit: int = 3) -> Column:
    """The first ``limit`` snippets of different texts, without regard to case."""
    kept = F.aggregate(evidence, F.array().cast(EVIDENCE), lambda acc, e: F.when(F.exists(acc, lambda a: F.lower(a["text"]) == F.lower(e["text"])), acc).otherwise(F.array_append(acc, e)))
    return F.slice(kept, 1, limit)


def unit(matrix: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norm, out=np.zeros_like(matrix), where=norm > 0)


def matrix_of(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def query_blocks(queries: DataFrame, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and unit vectors of the queries in blocks of about ``block``."""
    n = -(-queries.count() // block)
    for b in range(n):
        rows = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == b).orderBy("query_id").toArrow()
        if rows.num_rows:
            yield rows.column(0).to_numpy(), unit(matrix_of(rows.column(1).combine_chunks()))


class Best:
    """The running ``k`` best of each query: similarity down, then id up."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.sims, self.ids = [np.zeros(0) for _ in range(n)], [np.zeros(0, np.int64) for _ in range(n)]
        self.least = np.full(n, -np.inf)  # what a newcomer must reach

    def add(self, queries: np.ndarray, sims: np.ndarray, ids: np.ndarray) -> None:
        reached = sims >= self.least[queries, None]
        for row in np.flatnonzero(reached.any(axis=1)).tolist():
            q, new = queries[row], reached[row] & np.isfinite(sims[row])
            s, i = np.concatenate([self.sims[q], sims[row][new]]), np.concatenate([self.ids[q], ids[new]])
            first = np.lexsort((i, -s))[: self.k]
            self.sims[q], self.ids[q] = s[first], i[first]
            if len(first) == self.k:
                self.least[q] = s[first[-1]]

    def batch(self, query_ids: np.ndarray) -> pa.RecordBatch:
        columns = [np.repeat(query_ids, [len(i) for i in self.ids]), np.concatenate([np.zeros(0, np.int64), *self.ids]), np.concatenate([np.zeros(0), *self.sims])]
        return pa.record_batch([pa.array(c) for c in columns], names=["query_id", "vec_id", "similarity"])


#: Clusters of the approximate search, those that a query looks into, and vectors that the centres are fitted on at most.
CLUSTERS, PROBES, SAMPLE, SEED = 64, 32, 20_000, 11
AT_ONCE = 512


def fit_centres(vectors: DataFrame, clusters: int = CLUSTERS, sample: int = SAMPLE, rounds: int = 8, seed: int = SEED) -> np.ndarray:
    """Unit centres of ``clusters`` groups, by spherical k-means on about ``sample`` vectors spread over the table."""
    rows = vectors.where("embedding is not null").select("embedding")
    taken = rows.sample(min(1.0, sample / max(1, rows.count())), seed).limit(2 * sample).toArrow()
    data = unit(matrix_of(taken.column(0).combine_chunks())) if taken.num_rows else np.zeros((0, 1))
    if len(data) <= clusters:
        return data
    centres = data[np.random.default_rng(seed).choice(len(data), clusters, replace=False)]
    for _ in range(rounds):
        own = (data @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, data)
        centres = np.where(np.bincount(own, minlength=clusters)[:, None] > 0, unit(sums), centres)
    return centres


def cosine_top(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = QUERY_BLOCK, least: float | None = None, centres: np.ndarray | None = None, probes: int = PROBES) -> DataFrame:
    """(query_id, vec_id, similarity, rank): the ``k`` nearest others of each query; exact without ``centres``.

    vectors: vec_id, embedding; queries: query_id, embedding. A block of queries
    meets the vectors batch by batch; a task keeps the best ``k`` of each query over all its
    batches and hands them on once; the rest is a ranking of these. Vectors of null or zero length have similarity 0.
    With ``centres`` a vector meets only the queries that have its nearest centre among their nearest ``probes``.
    """
    schema = "query_id long, vec_id long, similarity double"
    out = None
    for ids, matrix in query_blocks(queries.where("embedding is not null"), block):
        asked = None if centres is None or not len(centres) else np.argsort(-(matrix @ centres.T), axis=1, kind="stable")[:, :probes]
        shared = vectors.sparkSession.sparkContext.broadcast((ids, matrix, centres, asked))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, matrix, centres, asked = shared.value
            best = Best(len(ids), k)

            def meet(queries: np.ndarray, own: np.ndarray, data: np.ndarray) -> None:
                for at in range(0, len(queries), AT_ONCE):
                    some = queries[at : at + AT_ONCE]
                    sims = np.round(matrix[some] @ data.T, 6)
                    sims[ids[some][:, None] == own[None, :]] = -np.inf
                    best.add(some, sims, own)

            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    part = batch.slice(at, 4096)
                    own, data = part.column(0).to_numpy(), unit(matrix_of(part.column(1)))
                    if asked is None:
                        meet(np.arange(len(ids)), own, data)
                        continue
                    nearest = (data @ centres.T).argmax(axis=1)
                    for c in np.unique(nearest).tolist():
                        meet(np.flatnonzero((asked == c).any(axis=1)), own[nearest == c], data[nearest == c])
            yield best.batch(ids)

        part = vectors.where("embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(search, schema)
        out = part if out is None else out.union(part)
    if out is None:
        return vectors.sparkSession.createDataFrame([], f"{schema}, rank int")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id"))
    ranked = out.withColumn("rank", rank).where(F.col("rank") <= k)
    return ranked if least is None else ranked.where(F.col("similarity") >= least)


def cosine_clusters(vectors: DataFrame, queries: DataFrame, k: int = 10, clusters: int = CLUSTERS, probes: int = PROBES) -> DataFrame:
    """As :func:`cosine_top`, approximate: every vector is in the list of its nearest centre, and a query looks into ``probes`` lists. Similarities are exact."""
    return cosine_top(vectors, queries, k, centres=fit_centres(vectors, clusters), probes=probes)


#: The fewest and most hits of a search for browsing.
LEAST_HITS, MOST_HITS = 3, 20


def browse_search(vectors: DataFrame, queries: DataFrame, texts: DataFrame, k: int = 10, key: str = "vec_id") -> DataFrame:
    """The nearest chunks of each query with the columns of ``texts`` (by ``key``); ``k`` is brought within LEAST_HITS and MOST_HITS. A hit without a text drops out."""
    return cosine_top(vectors, queries, max(LEAST_HITS, min(MOST_HITS, k))).join(texts, key)


def of_model(vectors: DataFrame, model: str) -> DataFrame:
    """The index rows of one embedding model; vectors of different models can't be compared."""
    return vectors.where(F.col("model") == model)


def merge_hits(keyword: DataFrame, vector: DataFrame | None, key: Sequence[str], n: int = 50, bonus: float = 0.15, most: float = 1.5, evidence_limit: int = 3) -> DataFrame:
    """Hybrid candidates: keyword_score, vector_score (best of a course), combined_score, degraded and rank <= ``n``.

    Both above 0 add up with a bonus, ``most`` at most; else the larger counts, which is 0 at least but for a
    course that one vector hit alone has found: it keeps a negative score. Ties go by arrival: keyword hits in the order of their ``place``, then courses by their first
    vector hit's ``place``, then by key (a missing place counts as last). Without vectors the keyword
    hits go on alone and are marked as degraded. keyword and vector: the key columns (query
    first), their score, perhaps ``place``, and in both or neither ``reason`` and ``evidence``: reasons are joined in arrival order, and snippets are
    those of the keyword hit, then of each vector hit, of different texts without regard to case, the first ``evidence_limit``.
    """
    told = {"reason", "evidence"} <= set(keyword.columns)
    more = ["reason", "evidence"] if told else []
    arrived = lambda df: F.col("place").cast("long") if "place" in df.columns else F.lit(None).cast("long")
    last = F.lit((1 << 62) - 1)
    k = keyword.select(*key, "keyword_score", arrived(keyword).alias("keyword_place"), *(F.col(c).alias(f"keyword_{c}") for c in more))
    none = F.array().cast(EVIDENCE)
    if vector is None:
        merged = k.withColumns({"vector_score": F.lit(0.0), "vector_place": F.lit(None).cast("long")} | ({"chunks": F.array().cast("array<struct<reason:string,evidence:" + EVIDENCE + ">>")} if told else {}))
    else:
        v = vector.select(*key, "vector_score", arrived(vector).alias("vector_place"), *more)
        order = F.struct(F.coalesce("vector_place", last).alias("at"), (-F.col("vector_score")).alias("score"), *more)
        chunks = [F.transform(F.sort_array(F.collect_list(order)), lambda c: F.struct(c["reason"].alias("reason"), c["evidence"].alias("evidence"))).alias("chunks")] if told else []
        best = v.groupBy(*key).agg(F.max("vector_score").alias("vector_score"), F.count("*").alias("__n"), F.min("vector_place").alias("vector_place"), *chunks)
        merged = k.withColumn("__hit", F.lit(True)).join(best, list(key), "full_outer").na.fill(0.0, ["keyword_score"])
        # beside a keyword hit a vector counts from 0
        merged = merged.withColumn("vector_score", F.when(F.col("__hit"), F.greatest(F.coalesce("vector_score", F.lit(0.0)), F.lit(0.0))).otherwise(F.col("vector_score")))
    both = (F.col("keyword_score") > 0) & (F.col("vector_score") > 0)
    alone = F.col("__hit").isNull() & (F.col("__n") == 1) if vector is not None else F.lit(False)
    score = F.when(both, F.least(F.col("keyword_score") + F.col("vector_score") + bonus, F.lit(most))).when(alone, F.col("vector_score")).otherwise(F.greatest("keyword_score", "vector_score"))
    merged = merged.withColumn("combined_score", F.round(score, 6)).withColumn("degraded", F.lit(vector is None))
    late = [F.col("__hit").isNull()] if vector is not None else []
    order = [F.desc("combined_score"), *late, F.coalesce("keyword_place", last), F.coalesce("vector_place", last), *key[1:]]
    rank = F.row_number().over(Window.partitionBy(key[0]).orderBy(*order))
    merged = merged.withColumn("rank", rank).where(F.col("rank") <= n).drop("keyword_place", "vector_place", "__hit", "__n")
    if told:
        spoken = F.concat_ws("; ", "keyword_reason", F.nullif(F.array_join(F.col("chunks.reason"), "; "), F.lit("")))
        snippets = F.concat(F.coalesce("keyword_evidence", none), F.coalesce(F.flatten(F.col("chunks.evidence")), none))
        merged = merged.withColumns({"reason": spoken, "evidence": dedupe_evidence(snippets, evidence_limit)}).drop("keyword_reason", "keyword_evidence", "chunks")
    return merged
