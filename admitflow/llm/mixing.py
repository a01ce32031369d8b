"""Mixing sources to target weights, in DataFrame expressions alone.

Tokens are summed by cell (source, language, topic). Iterative proportional
fitting rakes the cells' weights until each marginal meets its target; each
document is then sampled with a probability in proportion to its cell's weight
per token, calibrated to the wanted number of tokens. Probabilities stop at 1;
what a cell lacks by that is its documents' ``weight`` (1 elsewhere), so that
weighted tokens meet the targets.

Topics are groups of terms that stand in the same documents. Counted over all rows
of the table, the ``TERMS`` most frequent terms that stand in RARE to COMMON of the
documents get a vector each: how often they stand beside each of the others, again
in all rows. Spherical k-means on these vectors (they
are at most TERMS x TERMS numbers) gives ``TOPICS`` centroids; a topic is named by
its most frequent term. A document has the topic whose terms weigh most in it
(each by how rare it is). A column can take its place. Each text is read for the counts
of all terms, then once more, when the places of its frequent ones are written beside the rows
(Parquet, in the shared checkpoint folder); pairs and topics come from these.

Targets that aren't given are the marginals of the cells' shares to the power
``FLATTEN``: so they agree with each other, and the cells that there are can always
meet them. A given target must have a positive share for each observed value.
Raking goes on until every marginal is within ``TOLERANCE`` of its target. Only where
a further ``ROUNDS_A_CHECK`` rounds bring the marginals less than a hundredth nearer, the
targets can't be met by the cells that there are: a warning then names the values
that are off and by how much (``strict`` makes it an error), and the last round
counts. The choice of a document depends on its id, source and language alone.

Defined results: null source, language or topic is the value ``unknown``; null
or empty text has no tokens, and its documents get their cell's probability
(0 in a cell without tokens); repeated rows share their fate; an empty table
gives no rows; other columns pass, those named as a result are replaced.
"""

from __future__ import annotations

import math
import uuid
import warnings
import zlib
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from admitflow.llm.spans import let
from admitflow.session import checkpoint_dir, cut, fresh

FLATTEN, SHARE_OF_TOKENS, SEED = 0.5, 0.5, 17
TOLERANCE, ROUNDS_A_CHECK, ROUNDS_A_CUT, LEAST_PROGRESS = 1e-5, 48, 1, 0.01
#: Topics, terms that they are made of at most, and the shares of documents that these lie between.
TOPICS, TERMS, RARE, COMMON = 12, 400, 0.004, 0.3
#: Small maps that the frequent terms are looked up in, by checksum.
TERM_MAPS = 512
#: Cells of at most this number are raked as arrays of one row and broadcast; more are dealt and joined by shuffling.
MAX_SMALL_CELLS = 20_000
DIMS = ("source", "lang", "topic")


def tokens(text: Column) -> Column:
    """White-space separated words."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[ \t-\r]+"), "")).cast("long")


def terms(text: Column) -> Column:
    """The runs of five letters or more, in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(r"\p{L}{5,}"), F.lit(0))


Topics = dict[str, tuple[str, float]]


def frequent_terms(docs: DataFrame, text_col: str = "text", most: int = TERMS) -> tuple[dict[str, int], int]:
    """The number of rows of each of the ``most`` frequent terms between RARE and COMMON, by falling number, and the number of all rows."""
    rows = docs.count()
    df = docs.select(F.explode(F.array_distinct(terms(F.col(text_col)))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    top = df.where((F.col("n") > 1) & (F.col("n") >= RARE * rows) & (F.col("n") <= COMMON * rows)).orderBy(F.desc("n"), "term").limit(most)
    return {r["term"]: r["n"] for r in top.collect()}, rows


def places(text: Column, names: list[str]) -> Column:
    """The places in ``names`` of the text's terms that are there, in the text's order, repeats included."""
    maps: list[list[Column]] = [[] for _ in range(TERM_MAPS)]
    for k, name in enumerate(names):
        maps[zlib.crc32(name.encode()) % TERM_MAPS] += [F.lit(name), F.lit(k)]
    table = F.array(*(F.create_map(*m) if m else F.create_map(F.lit(""), F.lit(-1)) for m in maps))
    known = F.filter(terms(text), lambda w: w.isin(names))
    return F.transform(known, lambda w: F.element_at(F.get(table, F.pmod(F.crc32(w), F.lit(TERM_MAPS)).cast("int")), w))


def pair_counts(found: DataFrame) -> DataFrame:
    """(a, b, n): the rows whose ``places`` hold both a and b, a < b."""
    own = found.select(F.sort_array(F.array_distinct("places")).alias("own"))
    first = own.select(F.posexplode("own").alias("at", "a"), "own")
    pairs = first.select("a", F.explode(F.slice("own", F.col("at") + 2, F.size("own"))).alias("b"))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"))


def group_terms(found: DataFrame, many: dict[str, int], rows: int, n: int = TOPICS) -> Topics:
    """term: (topic, weight). found: the ``places`` of every row among ``many``."""
    names = list(many)
    beside = {t: {t: 1.0} for t in names}
    for r in pair_counts(found).orderBy("a", "b").collect():
        a, b = names[r["a"]], names[r["b"]]
        beside[a][b] = beside[b][a] = r["n"] / math.sqrt(many[a] * many[b])
    group = cluster(names, beside, n)
    name: dict[int, str] = {}
    for term in names:  # by frequency
        name.setdefault(group[term], term)
    return {t: (name[group[t]], math.log(rows / k)) for t, k in many.items()}


def fit_topics(docs: DataFrame, text_col: str = "text", n: int = TOPICS, most: int = TERMS) -> Topics:
    """term: (topic, weight), of the terms of all rows."""
    many, rows = frequent_terms(docs, text_col, most)
    return group_terms(docs.select(places(F.col(text_col), list(many)).alias("places")), many, rows, n) if many else {}


def cluster(names: list[str], vectors: dict[str, dict[str, float]], n: int, rounds: int = 10) -> dict[str, int]:
    """Spherical k-means of sparse vectors into at most ``n`` groups. It begins with the first name and, in turn, the name least like the ones begun with (the earliest of those)."""

    def unit(v: dict[str, float]) -> dict[str, float]:
        size = math.sqrt(sum(x * x for x in v.values())) or 1.0
        return {k: x / size for k, x in v.items()}

    def like(a: dict[str, float], b: dict[str, float]) -> float:
        return sum(x * b.get(k, 0.0) for k, x in a.items())

    points = {t: unit(vectors[t]) for t in names}
    centres, nearest = [], dict.fromkeys(names, -1.0)
    while len(centres) < min(n, len(names)):
        first = min(names, key=nearest.__getitem__)
        centres.append(points[first])
        nearest = {t: max(v, like(points[t], centres[-1])) for t, v in nearest.items()}
    own: dict[str, int] = {}
    for _ in range(rounds):
        new = {t: max(range(len(centres)), key=lambda k: like(points[t], centres[k])) for t in names}  # noqa: B023
        if new == own:
            break
        own = new
        for k in range(len(centres)):
            total: dict[str, float] = {}
            for t in (t for t in names if own[t] == k):
                for x, v in points[t].items():
                    total[x] = total.get(x, 0.0) + v
            centres[k] = unit(total) if total else centres[k]
    return own


def topic_at(found: Column, known: Topics) -> Column:
    """The topic whose terms weigh most among ``found``, the places in ``known`` (the last by name of several); null without any."""
    names, weights = (F.array(*(F.lit(v[k]) for v in known.values())) for k in (0, 1))
    each = F.transform(found, lambda i: F.struct(F.get(names, i).alias("topic"), F.get(weights, i).alias("weight")))

    def heaviest(own: Column) -> Column:
        sums = F.transform(F.array_distinct(own["topic"]), lambda t: F.struct(F.aggregate(own, F.lit(0.0), lambda acc, x: acc + F.when(x["topic"] == t, x["weight"]).otherwise(0.0)).alias("weight"), t.alias("topic")))
        return F.when(F.size(own) > 0, F.array_max(sums)["topic"])

    return let(each, heaviest)


def topic(text: Column, known: Topics) -> Column:
    """The topic whose terms weigh most in the text; null without any term."""
    return topic_at(places(text, list(known)), known) if known else F.lit(None).cast("string")


def rounds_at_once(cells: DataFrame, dims: tuple[str, ...], rounds: int) -> DataFrame:
    """``rounds`` rounds of raking over few cells: their shares are an array of one row, which a fold goes over; no shuffle a round."""
    row = cells.agg(F.array_sort(F.collect_list(F.struct(*dims, "tokens", "share", *(f"target_{d}" for d in dims)))).alias("c"))
    place, value, members, target = ({d: f"{kind}_{k}" for k, d in enumerate(dims)} for kind in ("place", "value", "members", "target"))
    row = row.withColumns({value[d]: F.array_distinct(F.transform("c", lambda x: x[d])) for d in dims})  # noqa: B023
    row = row.withColumns({place[d]: F.transform("c", lambda x: (F.array_position(F.col(value[d]), x[d]) - 1).cast("int")) for d in dims})  # noqa: B023
    every = F.sequence(F.lit(0), F.size("c") - 1)
    row = row.withColumns({members[d]: F.transform(value[d], lambda _, k: F.filter(every, lambda j: F.get(F.col(place[d]), j) == k)) for d in dims})  # noqa: B023
    row = row.withColumns({target[d]: F.transform(members[d], lambda m: F.get(F.col("c"), F.get(m, F.lit(0)))[f"target_{d}"]) for d in dims})  # noqa: B023

    def one_dim(shares: Column, d: str) -> Column:
        sums = F.transform(members[d], lambda m: F.aggregate(m, F.lit(0.0), lambda acc, j: acc + F.get(shares, j)))
        factors = F.zip_with(target[d], sums, lambda t, x: t / F.greatest(x, F.lit(1e-300)))
        return let(factors, lambda f: F.transform(shares, lambda x, j: x * F.get(f, F.get(F.col(place[d]), j))))

    def one_round(shares: Column, _: Column) -> Column:
        return reduce(lambda s, d: let(s, lambda x: one_dim(x, d)), dims, shares)

    fold = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.transform("c", lambda x: x["share"]), one_round)
    done = row.where(F.size("c") > 0).select("c", fold.alias("s")).select(F.inline(F.zip_with("c", "s", lambda x, v: x.withField("share", v))))
    return done.select(*dims, "tokens", "share", *(f"target_{d}" for d in dims))


def rake(cells: DataFrame, dims: tuple[str, ...], targets: dict[str, dict[str, float]], flatten: float = FLATTEN, small_cells: int = MAX_SMALL_CELLS, strict: bool = False) -> DataFrame:
    """``cells`` (dims, tokens) with ``share``: the fitted share of all tokens."""
    cells = cut(cells.where("tokens > 0"))
    size = cells.agg(F.sum("tokens").alias("tokens"), F.count("*").alias("cells")).first()
    small = size["cells"] <= small_cells

    def with_sum(frame: DataFrame, by: list[str], name: str, value: Column) -> DataFrame:
        """The sum of ``value`` over the cells of equal ``by`` beside each: a partial sum joined back, as a window would gather them."""
        return frame.join(frame.groupBy(*by).agg(F.sum(value).alias(name)), by)

    cells = cells.withColumn("share", F.col("tokens") / F.lit(float(size["tokens"] or 1)))
    for d in dims:
        if d in targets:
            wanted = F.element_at(F.create_map(*[F.lit(x) for pair in targets[d].items() for x in pair]), F.col(d)).cast("double")
            cells = cells.withColumn(f"target_{d}", wanted)
        else:
            cells = with_sum(cells, [d], f"target_{d}", F.pow("share", F.lit(flatten)))
    cells = cut(cells)
    if missing := cells.where(" or ".join(f"target_{d} is null or target_{d} <= 0" for d in dims)).first():
        raise ValueError(f"no positive target for {missing}")
    sums = {d: cells.groupBy(d).agg(F.first(f"target_{d}").alias("t")).agg(F.sum("t")).first()[0] or 1.0 for d in dims}
    cells = cells.withColumns({f"target_{d}": F.col(f"target_{d}") / F.lit(sums[d]) for d in dims})
    if not size["cells"]:
        return cells.select(*dims, "tokens", "share")
    before = math.inf
    while True:
        if small:
            cells = cut(rounds_at_once(cells, dims, ROUNDS_A_CHECK))
        else:
            for _ in range(ROUNDS_A_CUT):
                for d in dims:
                    cells = with_sum(cells, [d], "marginal", F.col("share")).withColumn("share", F.col("share") * F.col(f"target_{d}") / F.col("marginal")).drop("marginal")
            cells = cut(cells)
        # the last dimension has just been met
        off = reduce(DataFrame.unionAll, (cells.groupBy(F.lit(d.removeprefix("mix_")).alias("dim"), F.col(d).alias("value")).agg((F.sum("share") / F.first(f"target_{d}") - 1).alias("off")) for d in dims))
        worst = off.orderBy(F.desc(F.abs("off")), "dim", "value").limit(5).collect()
        now = abs(worst[0]["off"])
        if now < TOLERANCE:
            break
        if now > before * (1 - LEAST_PROGRESS) ** (1 if small else ROUNDS_A_CUT / ROUNDS_A_CHECK):
            told = "targets can't be met by the cells that there are: " + ", ".join(f"{r['dim']} {r['value']} is off by {r['off']:+.3g} of its target" for r in worst if abs(r["off"]) >= TOLERANCE)
            if strict:
                raise RuntimeError(told)
            warnings.warn(told, stacklevel=2)
            break
        before = now
    return cells.select(*dims, "tokens", "share")


def calibrate(fitted: DataFrame, wanted: float) -> float:
    """c such that the tokens of all cells, each kept with least(1, c x share / tokens), sum up to ``wanted``."""
    rate = F.col("share") / F.col("tokens")
    c = wanted
    while True:  # each round but the last finds another cell that is kept whole
        full = F.lit(c) * rate >= 1
        got = fitted.agg(F.sum(F.when(full, F.col("tokens")).otherwise(0)).alias("full"), F.sum(F.when(full, 0.0).otherwise(F.col("share"))).alias("rest")).first()
        if not got["rest"]:
            return c
        new = (wanted - (got["full"] or 0)) / got["rest"]
        if new <= c * (1 + 1e-9):
            return c
        c = new


def mix(
    docs: DataFrame,
    targets: dict[str, dict[str, float]] | None = None,
    share_of_tokens: float = SHARE_OF_TOKENS,
    flatten: float = FLATTEN,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    lang_col: str = "lang",
    topic_of: Column | None = None,
    small_cells: int = MAX_SMALL_CELLS,
    strict: bool = False,
) -> DataFrame:
    """``docs`` with (or with new) mix_source, mix_lang, mix_topic, mix_tokens, mix_probability, mix_weight and mix_sampled."""
    own = fresh(docs)
    made = [*(f"mix_{d}" for d in DIMS), "mix_tokens", "mix_probability", "mix_weight", "mix_sampled"]
    rest = [c for c in docs.columns if c.lower() not in made]
    value = lambda c: F.coalesce(c.cast("string"), F.lit("unknown"))
    kept = [*(f"`{c}`" for c in rest), F.col(id_col).cast("string").alias(f"{own}id"), value(F.col(source_col)).alias("mix_source"), value(F.col(lang_col)).alias("mix_lang"), tokens(F.col(text_col)).alias("mix_tokens")]
    many, rows = frequent_terms(docs, text_col) if topic_of is None else ({}, 0)
    if many:
        path = f"{checkpoint_dir(docs.sparkSession)}/mixing-{uuid.uuid4().hex}"
        docs.select(*kept, places(F.col(text_col), list(many)).alias(f"{own}places")).write.option("compression", "zstd").parquet(path)
        given = docs.sparkSession.read.parquet(path)
        found = F.col(f"{own}places")
        given = given.withColumn("mix_topic", value(topic_at(found, group_terms(given.select(found.alias("places")), many, rows)))).drop(f"{own}places")
    else:
        given = docs.select(*kept, value(F.lit(None) if topic_of is None else topic_of).alias("mix_topic"))
    dims = tuple(f"mix_{d}" for d in DIMS)
    cells = given.groupBy(*dims).agg(F.sum("mix_tokens").alias("tokens"))
    fitted = rake(cells, dims, {f"mix_{d}": t for d, t in (targets or {}).items()}, flatten, small_cells, strict)
    size = fitted.agg(F.sum("tokens").alias("tokens"), F.count("*").alias("cells")).first()
    c = calibrate(fitted, share_of_tokens * (size["tokens"] or 0))
    want = F.lit(float(c)) * F.col("share") / F.col("tokens")
    rates = fitted.select(*dims, F.least(want, F.lit(1.0)).alias("mix_probability"), F.greatest(want, F.lit(1.0)).alias("mix_weight"))
    if size["cells"] <= small_cells:
        rates = F.broadcast(rates)
    drawn = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(f"{own}id"), F.col("mix_source"), F.col("mix_lang")), 11) / F.lit(float(1 << 53))
    rated = given.join(rates, list(dims), "left").withColumns({"mix_probability": F.coalesce("mix_probability", F.lit(0.0)), "mix_weight": F.coalesce("mix_weight", F.lit(1.0))})
    return rated.withColumn("mix_sampled", drawn < F.col("mix_probability")).select(*(f"`{c}`" for c in rest), *made)
