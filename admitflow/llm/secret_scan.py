"""Secret scan in DataFrame expressions alone: patterns, and a randomness test battery.

The patterns find assignments, access keys and hexadecimal runs. The battery
looks at other long runs of key characters: it infers their encoding (and with
it the alphabet), and tests how far their characters depart from a uniform random string, by
chi-squared uniformity over the alphabet, by runs above and below its middle,
and by the serial correlation of neighbours. The three p-values are combined
(Cauchy). Random strings have uniform p-values, structured ones small ones.
Each stratum (encoding, length class) gets the lowest threshold at which the
estimated share of structured strings among those above it is at most ``FDR``
(the random ones are estimated from the upper half of the p-values). Different
strings count once each, so copies of a key don't move a threshold. Short
strings, which the tests can't tell apart, are thus held to their own stratum's
threshold. A stratum of fewer than ``SPARSE`` different strings says nothing
about their shares; it takes a fixed threshold by length. The strata are bounded (encodings x length classes x bins), and so
is what reaches the driver.

Places are code points with exclusive ends. Defined results: null text is
empty and has no spans; repeated rows are scanned each on their own; an empty
table gives no rows; columns other than the text (and id) pass or are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from admitflow.llm.spans import clean, let, matches, replace_spans
from admitflow.session import cut, fresh

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
# A failing access key or hexadecimal run can't hide a later good one, so their lengths are part of the pattern.
ACCESS, HEX = r"AKIA[A-Z0-9]{14,}", r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex")
CANDIDATE = r"[A-Za-z0-9+/_-]{24,}={0,2}"
#: Encodings in the order of inference: name, pattern, alphabet. Fixed values of the public encodings.
ENCODINGS = (
    ("hex_lower", r"^[0-9a-f]+$", "0123456789abcdef"),
    ("hex_upper", r"^[0-9A-F]+$", "0123456789ABCDEF"),
    ("base32", r"^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", r"^[a-z0-9]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base64", r"^[A-Za-z0-9+/]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", r"^[A-Za-z0-9_-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
FDR, BINS, LEAST_P = 0.1, 20, 0.01
#: Strata of fewer different strings take a fixed threshold: that of the first length class (twice the binary logarithm) not below theirs.
SPARSE, FIXED = 20, ((9, 0.1), (11, 0.05))
CANDIDATES = "array<struct<start:bigint,end:bigint,stratum:string,p:double,key:bigint>>"


def base_spans(text: Column) -> Column:
    """array<struct<start, kind_no, end>> of the patterns' matches, by start, then kind."""
    long_value = lambda x: F.length(F.regexp_extract(x, ASSIGN_VALUE, 1)) >= 12
    by_kind = (matches(text, ASSIGN, long_value), matches(text, ACCESS), matches(text, HEX))

    def numbered(no: int) -> Column:
        return F.transform(by_kind[no], lambda s: F.struct(s["start"].alias("start"), F.lit(no).alias("kind_no"), s["end"].alias("end")))

    return F.array_sort(F.concat(*map(numbered, range(len(KINDS)))))


def normal_cdf(z: Column) -> Column:
    z = F.least(F.greatest(z, F.lit(-8.0)), F.lit(8.0))
    return 1 / (1 + F.exp(-(1.5976 * z + 0.070565 * z * z * z)))


def randomness(token: Column, alphabet: Column) -> Column:
    """The combined p-value of the battery under a uniform random string over ``alphabet``."""
    size = F.length(alphabet).cast("double")

    def battery(v: Column) -> Column:
        n = F.size(v).cast("double")
        counts = F.transform(F.array_distinct(v), lambda c: F.size(F.filter(v, lambda x: x == c)).cast("double"))
        square = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x * x)
        chi, df = square * size / n - n, size - 1
        uniform = 1 - normal_cdf((F.pow(F.greatest(chi, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)))
        high = F.transform(v, lambda x: 2 * x > size)
        up = F.size(F.filter(high, lambda x: x)).cast("double")
        down = n - up
        pairs = F.transform(F.slice(v, 2, F.size(v)), lambda x, i: F.struct(F.get(v, i).alias("a"), x.alias("b")))
        runs = 1 + F.size(F.filter(pairs, lambda p: (2 * p["a"] > size) != (2 * p["b"] > size)))
        spread = 2 * up * down * (2 * up * down - n) / (n * n * (n - 1))
        by_runs = F.when(spread > 0, 2 - 2 * normal_cdf(F.abs(runs - (2 * up * down / n + 1)) / F.sqrt(spread))).otherwise(0.0)
        mean = F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / n
        variance = F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
        together = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + (p["a"] - mean) * (p["b"] - mean))
        serial = F.when(variance > 0, 2 - 2 * normal_cdf(F.abs(together / variance) * F.sqrt(n))).otherwise(0.0)
        inner = [F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6)) for p in (uniform, by_runs, serial)]
        cauchy = sum(F.tan((0.5 - p) * 3.141592653589793) for p in inner) / 3
        return 0.5 - F.atan(cauchy) / 3.141592653589793

    values = F.transform(F.split(token, ""), lambda c: F.position(c, alphabet).cast("double") - 1)
    return let(F.filter(values, lambda x: x >= 0), battery)


def candidates(text: Column, base: Column) -> Column:
    """Long runs of key characters outside of the base spans, with stratum and p-value."""
    found = F.filter(matches(text, CANDIDATE), lambda c: ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    found = F.filter(found, lambda c: c["value"].rlike("[0-9]") & c["value"].rlike("[A-Za-z]"))

    def judged(c: Column) -> Column:
        token = F.regexp_replace(c["value"], "=+$", "")
        name, alphabet = F.lit(None).cast("string"), F.lit(None).cast("string")
        for known, pattern, letters in reversed(ENCODINGS):
            name = F.when(token.rlike(pattern), known).otherwise(name)
            alphabet = F.when(token.rlike(pattern), letters).otherwise(alphabet)
        stratum = F.concat_ws(":", name, F.floor(2 * F.log2(F.length(token).cast("double"))).cast("string"))
        p = F.when(alphabet.isNull(), F.lit(0.0)).otherwise(let(F.struct(token.alias("t"), alphabet.alias("a")), lambda s: randomness(s["t"], s["a"])))
        return F.struct(c["start"].alias("start"), c["end"].alias("end"), stratum.alias("stratum"), p.alias("p"), F.xxhash64(token).alias("key"))

    return F.transform(found, judged).cast(CANDIDATES)


def thresholds(found: DataFrame, fdr: float = FDR) -> dict[str, float]:
    """For each stratum the lowest p-value bin that keeps the false discoveries among those above at ``fdr``; strata without one are left out, sparse ones take ``FIXED``."""
    bins = (
        found.select(F.explode("candidates").alias("c"))
        .groupBy(F.col("c.stratum").alias("stratum"), F.col("c.key").alias("key"))
        .agg(F.min("c.p").alias("p"))
        .groupBy("stratum", F.least(F.floor(F.col("p") * BINS), F.lit(BINS - 1)).alias("bin"))
        .agg(F.count("*").alias("n"))
    )
    above = Window.partitionBy("stratum").orderBy(F.desc("bin"))
    everything = Window.partitionBy("stratum")
    per_bin = F.sum(F.when(F.col("bin") >= BINS // 2, F.col("n")).otherwise(0)).over(everything) / (BINS - BINS // 2)
    rated = bins.withColumns({"found": F.sum("n").over(above), "random": per_bin * (BINS - F.col("bin"))})
    good = F.when((F.col("found") - F.col("random")) <= fdr * F.col("found"), F.col("bin"))
    strata = rated.groupBy("stratum").agg(F.min(good).alias("bin"), F.sum("n").alias("n")).collect()
    fixed = lambda stratum: next((limit for top, limit in FIXED if int(stratum.split(":")[-1]) <= top), LEAST_P)
    return {r["stratum"]: fixed(r["stratum"]) if r["n"] < SPARSE else max(r["bin"] / BINS, LEAST_P) for r in strata if r["n"] < SPARSE or r["bin"] is not None}


def discovered(candidates: Column, limits: dict[str, float]) -> Column:
    if not limits:
        return F.filter(candidates, lambda c: F.lit(False))
    table = F.create_map(*[F.lit(x) for pair in sorted(limits.items()) for x in pair])
    return F.filter(candidates, lambda c: F.coalesce(c["p"] >= F.element_at(table, c["stratum"]), F.lit(False)))


def spans_of(base: Column, random: Column) -> Column:
    """array<struct<start, kind_no, end>> of all spans, by start, then kind."""
    return F.array_sort(F.concat(base, F.transform(random, lambda c: F.struct(c["start"].alias("start"), F.lit(len(KINDS)).alias("kind_no"), c["end"].alias("end")))))


def written(spans: Column) -> Column:
    names = F.array(*map(F.lit, (*KINDS, "random")))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind_no"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fdr: float = FDR) -> DataFrame:
    """doc_id, base (spans of the patterns), candidates and random (what the battery adds)."""
    texts = docs.select(F.col(id_col).alias("doc_id"), clean(F.col(text_col)).alias("text"))
    based = texts.select("doc_id", "text", base_spans(F.col("text")).alias("base"))
    found = cut(based.select("doc_id", "base", candidates(F.col("text"), F.col("base")).alias("candidates")))
    return found.withColumn("random", discovered(F.col("candidates"), thresholds(found, fdr)))


def digest(scanned: DataFrame) -> DataFrame:
    number = lambda no: F.size(F.filter("base", lambda s: s["kind_no"] == no)).cast("long")
    return scanned.select(
        "doc_id",
        *(number(no).alias(f"n_{kind}") for no, kind in enumerate(KINDS)),
        F.sha2(written(F.col("base")), 256).alias("base_sha256"),
        written(spans_of(F.col("base"), F.col("random"))).alias("spans"),
    )


def redact(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]", fdr: float = FDR, length_col: str | None = None) -> DataFrame:
    """``docs`` with every span replaced by ``mask``; all rows and columns stay, whatever their names, and a null text stays null.

    ``length_col``: a column that holds the text's length, which follows where the text has changed.
    """
    own = fresh(docs)
    text, base, more, new = (f"{own}{x}" for x in ("text", "base", "candidates", "masked"))
    based = docs.withColumn(text, clean(F.col(text_col))).withColumn(base, base_spans(F.col(text)))
    found = based.withColumn(more, candidates(F.col(text), F.col(base)))
    limits = thresholds(found.select(F.col(more).alias("candidates")), fdr)
    spans = spans_of(F.col(base), discovered(F.col(more), limits))
    original = F.col(text_col)
    masked = let(spans, lambda s: F.when((F.size(s) == 0) | original.isNull(), original).otherwise(replace_spans(original, s, lambda _: F.lit(mask))))
    out = found.withColumn(new, masked)
    changed = {text_col: F.col(new)}
    if length_col is not None:
        changed[length_col] = F.when(F.col(new) == original, F.col(length_col)).otherwise(F.length(new).cast(docs.schema[length_col].dataType))
        changed[length_col] = F.when(original.isNull(), F.col(length_col)).otherwise(changed[length_col])
    return out.withColumns(changed).select(*(f"`{c}`" for c in docs.columns))
