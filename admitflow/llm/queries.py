"""The registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from admitflow.session import read

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(f=None, sql: str | None = None):
    if f is None:
        return lambda g: query(g, sql)
    QUERIES[f.__name__] = f
    if sql:
        ORACLE[f.__name__] = sql
    return f


#: Places and words of every text; ASCII white space alone divides words, so all other spaces are part of one.
WORDS = r"w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0b\x0c\r]+'), lambda x: x <> '') AS words FROM documents)"

REPEATS = rf"""WITH {WORDS}, t AS (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS pos FROM w),
s AS (SELECT doc_id, pos, word, CASE WHEN count(*) OVER ahead = 50 THEN string_agg(word, ' ') OVER ahead END AS win FROM t WINDOW ahead AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)),
f AS (SELECT win, min(doc_id) AS least FROM s WHERE win IS NOT NULL GROUP BY 1), r AS (SELECT s.doc_id, s.pos, s.word, coalesce(f.least < s.doc_id, false) AS starts FROM s LEFT JOIN f USING (win)),
k AS (SELECT doc_id, pos, word, bool_or(starts) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM r),
g AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM k GROUP BY 1)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(kept_sha256, sha256('')) AS kept_sha256 FROM w LEFT JOIN g USING (doc_id)"""

ESCAPED = r"length(x) + length(x) - length(replace(replace(replace(replace(x, '<', ''), '[', ''), '|', ''), '', ''))"
CHATS = rf"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r, text AS t FROM conversations UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]', 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]', 'assistant', '</s>[INST] ok [/INST]')
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST)) AS turns_sha256,
CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST) FILTER (role = 'assistant'), '')) AS loss_sha256,
CAST(sum(8 + {ESCAPED.replace('x', 'role')} + 8 + {ESCAPED.replace('x', 'text')} + 7) AS BIGINT) AS formatted_chars FROM c GROUP BY conv_id"""

LETTERS = lambda kind: rf"length(text) - length(regexp_replace(text, '\p{{{kind}}}', '', 'g'))"  # noqa: E731
QUALITY = rf"""WITH {WORDS}, d AS (SELECT doc_id, words, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS lines FROM w JOIN documents USING (doc_id)),
t AS (SELECT doc_id, unnest(range(len(words) - 2)) AS pos, unnest(list_zip(words, words[2:], words[3:])[1:len(words) - 2]) AS win FROM w WHERE len(words) >= 3),
r AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, win) > 1 AS twice FROM t), p AS (SELECT doc_id, unnest([pos, pos + 1, pos + 2]) AS pos FROM r WHERE twice), n AS (SELECT doc_id, count(DISTINCT pos) AS n_repeat_words FROM p GROUP BY 1),
m AS (SELECT doc_id, text, lines, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
list_filter(lines, lambda x: regexp_matches(x, '[^ 	

]')) AS filled FROM d),
q AS (SELECT *, CAST(len(filled) - len(list_distinct(filled)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS repeats FROM m LEFT JOIN n USING (doc_id)), b AS (SELECT *, n_words < 50 OR 100 * repeats > 50 * n_words AS base_failed FROM q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, repeats AS n_repeat_words, base_failed, NOT (base_failed OR n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 40 * n_words OR 2 * n_dup_lines > len(lines)
OR 2 * ({LETTERS('Lu')}) > ({LETTERS('L')}) OR 2 * ({LETTERS('L')}) < word_chars OR 2 * len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[ 	]*$'))) > len(lines)) AS kept FROM b"""

PHRASES = r"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0b\x0c\r]') AS pieces FROM documents),
p AS (SELECT lang, unnest(pieces) AS piece FROM d), w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS ws FROM p),
g AS (SELECT lang, m, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: array_to_string(ws[i:i + m - 1], ' '))) AS phrase FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS m) WHERE len(ws) >= m),
f AS (SELECT lang, m, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100), n AS (SELECT lang, sum(len(ws))::HUGEINT AS n FROM w GROUP BY 1),
s AS (SELECT lang, a, string_split(phrase, ' ') AS ws, m AS size, unnest(range(2, m)) AS m FROM f WHERE m >= 3),
h AS (SELECT lang, unnest(list_transform(range(1, size - m + 2), lambda i: array_to_string(ws[i:i + m - 1], ' '))) AS phrase, a FROM s), i AS (SELECT lang, phrase, max(a) AS held FROM h GROUP BY ALL),
k AS (SELECT f.lang, f.phrase, f.a, string_split(f.phrase, ' ') AS ws, unnest(range(1, f.m)) AS k FROM f LEFT JOIN i USING (lang, phrase) WHERE f.m >= 2 AND (i.held IS NULL OR 100 * i.held < 100 * f.a)),
c AS (SELECT k.lang, k.phrase, k.a, k.k, x.a AS l, y.a AS r, n.n, (1000::HUGEINT * k.a * n.n) // (x.a::HUGEINT * y.a) AS score FROM k JOIN n USING (lang)
JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(ws[1:k.k], ' ') JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(ws[k.k + 1:], ' ')),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS cut FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b WHERE cut = 1)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM r WHERE rank <= 2000"""


@query(sql=CHATS)
def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from admitflow.llm.chat import digest_chats, format_chats

    chats = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return digest_chats(format_chats(chats.unionByName(extra))).drop("n_tokens", "n_loss_tokens")


@query(sql=QUALITY)
def op5_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    from admitflow.llm.quality import quality

    return quality(read(spark, sf_dir, "documents"))


@query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from admitflow.llm.langid import identify

    return identify(read(spark, sf_dir, "documents"))


@query
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from admitflow.llm.simhash import near_duplicates

    return near_duplicates(read(spark, sf_dir, "documents"))


@query
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from admitflow.llm.decontam import find_leaks

    return find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query
def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from admitflow.llm.secret_scan import digest, scan

    return digest(scan(read(spark, sf_dir, "documents")))


@query
def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from admitflow.llm.mixing import mix

    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mix(docs).select("doc_id", "mix_source", "mix_lang", "mix_topic", "mix_tokens", "mix_probability", "mix_weight", "mix_sampled")


@query
def op10_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from admitflow.llm.html_extract import main_text

    return main_text(read(spark, sf_dir, "pages"))


@query(sql=REPEATS)
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from admitflow.llm.substring import remove_repeats

    return remove_repeats(read(spark, sf_dir, "documents"), with_text=False)


@query
def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from admitflow.llm.pii import pseudonymise

    return pseudonymise(read(spark, sf_dir, "documents"), key="the key of this corpus")


@query
def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from admitflow.llm.whitening import whiten

    return whiten(read(spark, sf_dir, "embeddings"), keep=["vec_id"])


@query(sql=PHRASES)
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from admitflow.llm.collocations import collocations

    return collocations(read(spark, sf_dir, "documents"))


@query
def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from admitflow.llm.licenses import scan_licenses

    return scan_licenses(read(spark, sf_dir, "documents"))
