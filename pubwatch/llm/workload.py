"""The registered query of every operator, with production parameters, and its SQL where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pubwatch.llm import ann, decontamination, hard_negatives, jaccard, kneser_ney, language, licences, lines, mixing, phrases, quality, url_rules, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _licence_sql() -> str:
    quoted = licences.SENTENCE_END.replace("'", "''")
    step = "q.sequence"
    for licence, names in licences.RULES:
        step = f"replace({step}, '{''.join(f'<{n}>' for n in names)}', '[{licence}]')"
    name = licences.identifier("s", "regexp_matches({0}, '{1}')")
    return f"""
    WITH cut AS (
      SELECT doc_id, list_transform(string_split(regexp_replace(coalesce(text, ''), '{quoted}', chr(1), 'g'), chr(1)),
        lambda s: trim(regexp_replace(translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g'))) AS sentences
      FROM documents),
    q AS (
      SELECT doc_id, coalesce(array_to_string(list_transform(
        list_filter(sentences, lambda s: regexp_matches(s, '{licences.LICENCE_WORDS}|(^| )cc( by|0)')), lambda s: '<' || {name} || '>'), ''), '') AS sequence
      FROM cut),
    r AS (SELECT doc_id, sequence, {step} AS ruled FROM q)
    SELECT doc_id, sequence AS licence_sequence,
      coalesce(array_to_string(list_sort(list_distinct(regexp_extract_all(ruled, '\\[([^\\]]+)\\]', 1))), ','), '') AS licences,
      CAST(length(sequence) - length(replace(sequence, '<', '')) AS INTEGER) AS n_licence_sentences,
      CAST(length(ruled) - length(replace(ruled, '<', '')) AS INTEGER) AS n_unmatched
    FROM r"""


@query("op1_license_scans", _licence_sql())
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return licences.scan_licences(table(spark, folder, "documents").select("doc_id", "text")).drop("text")


@query("op2_warc", f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
k AS (SELECT *, CASE WHEN payload_bytes >= {warc.REVISIT_BYTES} THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS keeper FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN keeper = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN keeper <> page_id THEN keeper END AS refers_to FROM k""")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    read = warc.read_archives(warc.write_archives(table(spark, folder, "pages")), payloads=False)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op3_benchmark_decontamination")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.find_overlaps(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


_LINE_SQL = f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
each AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS n FROM split),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM each),
common AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= {lines.MIN_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {lines.MIN_DOCUMENTS}),
marked AS (SELECT k.doc_id, k.n, k.line, c.key IS NOT NULL AND c.keeper <> k.doc_id AS gone FROM keyed k LEFT JOIN common c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""


@query("op4_line_dedup", _LINE_SQL)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return lines.dedup_lines(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


#: Target weights of the mixture; a source not named has weight 1.
MIX_WEIGHTS = {"src0": 2.0, "src1": 4.0, "src2": 0.5, "src3": 0.0}
MIX_SEED = 17

_MIX_SQL = f"""
WITH totals AS (
  SELECT source, sum(coalesce(length(text), 0)) AS chars FROM documents GROUP BY source),
weighted AS (
  SELECT source, chars, CASE WHEN chars > 0 THEN CASE source {' '.join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in MIX_WEIGHTS.items())} ELSE 1.0::DOUBLE END ELSE 0.0 END AS weight FROM totals),
rates AS (
  SELECT source, CASE WHEN weight > 0 THEN (SELECT sum(chars) FROM weighted) * weight / (SELECT sum(weight) FROM weighted) / chars ELSE 0.0 END AS rate FROM weighted),
parted AS (SELECT source, rate, greatest(1, ceil(rate / {mixing.PART_MEAN}))::INTEGER AS parts FROM rates),
pmf AS (
  SELECT source, parts, n, CASE WHEN rate = 0 THEN CASE n WHEN 0 THEN 1.0 ELSE 0.0 END ELSE exp(-rate / parts + n * ln(rate / parts) - lgamma(n + 1)) END AS p
  FROM parted, range(0, {mixing.PART_COUNTS + 1}) t(n)),
cdf AS (SELECT source, parts, n, sum(p) OVER (PARTITION BY source ORDER BY n) AS c FROM pmf),
steps AS (SELECT source, parts, list(c) AS cs FROM cdf GROUP BY source, parts),
counted AS (
  SELECT d.*, list_sum(list_transform(range(1, s.parts + 1), lambda i: len(list_filter(s.cs, lambda c:
      c < (('0x' || substr(md5(concat('{MIX_SEED}:', coalesce(d.doc_id::VARCHAR, '-'), ':', i)), 1, 13))::BIGINT + 0.5) / pow(2, 52)))))::INTEGER AS n_copies
  FROM documents d JOIN steps s ON d.source IS NOT DISTINCT FROM s.source),
copies AS (SELECT *, unnest(range(1, n_copies + 1))::INTEGER AS copy FROM counted)
SELECT doc_id, text, lang, source, n_chars, n_copies, copy,
  ('0x' || substr(md5(concat('{MIX_SEED}:order:', coalesce(doc_id::VARCHAR, '-'), ':', copy)), 1, 13))::BIGINT AS order_key
FROM copies"""


@query("op5_mixing_sources", _MIX_SQL)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_sources(table(spark, folder, "documents"), MIX_WEIGHTS, seed=MIX_SEED)


@query("op6_jaccard_join")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))


@query("op7_language_id")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    return language.identify_documents(docs).select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


@query("op8_nearest_neighbours")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    index = ann.build_index(table(spark, folder, "embeddings"))
    return ann.nearest(index, index.where("vec_id % 50 = 0"))


@query("op9_lm_scoring")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = kneser_ney.train(docs.where(~kneser_ney.held_out()))
    return kneser_ney.score(docs, model).withColumn("held_out", kneser_ney.held_out()).drop("text")


_RULE_ROWS = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in url_rules.RULES)


@query("op10_url_filters", f"""
WITH rules(rule_host, rule_path, rule_verdict) AS (VALUES {_RULE_ROWS}),
parsed AS (
  SELECT page_id, url,
    CASE WHEN contains(url, '://') THEN translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
hits AS (
  SELECT page_id, url, host, path, rule_host || rule_path AS rule, rule_verdict,
    row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC) AS n
  FROM parsed JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT p.page_id, p.url, p.host, p.path, h.rule, coalesce(h.rule_verdict, 'allow') AS verdict
FROM parsed p LEFT JOIN (SELECT * FROM hits WHERE n = 1) h ON p.page_id = h.page_id""")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(list(url_rules.RULES), url_rules.RULE_SCHEMA)
    return url_rules.judge_urls(table(spark, folder, "pages").select("page_id", "url"), rules)


def _quality_sql() -> str:
    rejects = " ".join(
        f"WHEN {' OR '.join('(' + test.format(c=cutoffs[level]) + ')' for test, cutoffs in quality.RULES.values())} THEN {level}" for level in range(quality.LEVELS))
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '{quality.UNKNOWN}') AS stratum, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
places AS (SELECT r, w, unnest(range(1, len(w) - {quality.WINDOW - 2})) AS i FROM d WHERE len(w) > {quality.WINDOW}),
again AS (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM (SELECT r, i, md5(array_to_string(list_slice(w, i, i + {quality.WINDOW - 1}), ' ')) AS k FROM places)),
covered AS (
  SELECT r, CAST(sum(least({quality.WINDOW}, i - before)) AS BIGINT) AS n FROM (
    SELECT r, i, coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), i - {quality.WINDOW}) AS before FROM again WHERE c > 1) GROUP BY r),
s AS (
  SELECT d.r, doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
  FROM d LEFT JOIN covered c ON d.r = c.r),
j AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, CASE {rejects} END AS rejects FROM s),
good AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
h AS (
  SELECT stratum, level, count(*) AS n, count(*) FILTER (rejects <= level) AS k
  FROM j JOIN good USING (doc_id), range({quality.LEVELS}) t(level) WHERE NOT base_failed GROUP BY stratum, level),
p AS (
  SELECT stratum, level, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({quality.LIMIT}) + (n - i) * ln({1 - quality.LIMIT}))) AS tail
  FROM (SELECT *, unnest(range(k + 1)) AS i FROM h) GROUP BY stratum, level),
q AS (
  SELECT stratum, level, bool_and(tail <= {quality.RISK} / (SELECT count(DISTINCT stratum) FROM h)) OVER (PARTITION BY stratum ORDER BY level) AS holds FROM p),
z AS (SELECT stratum, CAST(max(level) AS INTEGER) AS cutoff_level FROM q WHERE holds GROUP BY stratum)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(rejects <= cutoff_level, false) AS kept, j.stratum, cutoff_level
FROM j LEFT JOIN z ON j.stratum = z.stratum"""


@query("op11_quality_rules", _quality_sql())
def op11(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality.judge_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return judged.select("doc_id", *(c for c in quality.STATISTICS if c != "n_lines"), "base_failed", "kept", "stratum", "cutoff_level")


#: Every anchor is a row whose id is divisible by this; ids divisible by 7 get the next label.
ANCHOR_STEP = 50


@query("op12_hard_negatives", f"""
WITH e AS (
  SELECT CAST(vec_id AS BIGINT) AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.id AS anchor_id, a.label = b.label AS same, b.id, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM e a JOIN e b ON a.id % {ANCHOR_STEP} = 0 AND a.id <> b.id AND len(a.v) = len(b.v)),
near AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS n FROM pairs WHERE same),
hits AS (
  SELECT p.anchor_id, p.id AS positive_id, q.id AS negative_id, p.score AS positive_score, q.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY q.score DESC, q.id) AS INTEGER) AS rank
  FROM near p JOIN pairs q ON p.anchor_id = q.anchor_id AND NOT q.same AND {hard_negatives.LOW} * p.score <= 100 * q.score AND 100 * q.score <= {hard_negatives.HIGH} * p.score
  WHERE p.n <= {hard_negatives.POSITIVES})
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM hits WHERE rank <= {hard_negatives.NEGATIVES}""")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    index, books = hard_negatives.build_index(table(spark, folder, "embeddings").withColumn("label", label))
    return hard_negatives.mine(index, books, index.where(F.col("vec_id") % ANCHOR_STEP == 0))


@query("op13_phrases", f"""
WITH pieces AS (
  SELECT coalesce(lang, '{phrases.UNKNOWN}') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM pieces),
grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(list_slice(ws, i, i + k - 1), ' '))) AS phrase
  FROM w, range(1, 4) t(k) WHERE len(ws) >= k),
f AS (SELECT lang, k, phrase, count(*) AS c FROM grams GROUP BY lang, k, phrase),
totals AS (SELECT lang, CAST(sum(c) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, phrase, c AS a, string_split(phrase, ' ') AS p FROM f WHERE k > 1 AND c >= {phrases.LEAST_COUNT}),
inside AS (
  SELECT lang, part AS phrase, max(a) AS longest FROM (
    SELECT lang, a, unnest([array_to_string(p[1:2], ' '), array_to_string(p[2:3], ' ')]) AS part FROM cand WHERE k = 3) GROUP BY lang, part),
cuts AS (
  SELECT c.*, j, array_to_string(p[1:j], ' ') AS first_part, array_to_string(p[j + 1:k], ' ') AS rest
  FROM cand c, range(1, 3) t(j) WHERE j < k),
scored AS (
  SELECT c.lang, c.phrase, c.a, j, x.c AS l, y.c AS r, (1000000::HUGEINT * c.a * c.a) // (x.c::HUGEINT * y.c) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.first_part JOIN f y ON y.lang = c.lang AND y.phrase = c.rest),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS b FROM scored),
ranked AS (
  SELECT s.lang, s.phrase, s.a, s.l, s.r, CAST(s.score AS BIGINT) AS score, row_number() OVER (PARTITION BY s.lang ORDER BY s.score DESC, s.a DESC, s.phrase) AS rank
  FROM best s LEFT JOIN inside i ON i.lang = s.lang AND i.phrase = s.phrase
  WHERE b = 1 AND NOT coalesce(100 * i.longest >= {phrases.ABSORBED} * s.a, false))
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= {phrases.TOP}""")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.mine_phrases(table(spark, folder, "documents"))
