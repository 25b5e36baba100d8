"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftloom.llm import bpe, collocations, language_id, media, mixing, ngram_join, pieces, quality_classifier, quality_rules, secret_scan, time_partitions, token_counts, url_filter
from siftloom.llm.common import shared_dir, table

#: Files of public tokenizers, by name; never copied.
BPE_FILE = "byte_bpe_50k.json"
PIECE_FILE = "piece_bpe_32k.model"

#: Context limits and shares that op2 answers beside the lengths themselves.
LIMITS = (128, 256, 512, 1024, 2048, 4096, 8192, 16_384, 32_768, 65_536, 131_072)
SHARES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 1.0)

# Fixed values of op10: the rules, and a list of canonical hosts.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
LISTED_NAMES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
LISTED_ENDS = ("example.com", "example.net", "example.org")


def tokenizer_path(name: str = BPE_FILE) -> str:
    """Where a public tokenizer's file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its score; null and empty texts are scored by their empty statistics, rows that repeat an id each by its own text."""
    return quality_classifier.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of all documents, with limits and quantiles; null and empty texts have length 0."""
    lengths = token_counts.encoded_lengths(table(spark, sf_dir, "documents"), tokenizer_path())
    return token_counts.token_report(token_counts.length_histogram(lengths), LIMITS, SHARES)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its counts and verdict; null and empty texts have counts of 0 and fail."""
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    return judged.withColumns({c: F.round(c, 6) for c in ("char_distance", "word_distance")})


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its language; null texts and those without a letter are und with score 0."""
    return language_id.identify(table(spark, sf_dir, "documents"), tokenizer_path(PIECE_FILE))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its findings; null and empty texts have none, and a null text a null digest. The source counts as the path."""
    found = secret_scan.scan(table(spark, sf_dir, "documents"), path_col="source")
    return found.select("doc_id", "n_candidates", "n_secrets", "findings", F.sha2("redacted", 256).alias("redacted_sha256"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix takes of it; null and empty texts have size 0."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "repeats")


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class, component and number of links; null texts and those without words are alone. Rows that repeat an id are one document."""
    return ngram_join.jaccard_classes(table(spark, sf_dir, "documents"), n=4, percent=85).select("doc_id", "n_shingles", "component_id", "class_id", "n_links")


def op7_ngram_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class and number of links, as op7_ngram_join has them."""
    return ngram_join.jaccard_links(table(spark, sf_dir, "documents"), n=4, percent=85)


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as its stored form is read back; null and empty texts are one row of zeros."""
    return media.text_media(table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its token digests; null and empty texts have no tokens."""
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with its verdict; a null URL, or one without ://, has empty parts and is allowed."""
    listed = spark.range(1).selectExpr("explode(array(%s)) AS key" % ", ".join(f"'{n}.{e}/'" for n in LISTED_NAMES for e in LISTED_ENDS))
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), listed, RULES).select("page_id", "host", "path", "rule", "verdict")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of each language; null texts count as empty, a null language as und."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


def click_moment(schema_type: str) -> Column:
    """op12's moment of a click: ts, for some ids moved back by days or floored to Monday; null ts gives null."""
    k = F.crc32(F.col("click_id").cast("string").cast("binary")) % 128
    back = F.expr("ts - make_dt_interval(cast(pow(crc32(cast(cast(click_id as string) as binary)) % 128 + 6, 3) as int))")
    monday = F.trunc(F.col("ts").cast("date"), "week").cast(schema_type)
    return F.when(k < 16, back).when(k > 111, monday).otherwise(F.col("ts"))


def op12_time_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of clicks after they were written up to April and rewritten for all; null ts are the leaf null, null ids digest as nothing. Each call has a folder of its own, which stays."""
    clicks = table(spark, sf_dir, "clicks")
    limit = 1 + clicks.count() // 800
    moment, order = click_moment(clicks.schema["ts"].dataType.simpleString()), ("arrived_at", "click_id")
    early = F.coalesce(F.col("arrived_at") < F.lit("2024-04-01 00:00:00").cast(clicks.schema["arrived_at"].dataType), F.lit(False))
    folder = f"{shared_dir(spark)}/op12-{uuid.uuid4().hex}"
    old = time_partitions.write_layout(clicks.where(early), folder, limit, moment, order)
    return time_partitions.rewrite_layout(clicks, folder, limit, moment, order, old, ~early, "click_id")


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its token digests; null and empty texts have no tokens."""
    return pieces.digests(table(spark, sf_dir, "documents"), tokenizer_path(PIECE_FILE))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_token_counts": op2_token_counts,
    "op3_quality_rules": op3_quality_rules,
    "op4_language_id": op4_language_id,
    "op5_secret_scan": op5_secret_scan,
    "op6_mixing": op6_mixing,
    "op7_ngram_join": op7_ngram_join,
    "op7_ngram_links": op7_ngram_links,
    "op8_media": op8_media,
    "op9_bpe": op9_bpe,
    "op10_url_filter": op10_url_filter,
    "op11_collocations": op11_collocations,
    "op12_time_partitions": op12_time_partitions,
    "op13_sentencepiece": op13_sentencepiece,
}

OP3_SQL = r"""
WITH w AS (
  SELECT doc_id, COALESCE(lang, '') AS lang, COALESCE(text, '') AS text, regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
c AS (
  SELECT doc_id, lang, w, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(text)::BIGINT AS chars,
         (length(text) - length(regexp_replace(text, '[#*$%%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         length(text) - length(regexp_replace(text, '\p{Lu}', '', 'g')) AS upper, length(text) - length(regexp_replace(text, '[0-9]', '', 'g')) AS digit,
         length(text) - length(regexp_replace(text, '[.,;:?\x27"()\-]', '', 'g')) AS point, length(text) - length(regexp_replace(text, '!', '', 'g')) AS bang,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM w),
windows AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g, unnest(range(1, len(w) - 1)) AS i FROM c),
repeats AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM repeats) GROUP BY 1),
base AS (
  SELECT c.*, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, COALESCE(n, 0) AS n_repeat_words,
         n_words < 50 OR 100 * COALESCE(n, 0) > 50 * n_words AS base_failed,
         [chars - word_chars, n_symbols, upper, digit, point, bang, word_chars - n_symbols - upper - digit - point - bang] AS classes
  FROM c LEFT JOIN covered USING (doc_id)),
hits AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(w) AS word FROM c) WHERE word IN (%s) GROUP BY 1, 2),
good AS (SELECT doc_id, n_words, classes, lang FROM base WHERE NOT base_failed),
known AS (SELECT lang, sum(n_words) AS words FROM good GROUP BY 1),
class_sums AS (SELECT lang, i, sum(x) AS n FROM (SELECT lang, unnest(range(7)) AS i, unnest(classes) AS x FROM good) GROUP BY 1, 2),
class_refs AS (SELECT lang, i, n::DOUBLE / sum(n) OVER (PARTITION BY lang) AS q FROM class_sums JOIN known USING (lang)),
word_refs AS (SELECT lang, word, sum(n)::DOUBLE / any_value(words) AS q FROM hits JOIN good USING (doc_id) JOIN known USING (lang) GROUP BY 1, 2),
other_refs AS (SELECT lang, 1 - COALESCE(sum(q), 0) AS q FROM known LEFT JOIN word_refs USING (lang) GROUP BY 1),
own AS (SELECT doc_id, lang FROM base),
char_pairs AS (
  SELECT doc_id, x::DOUBLE / chars AS p, q
  FROM (SELECT doc_id, chars, unnest(range(7)) AS i, unnest(classes) AS x FROM base) JOIN own USING (doc_id) JOIN class_refs USING (lang, i) WHERE x > 0),
word_pairs AS (
  SELECT doc_id, n::DOUBLE / n_words AS p, COALESCE(q, 0) AS q FROM hits JOIN base USING (doc_id) JOIN own USING (doc_id) LEFT JOIN word_refs r ON r.lang = own.lang AND r.word = hits.word
  UNION ALL
  SELECT doc_id, (n_words - found)::DOUBLE / n_words, q FROM (SELECT doc_id, n_words, COALESCE((SELECT sum(n) FROM hits h WHERE h.doc_id = b.doc_id), 0) AS found FROM base b) JOIN own USING (doc_id) JOIN other_refs USING (lang)
  WHERE n_words > found),
char_js AS (SELECT doc_id, sqrt(greatest(0, (1 + sum(p * log2(2 * p / (p + q)) + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END - q)) / 2)) AS d FROM char_pairs GROUP BY 1),
word_js AS (SELECT doc_id, sqrt(greatest(0, (1 + sum(p * log2(2 * p / (p + q)) + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END - q)) / 2)) AS d FROM word_pairs GROUP BY 1),
judged AS (
  SELECT base.*, CASE WHEN NOT base_failed AND n_words >= %d THEN char_js.d END AS cd, CASE WHEN NOT base_failed AND n_words >= %d THEN word_js.d END AS wd
  FROM base LEFT JOIN char_js USING (doc_id) LEFT JOIN word_js USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(cd, 6) AS char_distance, round(wd, 6) AS word_distance,
       NOT base_failed AND NOT COALESCE(cd > %s, false) AND NOT COALESCE(wd > %s, false) AS kept
FROM judged
""" % (
    ", ".join(f"'{w}'" for w in quality_rules.COMMON_WORDS),
    quality_rules.CHAR_WORDS,
    quality_rules.WORD_WORDS,
    quality_rules.CHAR_DISTANCE,
    quality_rules.WORD_DISTANCE,
)

OP6_SQL = r"""
WITH sized AS (
  SELECT doc_id, source,
         COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('17:' || COALESCE(doc_id::VARCHAR, '')), 1, 3))::INT AS bucket
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight
  FROM sized GROUP BY source),
filled AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap,
         sum(2.0::DOUBLE * source_size) OVER w AS caps, sum(weight) OVER w AS weights, row_number() OVER w AS nth
  FROM sources WINDOW w AS (ORDER BY source_size / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
totals AS (SELECT 1.5::DOUBLE * sum(source_size) AS budget, sum(weight) AS weight FROM sources),
levels AS (
  SELECT nth, cap / filled.weight AS least, (budget - caps + cap) / (totals.weight - weights + filled.weight) AS level
  FROM filled, totals),
water AS (SELECT arg_min(level, nth) AS level FROM levels WHERE level <= least),
targets AS (
  SELECT source, source_size, least(2.0::DOUBLE * source_size, weight * level) AS target FROM sources, water),
plans AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM targets),
buckets AS (
  SELECT source, bucket, sum(sum(size)) OVER (PARTITION BY source ORDER BY bucket ROWS UNBOUNDED PRECEDING) AS words
  FROM sized GROUP BY source, bucket),
cuts AS (
  SELECT p.source, p.source_size, p.target, p.whole,
         min({'off': abs(b.words - (p.target - p.whole * p.source_size)), 'bucket': b.bucket}) AS best
  FROM plans p JOIN buckets b ON p.source IS NOT DISTINCT FROM b.source
  GROUP BY ALL)
SELECT s.doc_id, s.size, c.source_size, c.target, r.repeats * s.size AS taken, s.source, r.repeats
FROM sized s JOIN cuts c ON s.source IS NOT DISTINCT FROM c.source,
LATERAL (SELECT (c.whole + CASE WHEN c.best.off < c.target - c.whole * c.source_size AND s.bucket <= c.best.bucket THEN 1 ELSE 0 END)::INT AS repeats) r
"""

OP7_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN []::VARCHAR[]
                      ELSE list_distinct([array_to_string(w[i:i + 3], ' ') FOR i IN range(1, greatest(len(w) - 3, 1) + 1)]) END AS s
  FROM words),
classes AS (SELECT list_sort(s) AS s, min(doc_id) AS class_id, len(any_value(s)) AS n FROM sets GROUP BY list_sort(s)),
grams AS (SELECT class_id, n, unnest(s) AS g FROM classes),
common AS (SELECT a.class_id AS a, b.class_id AS b, any_value(a.n) + any_value(b.n) AS n, count(*) AS inter
           FROM grams a JOIN grams b ON a.g = b.g AND a.class_id < b.class_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common WHERE 100 * inter >= 85 * (n - inter)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT class_id, class_id FROM classes UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
least AS (SELECT a AS class_id, min(b) AS component_id FROM reach GROUP BY 1),
members AS (SELECT c.class_id, count(DISTINCT doc_id) AS n FROM sets JOIN classes c ON list_sort(sets.s) = c.s GROUP BY 1),
others AS (SELECT a AS class_id, sum(m.n) AS n FROM edges JOIN members m ON m.class_id = b GROUP BY 1)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles,
       CASE WHEN len(s.s) = 0 THEN s.doc_id ELSE l.component_id END AS component_id,
       CASE WHEN len(s.s) = 0 THEN s.doc_id ELSE c.class_id END AS class_id,
       CASE WHEN len(s.s) = 0 THEN 0 ELSE m.n - 1 + COALESCE(o.n, 0) END::BIGINT AS n_links
FROM sets s JOIN classes c ON list_sort(s.s) = c.s JOIN least l USING (class_id) JOIN members m USING (class_id) LEFT JOIN others o USING (class_id)
"""

OP7_LINKS_SQL = f"SELECT doc_id, class_id, n_links FROM ({OP7_SQL})"

OP10_SQL = r"""
WITH parts AS (
  SELECT page_id,
         translate(COALESCE(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         COALESCE(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path
  FROM pages),
rules(verdict, host, path) AS (VALUES %s),
fits AS (
  SELECT p.*, (SELECT max({'n': length(r.host || r.path), 'rule': r.host || r.path, 'verdict': r.verdict}) FROM rules r
               WHERE (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)) AS fit,
         regexp_replace(regexp_replace(p.host, '^.*@', ''), '(:[0-9]*)?\.?$', '') AS plain
  FROM parts p)
SELECT page_id, host, path, fit.rule AS rule,
       COALESCE(fit.verdict, CASE WHEN %s THEN 'block' ELSE 'allow' END) AS verdict
FROM fits
""" % (
    ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES),
    " OR ".join(f"plain = '{n}.{e}' OR ends_with(plain, '.{n}.{e}')" for n in LISTED_NAMES for e in LISTED_ENDS),
)

OP11_SQL = r"""
WITH pieces AS (
  SELECT row_number() OVER () AS piece, lang, regexp_extract_all(p, '[^\x20\x09]+') AS w
  FROM (SELECT COALESCE(lang, 'und') AS lang,
               unnest(regexp_split_to_array(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
        FROM documents)),
grams AS (
  SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS phrase
  FROM pieces, (VALUES (1), (2), (3), (4)) sizes(size)),
f AS (SELECT lang, size, phrase, count(*)::BIGINT AS a FROM grams GROUP BY 1, 2, 3 HAVING count(*) >= 30),
found AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE size > 1),
cuts AS (
  SELECT c.lang, c.phrase, c.a, k, l.a AS l, r.a AS r, (2000000::HUGEINT * c.a) // (l.a::HUGEINT + r.a) AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM found) c
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:k], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[k + 1:], ' ')),
worst AS (SELECT lang, phrase, a, l, r, score FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_ AS (
  SELECT lang, a AS longer, unnest(list_distinct(flatten(list_transform(range(2, size), lambda n: list_transform(range(1, size - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' ')))))) AS phrase
  FROM found WHERE size > 2),
held AS (SELECT DISTINCT i.lang, i.phrase FROM inner_ i JOIN found USING (lang, phrase) WHERE 100::HUGEINT * longer >= 80::HUGEINT * a),
words AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM worst ANTI JOIN held USING (lang, phrase) JOIN words USING (lang)
QUALIFY rank <= 2000
"""

SQL: dict[str, str] = {"op11_collocations": OP11_SQL, "op3_quality_rules": OP3_SQL, "op6_mixing": OP6_SQL, "op7_ngram_join": OP7_SQL, "op7_ngram_links": OP7_LINKS_SQL, "op10_url_filter": OP10_SQL}
