"""Full-text search by stems: texts and queries are cut into words, stop words go, endings are cut off by the language's rules, and results rank by how near the words lie.

Everything is Column expressions and joins. A text is analysed in its own
language; a query in each of them, and it meets a text by the analysis of the
text's language.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftloom.operators.search import sized, top

# Frequent words that say nothing by themselves, and endings that are cut off where three letters or more stay.
STOP = {
    "en": "a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their they this to was we were which will with you".split(),
    "fr": "au aux avec ce ces dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas pour qu que qui sa se ses son sur un une vous".split(),
    "de": "als am an auch auf aus bei das dem den der des die ein eine einem einen einer er es für hat ich im in ist mit nicht sich sie sind und von war wie zu zum".split(),
    "es": "a al como con de del el ella en es la las le lo los más me mi no nos o para pero por que se ser si sin su sus un una y ya".split(),
}
ENDINGS = {
    "en": "ations ation ingly edly ings ing ness ment ies ied ed es ly e s",
    "fr": "issements issement ements ement ations ation euses euse eurs eur ités ité ées ée és er ez ent ant ais ait es é e s",
    "de": "ungen ung heiten heit keiten keit lichen liche lich ern em en er es st e s n",
    "es": "aciones ación amientos amiento mente adores ador iendo ando ados adas ado ada idos idas ido ida ar er ir os as es o a s",
}
#: One word, read alike in Java and RE2.
WORD = r"[\p{L}\p{N}]+"


def ending(lang: str) -> str:
    """The pattern of a word with one of a language's endings: its first group is the stem, which is as short as the longest ending makes it."""
    return f"^(.{{3,}}?)(?:{'|'.join(ENDINGS[lang].split())})$"


def stem(word: Column, lang: Column) -> Column:
    """The word without the longest ending of its language; words of other languages stay as they are."""
    found = word
    for name in ENDINGS:
        found = F.when(lang == name, F.regexp_replace(word, ending(name), "$1")).otherwise(found)
    return found


def is_stop(word: Column, lang: Column) -> Column:
    tests = [(lang == name) & word.isin(words) for name, words in STOP.items()]
    found = tests[0]
    for test in tests[1:]:
        found = found | test
    return F.coalesce(found, F.lit(False))


def analysed(rows: DataFrame, text: str, lang: str) -> DataFrame:
    """The rows, one for each word that is no stop word, with ``stem`` and ``at`` (the word's place, stop words counted); null texts have none."""
    cut = rows.withColumn("_words", F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(f"({WORD})"), 1))
    each = cut.select(*rows.columns, F.posexplode("_words").alias("at", "_word")).where(~is_stop(F.col("_word"), F.col(lang)))
    return each.withColumn("stem", stem(F.col("_word"), F.col(lang))).drop("_word")


def stemmed_topk(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Chunks (chunk_id, document_id, content, lang) that hold all stems of a query (query_id, query): query_id, chunk_id, document_id, score, pos.

    The score is the share of the query's stems among the words from the first
    of their first places to the last: 1 where they stand side by side. A query
    of stop words alone finds nothing, nor do null queries. Only words with an asked
    stem are shuffled.
    """
    langs = chunks.select("lang").distinct()
    asked = queries.select("query_id", "query").join(sized(langs))  # a query in each language of the texts
    asked = analysed(asked, "query", "lang").select("query_id", "lang", "stem").distinct()
    asked = asked.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("query_id", "lang")))
    words = analysed(chunks.select("chunk_id", "document_id", "content", "lang"), "content", "lang").drop("content")
    same = F.col("w.lang").eqNullSafe(F.col("a.lang")) & (F.col("w.stem") == F.col("a.stem"))
    hits = words.alias("w").join(sized(asked.select("lang", "stem").distinct()).alias("a"), same, "left_semi")
    first = hits.groupBy("chunk_id", "document_id", "lang", "stem").agg(F.min("at").alias("at"))
    met = first.alias("w").join(sized(asked).alias("a"), same).select("query_id", "chunk_id", "document_id", "n", "at")
    span = F.max("at") - F.min("at") + 1
    whole = met.groupBy("query_id", "chunk_id", "document_id", "n").agg(F.count(F.lit(1)).alias("found"), span.alias("span")).where("found = n")
    return top(whole.withColumn("score", F.col("n") / F.greatest("span", "n")), k).select("query_id", "chunk_id", "document_id", "score", "pos")


def sql(k: int) -> str:
    """The same over documents and the first five words of benchmark passages."""
    stems = " ".join(f"WHEN '{x}' THEN regexp_replace(word, '{ending(x)}', '\\1')" for x in ENDINGS)
    stops = " OR ".join("(lang = '{}' AND word IN ({}))".format(x, ", ".join(f"'{w}'" for w in words)) for x, words in STOP.items())
    return f"""
WITH d AS (SELECT doc_id AS chunk_id, source AS document_id, lang, regexp_extract_all(lower(coalesce(text, '')), '{WORD}') AS w FROM documents),
x AS (SELECT chunk_id, document_id, lang, unnest(w) AS word, unnest(range(len(w))) AS place FROM d),
s AS (SELECT chunk_id, document_id, lang, CASE lang {stems} ELSE word END AS stem, min(place) AS place FROM x WHERE NOT coalesce({stops}, false) GROUP BY 1, 2, 3, 4),
q0 AS (SELECT item_id AS query_id, lang, unnest(regexp_extract_all(lower(array_to_string(string_split(text, ' ')[1:5], ' ')), '{WORD}')) AS word FROM benchmark, (SELECT DISTINCT lang FROM documents)),
q AS (SELECT DISTINCT query_id, lang, CASE lang {stems} ELSE word END AS stem FROM q0 WHERE NOT coalesce({stops}, false)),
n AS (SELECT query_id, lang, count(*) AS n FROM q GROUP BY 1, 2),
m AS (SELECT q.query_id, s.chunk_id, s.document_id, n, max(place) - min(place) + 1 AS span FROM s JOIN q ON s.lang IS NOT DISTINCT FROM q.lang AND s.stem = q.stem JOIN n ON n.query_id = q.query_id AND n.lang IS NOT DISTINCT FROM q.lang GROUP BY 1, 2, 3, 4 HAVING count(*) = n),
r AS (SELECT query_id, chunk_id, document_id, round(n::DOUBLE / greatest(span, n), 4) AS score FROM m)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS pos FROM r QUALIFY pos <= {k}"""
