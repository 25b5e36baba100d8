"""Quality rules: counts of words, symbols and repetition, then divergence from language references.

A document's histogram of character classes and of common words is held
against its language's, by Jensen-Shannon distance; texts too short for a
histogram are not judged by it. References are sums over all documents of a
language that pass the base rules. Everything is DataFrame functions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftloom.llm.common import GAP, cut

# Common words of four languages, of which histograms are made.
COMMON_WORDS = (
    "the of and to in is that it was for on are as with be at by this from or an not "
    "de la que et les des le en un une du pour dans qui est par sur pas au plus "
    "der die das und ist von mit den zu nicht ein eine auf dem im für sich als auch "
    "el los las y por con una del se no para su lo es"
).split()
SYMBOLS = "[#*$%&|<>]"
#: Classes counted by pattern; white space, symbols and the rest complete the histogram.
CLASSES = {"upper": r"\p{Lu}", "digit": r"[0-9]", "point": r"[.,;:?'\"()\-]", "bang": "!"}
#: Greatest distances that a kept document has, and the least lengths at which they are judged.
CHAR_DISTANCE, CHAR_WORDS = 0.28, 50
WORD_DISTANCE, WORD_WORDS = 0.32, 100
#: The references of languages with at least this share of the words, 1000 at most, are broadcast; the others are joined by shuffle.
REFERENCE_SHARE = 0.001
#: Repeated windows up to which positions are looked up in their list; above, windows are sorted with positions.
FEW = 64


def repeated_words(words: str) -> Column:
    """How many words lie in a three-word window that the array holds twice or more.

    Windows are compared by 64-bit hashes. Needs the columns that
    :func:`with_windows` adds.
    """
    spread = F.expr(f"size(array_distinct(flatten(transform(filter(transform({words}_h, (x, i) -> if(array_contains({words}_d, x), i, -1)), p -> p >= 0), p -> array(p, p + 1, p + 2)))))")
    sorted_pairs = f"sort_array(transform({words}_h, (x, i) -> struct(x, i)))"
    ends = f"transform(array({sorted_pairs}), s -> filter(s, (y, k) -> (k > 0 and s[greatest(k - 1, 0)].x = y.x) or (k < size(s) - 1 and s[least(k + 1, size(s) - 1)].x = y.x)))[0]"
    many = F.expr(f"size(array_distinct(flatten(transform({ends}, y -> array(y.i, y.i + 1, y.i + 2)))))")
    return F.when(F.size(f"{words}_d") == 0, 0).when(F.size(f"{words}_d") <= FEW, spread).otherwise(many)


def with_windows(df: DataFrame, words: str) -> DataFrame:
    """Adds the hashes of all three-word windows and those that occur more than once."""
    df = df.withColumn(f"{words}_h", F.expr(f"if(size({words}) < 3, array(), transform(slice({words}, 1, size({words}) - 2), (x, i) -> xxhash64(x, {words}[i + 1], {words}[i + 2])))"))
    df = df.withColumn(f"{words}_s", F.expr(f"if(size(array_distinct({words}_h)) = size({words}_h), array(), sort_array({words}_h))"))
    return df.withColumn(f"{words}_d", F.expr(f"array_distinct(filter({words}_s, (x, i) -> i > 0 and {words}_s[greatest(i - 1, 0)] = x))")).drop(f"{words}_s")


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """The base counts and histograms of each row: doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, classes, common, common_counts.

    A null text counts as an empty one: all counts are 0.
    """
    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), lang.alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", GAP), ""))
    listed = ", ".join(f"'{w}'" for w in COMMON_WORDS)
    without = lambda pattern: F.length("text") - F.length(F.regexp_replace("text", pattern, ""))
    rows = rows.withColumns(
        {
            "chars": F.length("text").cast("long"),
            "word_chars": F.length(F.array_join("words", "")).cast("long"),
            "n_symbols": without(SYMBOLS).cast("long"),
            "lines": F.expr(r"if(instr(text, '\n') = 0, array(), filter(split(text, '\n'), x -> x rlike '[^\\x20\\x09-\\x0D]'))"),
            "hits": F.expr(f"filter(words, x -> x in ({listed}))"),
        }
        | {k: without(p).cast("long") for k, p in CLASSES.items()}
    )
    rows = with_windows(rows, "words").withColumns({"n_words": F.size("words").cast("long"), "found": F.array_distinct("hits")})
    gap = F.col("chars") - F.col("word_chars")
    rest = F.col("chars") - gap - F.col("n_symbols") - reduce(lambda a, b: a + b, (F.col(k) for k in CLASSES))
    vocabulary = F.array(*(F.lit(w) for w in COMMON_WORDS))
    return rows.select(
        "doc_id",
        "lang",
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words("words").cast("long").alias("n_repeat_words"),
        F.array(gap, F.col("n_symbols"), *(F.col(k) for k in CLASSES), rest).alias("classes"),
        F.transform("found", lambda w: F.array_position(vocabulary, w).cast("int")).alias("common"),
        F.expr("transform(found, w -> size(hits) - size(array_remove(hits, w)))").alias("common_counts"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words"))


def references(measured: DataFrame) -> DataFrame:
    """The reference of each language: lang, large, class_shares, word_shares.

    Sums of the measured documents that pass the base rules; one row a language.
    At most 1 / REFERENCE_SHARE of them are ``large``.
    """
    n_classes = len(CLASSES) + 3
    kept = measured.where(~base_failed()).withColumn("lang", F.coalesce("lang", F.lit("")))
    sums = kept.groupBy("lang").agg(F.sum("n_words").alias("words"), *(F.sum(F.col("classes")[i]).alias(f"c{i}") for i in range(n_classes)))
    hits = kept.select("lang", F.inline(F.arrays_zip("common", "common_counts"))).groupBy("lang", F.col("common").alias("at")).agg(F.sum("common_counts").alias("n"))
    hits = hits.groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("at", "n"))).alias("hits"))  # len(COMMON_WORDS) entries at most
    by_lang = cut(sums.join(hits, "lang", "left"), "references")
    total = by_lang.agg(F.sum("words").alias("total"))
    every = by_lang.crossJoin(F.broadcast(total)).select(  # one row
        "lang", "words", (F.col("words") >= F.lit(REFERENCE_SHARE) * F.col("total")).alias("large"), F.array(*(f"c{i}" for i in range(n_classes))).alias("classes"),
        F.array(*(F.coalesce(F.col("hits")[i + 1], F.lit(0)) for i in range(len(COMMON_WORDS)))).alias("hits"),
    )
    chars = F.expr("aggregate(classes, 0L, (a, x) -> a + x)")
    return every.select("lang", "large", F.transform("classes", lambda x: x / chars).alias("class_shares"), F.transform("hits", lambda x: x / F.col("words")).alias("word_shares"))


def divergence(shares: str, reference: str) -> Column:
    """Jensen-Shannon divergence in bits of two arrays of shares, of which the first holds structs (p, q) where p > 0.

    What the reference has elsewhere adds its own share, since there the mean is half of it.
    """
    part = f"aggregate({shares}, 0D, (a, x) -> a + x.p * log2(2 * x.p / (x.p + x.q)) + if(x.q > 0, x.q * log2(2 * x.q / (x.p + x.q)), 0D) - x.q)"
    return F.expr(f"greatest(0D, ({part} + {reference}) / 2)")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """A row for each row of ``docs``: doc_id, the counts, base_failed, char_distance, word_distance, kept.

    ``base_failed``: fewer than 50 words, or more than half of the words in
    repeated three-word windows. ``kept`` is false then, else unless a distance
    exceeds its bound in a text long enough for it; distances are null where
    they are not judged. Each language is held against its own reference, however
    little of the input it is; rows without one share theirs. Null texts count as
    empty and fail.
    """
    measured = cut(measures(docs, id_col, text_col, lang_col), "measures")
    shares = cut(references(measured), "references")
    own = shares.select(F.col("lang").alias("of"), "large", F.col("class_shares").alias("ref_classes"), F.col("word_shares").alias("ref_words"))
    large = F.broadcast(own.where("large"))
    rows = measured.withColumns({"of": F.coalesce("lang", F.lit("")), "base_failed": base_failed()})
    good, failed = rows.where("not base_failed"), rows.where("base_failed")  # what failed is not held against a reference
    rare = good.join(large.select("of"), "of", "left_anti").join(own.where("not large").hint("merge"), "of")
    rows = good.join(large, "of").unionByName(rare).unionByName(failed, allowMissingColumns=True)
    rows = rows.withColumns(
        {
            "chars": F.expr("aggregate(classes, 0L, (a, x) -> a + x)"),
            "found": F.expr("aggregate(common_counts, 0L, (a, x) -> a + x)"),
        }
    )
    rows = rows.withColumns(
        {
            "class_pairs": F.expr("filter(transform(classes, (x, i) -> struct(x / chars AS p, ref_classes[i] AS q)), x -> x.p > 0)"),
            "word_pairs": F.expr(
                "filter(concat(transform(common, (x, i) -> struct(common_counts[i] / n_words AS p, ref_words[x - 1] AS q)),"
                " array(struct((n_words - found) / n_words AS p, 1D - aggregate(ref_words, 0D, (a, x) -> a + x) AS q))), x -> x.p > 0)"
            ),
        }
    )
    char_distance = F.when(~F.col("base_failed") & (F.col("n_words") >= CHAR_WORDS), F.sqrt(divergence("class_pairs", "1D")))
    word_distance = F.when(~F.col("base_failed") & (F.col("n_words") >= WORD_WORDS), F.sqrt(divergence("word_pairs", "1D")))
    rows = rows.withColumns({"char_distance": char_distance, "word_distance": word_distance})
    far = F.coalesce(F.col("char_distance") > CHAR_DISTANCE, F.lit(False)) | F.coalesce(F.col("word_distance") > WORD_DISTANCE, F.lit(False))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", (~F.col("base_failed") & ~far).alias("kept"))
