"""Collocations: frequent phrases, mined at the rarest word of each, scored by how well their parts predict them.

Words are ordered from frequent to rare. Each occurrence of a word is sent, with
the neighbours that are no rarer, to the partition of that word, its pivot.
There all phrases that hold the pivot are counted: an occurrence of a phrase
reaches exactly one partition, that of the phrase's rarest word, so counts are
final where they are made. Rarer and infrequent neighbours are cut off before
anything is sent, and equal fragments are sent once with their number.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise, repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftloom.llm.common import byte_batches, cut

#: Words of a phrase at most.
WORDS = 4
#: Words whose order is broadcast at most, the most frequent ones, and their length in bytes. Rarer ones are ordered by a hash instead.
ORDERED, ORDERED_BYTES = 400_000, 64
#: A pivot's fragments go to one partition per so large a part of all words.
SHARE = 1024
#: Distinct words or fragments that a task counts before it hands them on.
HELD = 700_000

# What ends a piece, and what a word is.
TOKEN = re.compile(rb"[^\x20\x09.,;:!?\x0A-\x0D]+|[.,;:!?\x0A-\x0D]")
WORD = re.compile(rb"[^\x20\x09.,;:!?\x0A-\x0D]+")
SPACE = re.compile(rb" ")
BREAKS = [bytes([b]) for b in b".,;:!?\n\x0b\x0c\r"]
UNKNOWN_LANG = "und"


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    """The texts of each language in a batch as one, A-Z lower-cased; a piece ends between two of them."""
    found: dict[str, list[bytes]] = {}
    for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
        found.setdefault(lang, []).append(text)
    for lang, texts in found.items():
        yield lang, b"\n".join(texts).lower()


def _strings(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary()).cast(pa.string())


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word and its number n, for rows with text and lang that are not null; a task counts up to ``HELD`` words before it hands them on."""
    byte_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def flushed() -> Iterator[pa.RecordBatch]:
            for lang, counts in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), _strings(list(counts)), pa.array(list(counts.values()), pa.int64())], ["lang", "word", "n"])
            held.clear()

        for batch in batches:
            for lang, data in _texts(batch):
                held.setdefault(lang, Counter()).update(WORD.findall(data))
            if sum(map(len, held.values())) >= HELD:
                yield from flushed()
        yield from flushed()

    return docs.mapInArrow(run, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def ordered_words(counts: DataFrame, least: int, limit: int) -> tuple[dict[str, dict[bytes, int]], bool]:
    """The most frequent words of at least ``least`` occurrences by language, numbered from frequent to rare, and whether these are all.

    At most ``limit`` words of ``ORDERED_BYTES``, however large the corpus is.
    """
    frequent = counts.where(F.col("n") >= least)
    short = frequent.where(F.octet_length("word") <= ORDERED_BYTES)
    found = short.orderBy(F.desc("n"), "word", "lang").limit(limit).collect()
    order: dict[str, dict[bytes, int]] = {}
    for i, r in enumerate(found, 1):
        order.setdefault(r.lang, {})[r.word.encode()] = i
    return order, len(found) == frequent.count()


def reaches(tokens: list[bytes], order: dict[bytes, int], whole: bool, limit: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """How many neighbours to the left and to the right of each token go with it as their pivot.

    ``order`` numbers words from 1 on; breaks are below 0 there. A word that it
    lacks is infrequent if it is ``whole``; else it is rarer than all that it
    has and ordered by its hash. Neighbours on the left must be strictly before
    the pivot in the order, those on the right may equal it: of equal words in
    a phrase the first is the pivot.
    """
    key = np.fromiter(map(order.get, tokens, repeat(0)), dtype=np.int64, count=len(tokens))
    if not whole:
        for i in np.flatnonzero(key == 0).tolist():
            key[i] = limit + 1 + crc32(tokens[i])
    n = len(key)
    padded = np.concatenate([np.full(size, -1), key, np.full(size, -1)])
    left, right = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    goes = comes = key > 0
    for k in range(1, size):
        before, after = padded[size - k : size - k + n], padded[size + k : size + k + n]
        goes = goes & (before > 0) & (before < key)
        comes = comes & (after > 0) & (after <= key)
        left += goes
        right += comes
    return left, right


def fragments(docs: DataFrame, counts: DataFrame, least: int, size: int, limit: int, held_most: int = HELD) -> DataFrame:
    """The rewritten fragments with their number n: lang, route (the partition's key), split, fragment (a digit, the number of words before the pivot, then the words).

    ``split`` marks the pivots that hold so many words that their fragments go
    to several partitions, by their hash. A task merges equal fragments up to
    ``held_most`` of them.
    """
    spark = docs.sparkSession
    byte_batches(spark)
    order, whole = ordered_words(counts, least, limit)
    share = max(1, (counts.agg(F.sum("n")).first()[0] or 0) // SHARE)
    parts: dict[str, dict[bytes, int]] = {}
    for r in counts.where(F.col("n") > share).collect():  # at most SHARE words
        parts.setdefault(r.lang, {})[r.word.encode()] = -(-r.n // share)
    for known in order.values():
        known.update(dict.fromkeys(BREAKS, -1))
    shared = spark.sparkContext.broadcast((order, whole, parts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, whole, parts = shared.value
        none = dict.fromkeys(BREAKS, -1)
        held: dict[tuple[str, int], Counter] = {}

        def flushed() -> Iterator[pa.RecordBatch]:
            for (lang, skip), counts in held.items():
                found, prefix, sign = list(counts), lang.encode() + b"\0", b"%d " % skip
                pivots = [f.split(b" ", skip + 1)[skip] for f in found] if skip else [f.partition(b" ")[0] for f in found]
                route, several = [crc32(prefix + p) for p in pivots], list(map(parts.get(lang, {}).get, pivots))
                for i, k in enumerate(several):
                    if k is not None:
                        route[i] = crc32(b"%d" % (crc32(found[i]) % k), route[i])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(found), pa.string()),
                        pa.array(np.array(route, dtype=np.uint32).view(np.int32)),
                        pa.array([k is not None for k in several]),
                        _strings([sign + f for f in found]),
                        pa.array(list(counts.values()), pa.int64()),
                    ],
                    ["lang", "route", "split", "fragment", "n"],
                )
            held.clear()

        for batch in batches:
            for lang, data in _texts(batch):
                tokens = TOKEN.findall(data)
                left, right = reaches(tokens, order.get(lang, none), whole, limit, size)
                line = b" ".join(tokens)
                ends = np.cumsum(np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens)) + 1) - 1
                begins = np.concatenate([[0], ends[:-1] + 1])
                for skip in range(size):
                    at = np.flatnonzero((left == skip) & (left + right > 0))
                    if len(at):
                        cuts = zip(begins[at - skip].tolist(), ends[at + right[at]].tolist(), strict=True)
                        held.setdefault((lang, skip), Counter()).update([line[a:b] for a, b in cuts])
            if sum(map(len, held.values())) >= held_most:
                yield from flushed()
        yield from flushed()

    return docs.mapInArrow(run, "lang string, route int, split boolean, fragment string, n bigint")


def owned(fragment: bytes, skip: int, size: int) -> list[bytes]:
    """The phrases of 2 to ``size`` words in a fragment that hold the word after the first ``skip``."""
    ends = [*(m.start() for m in SPACE.finditer(fragment)), len(fragment)]
    found, begin = [], 0
    for i in range(skip + 1):
        found += [fragment[begin:e] for e in ends[max(i + 1, skip) : i + size]]
        begin = ends[i] + 1
    return found


def expanded(fragments: dict[bytes, int], least: int, size: int) -> dict[bytes, int]:
    """The phrases of a pivot's fragments with their numbers; those with a neighbour that is next to the pivot fewer than ``least`` times are left out.

    A phrase of two words or more holds the pivot and a word beside it, and is
    no more frequent than these two.
    """
    counts: dict[bytes, int] = {}
    split = [(f[0] - 48, f[2:].split(b" "), n) for f, n in fragments.items()]
    if least > 1:
        before: dict[bytes, int] = {}
        after: dict[bytes, int] = {}
        for skip, words, n in split:
            if skip:
                w = words[skip - 1]
                before[w] = before.get(w, 0) + n
            if skip + 1 < len(words):
                w = words[skip + 1]
                after[w] = after.get(w, 0) + n
    for skip, words, n in split:
        if least > 1:
            if skip + 1 < len(words) and after[words[skip + 1]] < least:
                del words[skip + 1 :]
            if skip and before[words[skip - 1]] < least:
                del words[:skip]
                skip = 0
            if len(words) == 1:
                continue
        for phrase in owned(b" ".join(words), skip, size):
            counts[phrase] = counts.get(phrase, 0) + n
    return counts


def mined(pieces: DataFrame, least: int, size: int, held_most: int = HELD) -> DataFrame:
    """lang, phrase, its number of words and its number a, for phrases of 2 to ``size`` words that occur ``least`` times or more.

    Fragments are dealt by pivot and sorted by it, so that a task sees one
    pivot after the other; counts are final when the next one comes. Those of a
    pivot with very many fragments are handed on in parts, as are those of the pivots
    that are split, and summed once more.
    """
    dealt = pieces.repartition("route").sortWithinPartitions("route", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merged: dict[bytes, int] = {}
        out: list[tuple[str, bytes, int, bool]] = []
        now, partly = None, False

        def close() -> None:
            # parts of a pivot's counts say nothing about what is frequent
            found = expanded(merged, 1 if partly else least, size)
            out.extend((now[1], phrase, n, partly) for phrase, n in found.items() if partly or n >= least)
            merged.clear()

        def ready() -> pa.RecordBatch:
            langs, found, numbers, split = zip(*out, strict=True)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), _strings(list(found)), pa.array(numbers, pa.int64()), pa.array(split)], ["lang", "phrase", "a", "split"])

        for batch in batches:
            if not batch.num_rows:
                continue
            lang = batch.column("lang").dictionary_encode()
            route, code = batch.column("route").to_numpy(), lang.indices.to_numpy()
            split, n = batch.column("split").to_numpy(zero_copy_only=False), batch.column("n").to_pylist()
            fragment = batch.column("fragment").cast(pa.binary()).to_pylist()
            edges = [0, *(np.flatnonzero((route[1:] != route[:-1]) | (code[1:] != code[:-1])) + 1).tolist(), len(route)]
            for a, b in pairwise(edges):
                key = int(route[a]), lang.dictionary[int(code[a])].as_py()
                if now != key:
                    if now is not None:
                        close()
                    now, partly = key, bool(split[a:b].any())
                partly = partly or bool(split[a:b].any())
                for at in range(a, b, held_most):
                    for f, x in zip(fragment[at : min(b, at + held_most)], n[at : min(b, at + held_most)], strict=True):
                        merged[f] = merged.get(f, 0) + x
                    if len(merged) >= held_most:
                        partly = True
                        close()
            if len(out) >= held_most // 10:
                yield ready()
        if now is not None:
            close()
        if out:
            yield ready()

    local = cut(dealt.mapInArrow(run, "lang string, phrase string, a bigint, split boolean"), "phrases")
    rest = local.where("split").groupBy("lang", "phrase").agg(F.sum("a").alias("a")).where(F.col("a") >= least)
    return local.where("not split").select("lang", "phrase", "a").unionByName(rest).withColumn("size", F.size(F.split("phrase", " ")))


def phrases(docs: DataFrame, counts: DataFrame, least: int = 30, size: int = WORDS, limit: int = ORDERED) -> DataFrame:
    """The frequent phrases of rows (lang, text), neither of them null; ``counts`` are the ``word_counts`` of the same rows."""
    if not 2 <= size <= 8:
        raise ValueError("phrases have 2 to 8 words")
    return mined(fragments(docs, counts, least, size, limit), least, size)


def _part(first: Column | int, length: Column) -> Column:
    return F.array_join(F.slice(F.split("phrase", " "), first, length), " ")


def scored(found: DataFrame, counts: DataFrame) -> DataFrame:
    """Each phrase with l, r and score of its weakest cut: floor(2000000 * a / (l + r)), the smallest cut of equal ones.

    The counts of parts come by a join on (lang, part); a part of a frequent
    phrase is itself frequent, so none is missing.
    """
    known = counts.select("lang", F.col("word").alias("part"), F.col("n").alias("f")).unionByName(found.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f")))
    cuts = found.select("lang", "phrase", "size", "a", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    sides = cuts.select(
        "lang", "phrase", "a", "k", F.posexplode(F.array(_part(1, F.col("k")), _part(F.col("k") + 1, F.col("size") - F.col("k")))).alias("side", "part")
    )
    both = sides.join(known, ["lang", "part"]).groupBy("lang", "phrase", "a", "k")
    both = both.agg(F.max(F.when(F.col("side") == 0, F.col("f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("f"))).alias("r"))
    score = F.expr("cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    best = both.select("lang", "phrase", "a", F.struct(score.alias("score"), "k", "l", "r").alias("cut"))
    return best.groupBy("lang", "phrase", "a").agg(F.min("cut").alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def without_contained(found: DataFrame, percent: int = 80) -> DataFrame:
    """The phrases that no longer frequent one holds with ``percent`` of their number or more.

    The longest phrase but one decides: a phrase within a much longer one is
    also within one that is a word longer, which occurs no less often.
    """
    inner = found.where("size > 2").select("lang", "a", F.explode(F.array(_part(1, F.col("size") - 1), _part(2, F.col("size") - 1))).alias("phrase"))
    most = inner.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    held = F.expr(f"100 * cast(most as decimal(19,0)) >= {percent} * cast(a as decimal(19,0))")
    return found.join(most, ["lang", "phrase"], "left").where(~F.coalesce(held, F.lit(False))).drop("most")


def collocations(docs: DataFrame, least: int = 30, size: int = WORDS, top: int = 2000, percent: int = 80, lang_col: str = "lang", text_col: str = "text", limit: int = ORDERED) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z), cut at ``.,;:!?`` and line ends, and split at
    spaces and tabs. A phrase has 2 to ``size`` words of one piece and occurs
    ``least`` times or more, overlaps included. Its score is that of its weakest
    cut; phrases that occur mostly within a longer one are left out. ``n``
    counts all words of the language. Null texts count as empty, a null language
    as ``und``; a table without frequent phrases gives no rows. Rows that repeat
    count each time; other columns are not looked at.
    """
    lang, text = F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN_LANG)), F.col(text_col)
    rows = docs.select(lang.alias("lang"), text.alias("text")).where("text is not null")
    counts = cut(word_counts(rows), "words")
    found = cut(phrases(rows, counts, least, size, limit), "phrases")
    kept = scored(found, counts.where(F.col("n") >= least)).join(without_contained(found, percent).select("lang", "phrase"), ["lang", "phrase"])
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the best of each sixteenth first, so that no task sorts all of a language
    some = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(16))).orderBy(*order)
    ranked = kept.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= top)
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    words = counts.groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
