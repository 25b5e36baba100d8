"""Language identification by unigrams of pieces, summed over all segmentations.

Each language has a probability for each piece of a fixed public vocabulary,
learned by expectation maximisation. A word's probability is the sum over all
ways to cut it into pieces, by the forward algorithm; a text's is the product
over its words. Words of any length are summed over whole: sums are scaled as
they shrink.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftloom.llm.common import cut, fold, small_batches

#: Documents of a language that a fit reads at most, the least hashes of their ids; the one bound of the fit.
PER_LANGUAGE = 1500
ROUNDS, PARTS = 2, 8
#: Languages whose counts one job gathers, and whose probabilities one reading of the texts uses: at most 70 MB with 32 000 pieces.
LEARNED_AT_ONCE, SCORED_AT_ONCE = 64, 512
#: Steps after which sums are scaled, and the least probability of a piece: their product is far above the least double.
STEPS, LEAST = 8, 1e-30
#: Longest word that a fit sums over without logarithms.
SHORT = 32
#: Probability of a letter that is no piece.
UNKNOWN = 1e-7
#: Weight, in pieces, of the mean of all languages that smooths each one.
SMOOTH = 200.0
#: Words whose probabilities a worker keeps, and numbers that they have together.
KEPT_WORDS, KEPT_NUMBERS = 200_000, 8_000_000

LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """The lower-cased runs of letters."""
    return LETTERS.findall(text.lower()) if text else []


def has_letter(words: Sequence[str]) -> bool:
    return any(map(str.isalpha, words)) or any(c.isalpha() for w in words for c in w)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[str, ...]:
    """The distinct lower-cased pieces of a sentencepiece model; ``▁`` starts a word."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    return tuple(dict.fromkeys(p.lower() for p in pieces if p))


class Lattice:
    """All segmentations of many words at once; a word starts with ``▁``."""

    def __init__(self, pieces: Sequence[str]):
        self.ids = {p: i for i, p in enumerate(pieces)}
        self.starts = {p[:k]: -1 for p in pieces for k in range(1, len(p))} | self.ids
        self.none, self.unknown = len(pieces), len(pieces) + 1
        self.longest = max(map(len, pieces), default=1)

    def table(self, words: Sequence[str], n: int) -> np.ndarray:
        """For words of n letters: the id of the piece from i of length k + 1, as (words, n, k)."""
        get, longest = self.starts.get, min(self.longest, n)
        out = np.full((len(words), n, longest), self.none, dtype=np.int32)
        out[:, :, 0] = self.unknown
        places, found, at = [], [], 0
        for w in words:
            for i in range(n):
                end = i + 1
                # no piece starts with what none starts with
                while end <= n and (piece := get(w[i:end])) is not None:
                    if piece >= 0:
                        places.append(at + end - i - 1)
                        found.append(piece)
                    end += 1
                at += longest
        out.reshape(-1)[places] = found
        return out

    def forward(self, table: np.ndarray, probs: np.ndarray) -> np.ndarray:
        """The logarithm of the sum of all segmentations of each word: (words, languages).

        Sums of the prefixes that a next piece may follow are held in turn.
        """
        m, n, longest = table.shape
        held = np.zeros((longest + 1, m, probs.shape[1]))
        held[0] = 1
        logs = np.zeros((m, probs.shape[1]))
        for i in range(n):
            now = held[i % (longest + 1)]
            for k in range(min(longest, n - i)):
                held[(i + k + 1) % (longest + 1)] += now * probs[table[:, i, k]]
            now[:] = 0
            if i % STEPS == STEPS - 1:
                top = held.max(0)
                held /= top
                logs += np.log(top)
        return logs + np.log(held[n % (longest + 1)])

    def grouped(self, words: Sequence[str], entries: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions and tables of the words of each length, some at a time."""
        by_length: dict[int, tuple[list[int], list[str]]] = {}
        for at, word in enumerate(words):
            where, texts = by_length.setdefault(len(word) + 1, ([], []))
            where.append(at)
            texts.append("▁" + word)
        for n, (where, texts) in by_length.items():
            few = max(1, min(1000, entries // n))
            for i in range(0, len(texts), few):
                yield np.array(where[i : i + few]), self.table(texts[i : i + few], n)

    def log_probabilities(self, words: Sequence[str], probs: np.ndarray) -> np.ndarray:
        """The logarithm of each word's probability in each language."""
        total = np.zeros((len(words), probs.shape[1]))
        for where, table in self.grouped(words):
            total[where] = self.forward(table, probs)
        return total

    def expected(self, words: Sequence[str], weights: np.ndarray, probs: np.ndarray) -> np.ndarray:
        """Expected counts of each piece in weighted words, under one language's probabilities.

        Long words are summed over by their logarithms.
        """
        counts = np.zeros(len(probs))
        with np.errstate(divide="ignore"):
            logs = np.log(probs)
        # so many letters, each the least likely piece, are still far above the least double
        longest_short = min(SHORT, int(600 / max(-logs[probs > 0].min(initial=-1.0), 1.0)))
        for where, table in self.grouped(words):
            m, n, longest = table.shape
            short = n <= longest_short
            p = (probs if short else logs)[table]
            join, add, nothing, one = (np.multiply, np.add, 0.0, 1.0) if short else (np.add, np.logaddexp, -np.inf, 0.0)
            alpha, beta = np.full((m, n + 1), nothing), np.full((m, n + 1), nothing)
            alpha[:, 0] = beta[:, n] = one
            for i in range(n):
                for k in range(min(longest, n - i)):
                    alpha[:, i + k + 1] = add(alpha[:, i + k + 1], join(alpha[:, i], p[:, i, k]))
            for i in range(n - 1, -1, -1):
                for k in range(min(longest, n - i)):
                    beta[:, i] = add(beta[:, i], join(p[:, i, k], beta[:, i + k + 1]))
            for i in range(n):
                for k in range(min(longest, n - i)):
                    both = join(join(alpha[:, i], p[:, i, k]), beta[:, i + k + 1])
                    share = both / alpha[:, n] if short else np.exp(both - alpha[:, n])
                    counts += np.bincount(table[:, i, k], share * weights[where], minlength=len(probs))
        return counts


def sample_of(docs: DataFrame, per_language: int) -> DataFrame:
    """(lang, text) of the rows to learn from; written."""
    rows = docs.where("lang is not null and doc_id is not null").where(fold("doc_id") != 0)
    named = rows.groupBy("lang").count()  # a row a language, beside which the model has a number for each piece
    keys = rows.select("doc_id", "lang", F.shiftrightunsigned(F.xxhash64("doc_id"), 1).alias("hash")).join(F.broadcast(named), "lang")
    # about twice the rows that are wanted go on, so a frequent language is no large group
    keys = keys.where(F.col("hash") / F.lit(2.0**63) * F.col("count") < 2 * per_language)
    first = Window.partitionBy("lang").orderBy("hash", "doc_id")
    chosen = keys.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= per_language).select("doc_id").distinct()
    # per_language ids a language at most
    return cut(rows.join(F.broadcast(chosen), "doc_id", "left_semi").select("lang", "text").repartition(PARTS), "sample")


def learn(docs: DataFrame, pieces: Sequence[str], per_language: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """Every language, in order, and the probabilities (pieces and two more, languages).

    Each round is a job, for LEARNED_AT_ONCE languages at a time, over the
    sample, whose tasks send expected counts of pieces. The driver holds two
    numbers for each piece and language: half a megabyte a language.
    """
    sample = sample_of(docs.select("doc_id", "lang", "text"), per_language)
    langs = sorted(r[0] for r in sample.select("lang").distinct().collect())
    size = len(pieces)
    probs = np.zeros((size + 2, len(langs)))
    probs[:size] = 1 / max(size, 1)
    probs[-1] = UNKNOWN
    for _ in range(ROUNDS):
        counts = np.zeros((size, len(langs)))
        for at in range(0, len(langs), LEARNED_AT_ONCE):
            some = langs[at : at + LEARNED_AT_ONCE]
            now = sample.sparkSession.sparkContext.broadcast((pieces, {x: i for i, x in enumerate(some)}, probs[:, at : at + LEARNED_AT_ONCE]))
            rows = sample.where(F.col("lang").isin(some)) if len(langs) > LEARNED_AT_ONCE else sample
            rows = rows.mapInPandas(counter_of(now), "at int, piece int, n double").groupBy("at", "piece").agg(F.sum("n").alias("n")).toPandas()
            counts[rows["piece"].to_numpy(dtype=np.int64), at + rows["at"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy()
            now.unpersist()
        mean = (counts / np.maximum(counts.sum(0), 1)).mean(1) if len(langs) else np.zeros(size)
        mean = (mean + 0.05 / size) / 1.05
        probs = np.vstack([(counts + SMOOTH * mean[:, None]) / (counts.sum(0) + SMOOTH), np.zeros((1, len(langs))), np.full((1, len(langs)), UNKNOWN)])
    return langs, probs


def counter_of(now: Broadcast) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """What counts a task's pieces (language's place, piece, n) under the probabilities so far."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces, places, probs = now.value
        lattice = Lattice(pieces)
        words: dict[str, Counter] = {}
        for frame in frames:
            for lang, text in zip(frame["lang"], frame["text"], strict=True):
                words.setdefault(lang, Counter()).update(words_of(text))
        for lang, counter in words.items():
            n = lattice.expected(list(counter), np.fromiter(counter.values(), float, len(counter)), probs[:, places[lang]])[: len(pieces)]
            at = np.flatnonzero(n > 1e-9)
            yield pd.DataFrame({"at": places[lang], "piece": at, "n": n[at]})

    return count


class Scorer:
    """A worker's model with the probabilities of the words it met last."""

    def __init__(self, pieces: Sequence[str], probs: np.ndarray):
        self.lattice, self.probs = Lattice(pieces), np.where(probs > 0, np.maximum(probs, LEAST), 0.0)
        self.rows: dict[str, int] = {}
        self.logs = np.zeros((1024, probs.shape[1]))

    def learn_words(self, texts: Sequence[Sequence[str]]) -> None:
        if len(self.rows) > min(KEPT_WORDS, KEPT_NUMBERS // max(self.probs.shape[1], 1)):
            self.rows.clear()
        new = list(set().union(*texts) - self.rows.keys())
        if new:
            at = len(self.rows)
            if at + len(new) > len(self.logs):
                grown = np.zeros((max(2 * len(self.logs), at + len(new)), self.logs.shape[1]))
                grown[:at] = self.logs[:at]
                self.logs = grown
            self.logs[at : at + len(new)] = self.lattice.log_probabilities(new, self.probs)
            self.rows.update(zip(new, range(at, at + len(new)), strict=True))

    def log_likelihoods(self, texts: Sequence[Sequence[str]]) -> np.ndarray:
        """The logarithm of the probability of each text's words in each language."""
        self.learn_words(texts)
        get = self.rows.__getitem__
        return np.stack([self.logs[list(map(get, words))].sum(0) for words in texts])


def identify(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> DataFrame:
    """A row for each row of ``docs``: doc_id, held_out, lang_pred, score.

    Learns from text and non-null language of rows whose crc32(id as text)
    mod 5 is not 0. ``score`` is the predicted language's posterior share, all
    alike beforehand; of equal ones the first by name is predicted. A null text,
    one without a letter, and every text where nothing was learned: ``und`` with
    score 0. Where more than SCORED_AT_ONCE languages are known, the texts are read
    once for each so many, and the best so far goes along with them.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    pieces = vocabulary(model_path)
    langs, probs = learn(rows, pieces, per_language)
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.select("doc_id", "text", F.lit(None).cast("string").alias("lang_pred"), F.lit(None).cast("double").alias("top"), F.lit(None).cast("double").alias("total"))
    for at in range(0, len(langs), SCORED_AT_ONCE):
        last = at + SCORED_AT_ONCE >= len(langs)
        model = spark.sparkContext.broadcast((pieces, langs[at : at + SCORED_AT_ONCE], probs[:, at : at + SCORED_AT_ONCE].astype(np.float32)))
        out = out.mapInArrow(scorer_of(model, not last), f"doc_id {kind}, {'' if last else 'text string, '}lang_pred string, top double, total double")
        out = out if last else cut(out, "languages")
    score = F.coalesce(F.exp(F.col("top") - F.col("total")), F.lit(0.0))
    return out.select("doc_id", (fold("doc_id") == 0).alias("held_out"), F.coalesce("lang_pred", F.lit("und")).alias("lang_pred"), score.alias("score"))


def scorer_of(model: Broadcast, with_text: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What holds texts against some languages: the best of these and those before, its logarithm, and that of all their sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, langs, probs = model.value
        scorer = Scorer(pieces, probs.astype(np.float64))
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                names, tops, totals = (part.column(c).to_pylist() for c in ("lang_pred", "top", "total"))
                words = [words_of(t) for t in part.column("text").to_pylist()]
                told = [i for i, w in enumerate(words) if w and has_letter(w)]
                if told:
                    logs = scorer.log_likelihoods([words[i] for i in told])
                    best, top = logs.argmax(1), logs.max(1)
                    total = top + np.log(np.exp(logs - top[:, None]).sum(1))
                    for i, b, t, s in zip(told, best.tolist(), top.tolist(), total.tolist(), strict=True):
                        if tops[i] is None or t > tops[i]:
                            names[i], tops[i] = langs[b], t
                        totals[i] = s if totals[i] is None else float(np.logaddexp(totals[i], s))
                columns = {"doc_id": part.column("doc_id"), "text": part.column("text"), "lang_pred": pa.array(names, pa.string()), "top": pa.array(tops, pa.float64()), "total": pa.array(totals, pa.float64())}
                if not with_text:
                    del columns["text"]
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run
