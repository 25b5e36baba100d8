"""Quality classifier: ridge regression on random Fourier features, calibrated by isotonic regression.

Statistics of each whole text are the inputs. Cosines of random
projections of the standardised statistics approximate a Gaussian kernel. Each
partition of the labelled sample sums its normal equations; the driver adds the
few sums and solves. Scores of labelled rows outside the fit, in a histogram,
give the isotonic curve from raw scores to shares of good documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import log1p

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftloom.llm.common import cut, fold, small_batches

#: Labelled rows that a fit reads at most, the least hashes of their ids; a documented bound of the fit alone.
MAX_LABELLED = 40_000
#: Random features, the kernel's width in standard deviations, and the ridge.
FEATURES, WIDTH, RIDGE, SEED = 256, 4.0, 1e-3, 20
#: Parts of the sample, each of which sends one sum of FEATURES squared numbers.
PARTS = 8
#: Bins of the raw scores under the isotonic curve.
BINS = 400
#: The score from which a document is predicted good.
THRESHOLD = 0.3

NAMES = ("log_words", "log_bytes", "word_bytes", "symbols", "exclaims", "capitals", "digits", "pipes", "high_bytes", "stops", "distinct", "doubled", "most_frequent", "line_words", "repeated_lines", "long_words")
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_HIGH = bytes(range(128, 256))
_SYMBOLS = b"#*$%&<>^~_=+{}[]\\@/"


def statistics(text: bytes | None) -> tuple[float, ...]:
    """The statistics of a whole text, named by NAMES; a null text counts as an empty one."""
    text = text or b""
    words = text.split()
    n, size = len(words), len(text)
    if not n:
        return (0.0, log1p(size)) + (0.0,) * (len(NAMES) - 2)
    counts = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    black = size - len(text.translate(None, b" \t\n\x0b\x0c\r")) or 0
    letters = size - black
    less = lambda drop: (size - len(text.translate(None, drop))) / letters
    return (
        log1p(n),
        log1p(size),
        letters / n,
        less(_SYMBOLS),
        text.count(b"!") / n,
        less(_UPPER),
        less(_DIGITS),
        text.count(b"|") / n,
        less(_HIGH),
        (text.count(b".") + text.count(b",")) / n,
        len(counts) / n**0.8,
        sum(map(bytes.__eq__, words, words[1:])) / n,
        counts.most_common(1)[0][1] / n,
        log1p(n / max(len(lines), 1)),
        1 - len(set(lines)) / max(len(lines), 1),
        sum(len(w) > 24 for w in counts) / n,
    )


def _statistics_of(texts: pa.Array) -> np.ndarray:
    """The statistics of each text; one text at a time is a Python object."""
    found = np.empty((len(texts), len(NAMES)), dtype=np.float32)
    for i, text in enumerate(texts.cast(pa.binary())):
        found[i] = statistics(text.as_py())
    return found


def with_statistics(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows with the array ``stats`` in place of the text."""
    small_batches(rows.sparkSession)
    kept = [c for c in rows.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = _statistics_of(batch.column(text_col)).ravel()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * len(NAMES), pa.int32()), pa.array(flat, pa.float32()))
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), lists], [*kept, "stats"])

    return rows.mapInArrow(run, T.StructType([*rows.select(*kept).schema.fields, T.StructField("stats", T.ArrayType(T.FloatType()))]))


@dataclass
class Model:
    """Standardisation, projection, ridge weights and the isotonic curve."""

    mean: np.ndarray
    scale: np.ndarray
    omega: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    raw: np.ndarray
    share: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -8, 8)
        z = np.cos(x @ self.omega + self.phase) * np.sqrt(2 / len(self.phase))
        return np.hstack([z, x, np.ones((len(x), 1))])

    def raw_score(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        if not len(self.raw):
            return np.full(len(stats), 0.5)
        return np.interp(self.raw_score(stats), self.raw, self.share)


def isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence nearest to ``values`` in weighted least squares (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for v, w in zip(values, weights, strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.concatenate([np.full(int(n), v) for v, _, n in blocks]) if blocks else np.empty(0)


def _stacked(frame: pd.DataFrame) -> np.ndarray:
    return np.stack(frame["stats"].to_numpy()).astype(np.float64)


def fit(sample: DataFrame) -> Model:
    """A model from rows (stats, y, for_curve); rows for the curve take no part in the ridge fit.

    Without labelled rows the model scores every document 0.5.
    """
    d = len(NAMES)
    rng = np.random.default_rng(SEED)
    omega, phase = rng.standard_normal((d, FEATURES)) / WIDTH, rng.uniform(0, 2 * np.pi, FEATURES)
    sample = cut(sample.repartition(PARTS), "sample")
    moments = sample.select(*(F.col("stats")[i].cast("double").alias(f"x{i}") for i in range(d))).agg(
        *(F.avg(f"x{i}") for i in range(d)), *(F.stddev_pop(f"x{i}") for i in range(d))
    )
    row = moments.first()
    if row[0] is None:
        return Model(np.zeros(d), np.ones(d), omega, phase, np.zeros(FEATURES + d + 1), np.empty(0), np.empty(0))
    mean, scale = np.array(row[:d]), np.maximum(np.array(row[d:]), 1e-6)
    model = Model(mean, scale, omega, phase, np.zeros(FEATURES + d + 1), np.empty(0), np.empty(0))
    width = FEATURES + d + 1

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gram, right = np.zeros((width, width)), np.zeros(width)
        for frame in frames:
            frame = frame[~frame["for_curve"]]
            if len(frame):
                z = model.features(_stacked(frame))
                gram += z.T @ z
                right += z.T @ frame["y"].to_numpy()
        yield pd.DataFrame({"gram": [gram.tobytes()], "rhs": [right.tobytes()]})

    parts = sample.mapInPandas(sums, "gram binary, rhs binary").collect()  # PARTS rows of fixed size
    gram = sum(np.frombuffer(r.gram).reshape(width, width) for r in parts)
    rhs = sum(np.frombuffer(r.rhs) for r in parts)
    n = max(gram[-1, -1], 1.0)
    model.weights = np.linalg.solve(gram + RIDGE * n * np.diag([*[1 / FEATURES] * FEATURES, *[1.0] * d, 1e-9]), rhs)

    def binned(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame = frame[frame["for_curve"]]
            if len(frame):
                at = np.clip(np.floor((model.raw_score(_stacked(frame)) + 0.5) * BINS / 2), 0, BINS - 1).astype(np.int64)
                yield pd.DataFrame({"bin": at, "y": frame["y"].to_numpy(dtype=np.float64)})

    bins = sample.mapInPandas(binned, "bin long, y double").groupBy("bin").agg(F.count("y").alias("n"), F.avg("y").alias("y")).orderBy("bin").toPandas()  # BINS rows at most
    if len(bins):
        model.raw = (bins["bin"].to_numpy() + 0.5) * 2 / BINS - 0.5
        model.share = isotonic(bins["y"].to_numpy(), bins["n"].to_numpy(dtype=np.float64))
    return model


def learned(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = MAX_LABELLED) -> Model:
    """The model of the labelled rows whose crc32(id as text) mod 5 is not 0.

    Those with 1 give the isotonic curve, the rest the ridge fit; at most
    ``max_labelled`` of them. Null labels and ids teach nothing; several labels of
    an id count as their mean. Statistics are read of the labelled texts alone.
    """
    taught = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("double").alias("y")).where("doc_id is not null and y is not null and not isnan(y)")
    taught = taught.where(fold("doc_id") != 0).groupBy("doc_id").agg(F.avg("y").alias("y"))
    taught = taught.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # max_labelled rows of 16 bytes
    rows = rows.join(F.broadcast(taught), "doc_id").select("text", "y", (fold("doc_id") == 1).alias("for_curve"))
    return fit(with_statistics(rows))


def with_scores(rows: DataFrame, model: Model, text_col: str = "text", keep: Sequence[str] | None = None, score_col: str = "score") -> DataFrame:
    """The columns ``keep`` (all without it) of the rows with the score of each row's own text; no shuffle.

    Raises ValueError if a kept column has the score's name.
    """
    small_batches(rows.sparkSession)
    kept = list(rows.columns if keep is None else keep)
    if score_col in kept:
        raise ValueError(f"there is a column {score_col}")
    shared = rows.sparkSession.sparkContext.broadcast(model)  # a few hundred numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.clip(shared.value.score(_statistics_of(batch.column(text_col)).astype(np.float64)), 0, 1)
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), pa.array(scores, pa.float64())], [*kept, score_col])

    return rows.mapInArrow(run, T.StructType([*rows.select(*kept).schema.fields, T.StructField(score_col, T.DoubleType())]))


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    threshold: float = THRESHOLD,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    max_labelled: int = MAX_LABELLED,
) -> DataFrame:
    """A row for each row of ``docs``: doc_id, held_out, score (0 to 1), predicted (score >= threshold).

    Learns as :func:`learned` does. Only statistics of the text are inputs. Null
    and empty texts are scored by their (empty) statistics. Without labels every
    score is 0.5.
    """
    model = learned(docs, labels, id_col, text_col, label_col, max_labelled)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    scored = with_scores(rows, model, keep=["doc_id"])
    return scored.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
