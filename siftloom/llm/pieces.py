"""SentencePiece encoding and decoding that keeps each piece's place in the original bytes.

A text is first normalised by longest prefixes through the model's compiled
character map; each normalised byte records where in the original it comes from.
Pieces are merged on the normalised text, and their bounds, looked up in that
record, give every piece its span of the original UTF-8 bytes.
"""

from __future__ import annotations

import heapq
import re
import struct
import uuid
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftloom.llm.common import byte_batches

#: Words that a worker's table holds at most; a full table starts anew.
WORD_ENTRIES = 700_000
#: Longest word, in characters, that is kept in the table of words.
KEPT_CHARS = 48
#: Documents that are encoded together.
STEP = 100
#: Characters of a word that is merged by scanning; longer ones use a heap.
SHORT = 32

# Fixed values of the published model format: the sign of a space, kinds of
# pieces, the kind of model, and what an unknown piece is decoded to.
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
BPE = 2
UNKNOWN_TEXT = " ⁇ "


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a serialised message, in order."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield tag >> 3, data[at : at + size]
        at += size


def load_model(path: str) -> dict:
    """What workers need of a model file: pieces with scores and kinds, the character map and how spaces are handled.

    Raises ValueError for files whose model is not BPE with byte fallback or
    has pieces of a user's own, unused ones, or spaces as suffixes.
    """
    with open(path, "rb") as f:
        return parse_model(f.read(), path)


def parse_model(data: bytes, name: str = "model") -> dict:
    pieces, scores, kinds = [], [], []
    trainer: dict[int, int | bytes] = {}
    spec: dict[int, int | bytes] = {}
    for number, value in _fields(data):
        if number == 1:
            told = dict(_fields(value))
            pieces.append(told.get(1, b"").decode())
            scores.append(struct.unpack("<f", told.get(2, b"\0\0\0\0"))[0])
            kinds.append(told.get(3, NORMAL))
        elif number == 2:
            trainer = dict(_fields(value))
        elif number == 3:
            spec = dict(_fields(value))
    if trainer.get(3, 1) != BPE or not trainer.get(35) or trainer.get(24) or set(kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE} or not spec.get(5, 1):
        raise ValueError(f"{name}: not a BPE model with byte fallback and escaped spaces as prefixes")
    return {
        "key": uuid.uuid4().hex,
        "pieces": pieces,
        "scores": scores,
        "kinds": kinds,
        "map": spec.get(2, b""),
        "prefix": bool(spec.get(3, 1)),
        "squeeze": bool(spec.get(4, 1)),
        "unknown_text": trainer[44].decode() if 44 in trainer else UNKNOWN_TEXT,
    }


class CharacterMap:
    """A compiled map of byte strings: a double-array trie, then the replacements, each ended by a zero byte."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob, dtype="<u4", count=size // 4, offset=4).tolist() if size else []
        self.values = blob[4 + size :]
        # signs of ASCII that start no key, or only keys that go on outside ASCII: a run of them before more ASCII stays
        plain = [c for c in range(33, 127) if not self.units or not self._starts_ascii(c)]
        kept = "".join(re.escape(chr(c)) for c in plain).encode()
        self.plain = re.compile(b"(?:[" + kept + b"](?![\x80-\xff]))+") if kept else None

    def _child(self, node: int, byte: int) -> tuple[int, int] | None:
        """The child's base and unit; a unit holds its label in the low byte, a leaf flag, and the distance to its children."""
        if (at := node ^ byte) >= len(self.units):
            return None
        unit = self.units[at]
        return (at ^ ((unit >> 10) << ((unit & 512) >> 6)), unit) if unit & 0x800000FF == byte else None

    def _root(self) -> int:
        unit = self.units[0]
        return (unit >> 10) << ((unit & 512) >> 6)

    def _starts_ascii(self, byte: int) -> bool:
        found = self._child(self._root(), byte)
        return found is not None and (bool(found[1] >> 8 & 1) or any(self._child(found[0], c) for c in range(128)))

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """Replacement and length of the longest key at a place; None where no key starts."""
        if not self.units:
            return None
        node, found, start = self._root(), None, at
        while at < len(data) and (step := self._child(node, data[at])) is not None:
            node, unit = step
            at += 1
            if unit >> 8 & 1:
                found = self.units[node] & 0x7FFFFFFF, at - start
        if found is None:
            return None
        value, size = found
        return self.values[value : self.values.index(b"\0", value)], size


class PieceCodec:
    """Encodes and decodes with one model; its table of words grows to a fixed bound."""

    def __init__(self, model: dict):
        pieces, kinds = model["pieces"], model["kinds"]
        self.map = CharacterMap(model["map"])
        self.prefix, self.squeeze = model["prefix"], model["squeeze"]
        self.direct = not self.map.units and not self.squeeze
        self.ids = {p: i for i, p in enumerate(pieces) if kinds[i] == NORMAL}
        self.cost = {p: -model["scores"][i] for p, i in self.ids.items()}
        self.bytes = [0] * 256
        self.is_byte = np.array([k == BYTE for k in kinds])
        for i in np.flatnonzero(self.is_byte).tolist():
            self.bytes[int(pieces[i][3:-1], 16)] = i
        values = {i: bytes([b]) for b, i in enumerate(self.bytes)}
        self.size = np.array([1 if k == BYTE else len(p.encode()) for p, k in zip(pieces, kinds, strict=True)], dtype=np.int64)
        shown = {NORMAL: lambda p: p.replace(SPACE, " "), UNKNOWN: lambda p: model["unknown_text"], CONTROL: lambda p: ""}
        self.shown = [values[i] if k == BYTE else shown[k](p).encode() for i, (p, k) in enumerate(zip(pieces, kinds, strict=True))]
        self.control = {i for i, k in enumerate(kinds) if k == CONTROL}
        self.last_control = max(self.control, default=-1)
        self.spaced = [k == NORMAL and p.startswith(SPACE) for p, k in zip(pieces, kinds, strict=True)]
        # signs by number, and which may follow which inside a piece: no merge crosses any other pair of neighbours
        joints = {(ord(a), ord(b)) for p in self.ids for a, b in pairwise(p)}
        signs = sorted({c for pair in joints for c in pair})
        self.n_signs = len(signs) + 1
        self.sign = np.zeros(0x110000, dtype=np.int32)
        self.sign[signs] = np.arange(1, self.n_signs)
        self.joint = np.zeros(self.n_signs * self.n_signs, dtype=bool)
        pairs = np.array(sorted(joints)).reshape(-1, 2)
        self.joint[self.sign[pairs[:, 0]] * self.n_signs + self.sign[pairs[:, 1]]] = True
        self.words: dict[str, tuple[int, ...]] = {}

    # -- normalising -------------------------------------------------------

    def normalised(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text and, for each of its UTF-8 bytes and its end, where the original sign starts."""
        if not text:
            return "", np.zeros(1, dtype=np.int64)
        data = text.encode()
        if not self.direct:
            return self._mapped(data)
        raw = np.frombuffer(data, dtype=np.uint8)
        starts = np.arange(len(raw), dtype=np.int64)
        if not text.isascii():
            starts = np.maximum.accumulate(np.where(raw & 0xC0 == 0x80, 0, starts))
        origins = np.repeat(starts, np.where(raw == 32, 3, 1))
        lead = [0] * 3 if self.prefix else []
        return (SPACE if lead else "") + text.replace(" ", SPACE), np.concatenate([lead, origins, [len(raw)]]).astype(np.int64)

    def _mapped(self, data: bytes) -> tuple[str, np.ndarray]:
        sign, size_of = SPACE.encode(), {0xC: 2, 0xD: 2, 0xE: 3, 0xF: 4}

        def taken(at: int) -> tuple[bytes, int]:
            if (found := self.map.longest(data, at)) is not None:
                return found
            size = size_of.get(data[at] >> 4, 1)
            return data[at : at + size], size

        at, n = 0, len(data)
        while self.squeeze and at < n:
            value, size = taken(at)
            if value != b" ":
                break
            at += size
        out: list[bytes] = []
        origins: list[int] = []
        if at == n:
            return "", np.array([n])
        if self.prefix:
            out.append(sign)
            origins += [at] * 3
        blank = self.squeeze  # whether spaces at the start of what follows go
        while at < n:
            if self.map.plain is not None and (run := self.map.plain.match(data, at)) is not None:
                out.append(run.group())
                origins += range(at, run.end())
                at, blank = run.end(), False
                continue
            value, size = taken(at)
            value = value.lstrip(b" ") if blank else value
            if value:
                blank = self.squeeze and value.endswith(b" ")
                value = value.replace(b" ", sign)
                out.append(value)
                origins += [at] * len(value)
            at += size
        joined, end = b"".join(out), n
        while self.squeeze and joined.endswith(sign):
            joined = joined[:-3]
            end = origins[len(joined)]
            del origins[len(joined) :]
        return joined.decode(), np.array([*origins, end])

    # -- merging -----------------------------------------------------------

    def words_of(self, text: str) -> list[str]:
        """The text cut wherever no piece joins the two signs."""
        if not text:
            return []
        sign = self.sign[np.frombuffer(text.encode("utf-32-le"), dtype="<u4")]
        cuts = np.flatnonzero(~self.joint[sign[:-1] * self.n_signs + sign[1:]]) + 1
        return [text[a:b] for a, b in pairwise([0, *cuts.tolist(), len(text)])]

    def merged(self, word: str) -> list[int]:
        """The pieces of a word: the pair that makes the piece of highest score first, leftmost of equals."""
        parts = self._merged_long(word) if len(word) > SHORT else self._merged_short(word)
        found: list[int] = []
        for p in parts:
            if (i := self.ids.get(p)) is not None:
                found.append(i)
            else:
                found += [self.bytes[b] for b in p.encode()]
        return found

    def _merged_short(self, word: str) -> list[str]:
        cost, never = self.cost, float("inf")
        parts = list(word)
        costs = [cost.get(a + b, never) for a, b in pairwise(parts)]
        while costs and (least := min(costs)) != never:
            i = costs.index(least)
            parts[i] += parts[i + 1]
            del parts[i + 1], costs[i]
            if i:
                costs[i - 1] = cost.get(parts[i - 1] + parts[i], never)
            if i < len(costs):
                costs[i] = cost.get(parts[i] + parts[i + 1], never)
        return parts

    def _merged_long(self, word: str) -> list[str]:
        """The same in O(n log n), for words without a bound of length."""
        cost, n = self.cost, len(word)
        ends, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that starts here; 0: it was taken
        heap = [(cost[p], i, 2) for i in range(n - 1) if (p := word[i : i + 2]) in cost]
        heapq.heapify(heap)

        def offer(i: int, j: int) -> None:
            if (p := word[i : ends[j]]) in cost:
                heapq.heappush(heap, (cost[p], i, len(p)))

        while heap:
            _, i, size = heapq.heappop(heap)
            j = ends[i]
            if not j or j >= n or ends[j] - i != size:
                continue
            ends[i], ends[j] = ends[j], 0
            if ends[i] < n:
                before[ends[i]] = i
                offer(i, ends[i])
            if before[i] >= 0:
                offer(before[i], i)
        parts, at = [], 0
        while at < n:
            parts.append(word[at : ends[at]])
            at = ends[at]
        return parts

    # -- encoding and decoding ---------------------------------------------

    def _learned(self, word: str) -> Sequence[int]:
        """A word's ids; they are kept unless the word is long."""
        if (ids := self.words.get(word)) is None:
            ids = tuple(self.merged(word))
            if len(word) <= KEPT_CHARS:
                self.words[word] = ids
        return ids

    def encode_batch(self, texts: Sequence[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each text its ids and where each piece starts and ends in the text's UTF-8 bytes."""
        normal = [self.normalised(t) for t in texts]
        split = [self.words_of(t) for t, _ in normal]
        known = self.words
        if len(known) >= WORD_ENTRIES:
            known.clear()
        for (_, origins), words in zip(normal, split, strict=True):
            found = list(map(known.get, words))
            try:
                flat = list(chain.from_iterable(found))
            except TypeError:  # a word that is not known yet
                flat = list(chain.from_iterable(self._learned(w) if ids is None else ids for w, ids in zip(words, found, strict=True)))
            ids = np.array(flat, dtype=np.int32)
            bounds = np.concatenate([[0], np.cumsum(self.size[ids])])
            yield ids, origins[bounds[:-1]], origins[bounds[1:]]

    def decode(self, ids: Sequence[int]) -> str:
        """The pieces as text; bytes that are not UTF-8 become U+FFFD. Raises IndexError for ids that the model lacks."""
        shown = self.shown
        least = min(ids, default=0)
        if least < 0:
            raise IndexError("ids are from 0 on")
        parts = [shown[i] for i in ids]
        # the first piece that shows anything loses the space that encoding put before the text; if spaces are squeezed, so do those up to the first other sign
        if self.prefix or self.squeeze:
            for k, i in enumerate(ids):
                if self.spaced[i]:
                    parts[k] = parts[k][1:]
                if parts[k] or (self.spaced[i] and not self.squeeze):
                    break
        if least > self.last_control or self.control.isdisjoint(ids):  # one inside a run of byte pieces ends it
            try:
                return b"".join(parts).decode()
            except UnicodeDecodeError:
                pass
        return "".join(self._by_runs(ids, parts))

    def _by_runs(self, ids: Sequence[int], parts: Sequence[bytes]) -> Iterator[str]:
        """Runs of byte pieces, where each byte that starts no whole sign becomes U+FFFD by itself."""
        run = b""
        for i, part in zip([*ids, None], [*parts, b""], strict=True):
            if i is not None and self.is_byte[i]:
                run += part
                continue
            at = 0
            while at < len(run):
                for size in (4, 3, 2, 1):
                    try:
                        sign = run[at : at + size].decode()
                    except UnicodeDecodeError:
                        continue
                    if len(sign) == 1:
                        break
                else:
                    sign, size = "�", 1
                yield sign
                at += len(sign.encode()) if sign != "�" else size
            run = b""
            yield part.decode()


_CODECS: dict[str, PieceCodec] = {}


def codec_of(shared: Broadcast) -> PieceCodec:
    """The worker's codec for a broadcast model; built once for each worker process."""
    key = shared.value["key"]
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = PieceCodec(shared.value)
    return _CODECS[key]


@lru_cache(maxsize=4)
def _model(path: str) -> dict:
    return load_model(path)


def broadcast_model(spark: SparkSession, path: str) -> Broadcast:
    """The model for the workers; its size is that of the model file, whatever the data."""
    return spark.sparkContext.broadcast(_model(path))


def _listed(parts: Sequence[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*parts, []]), kind, safe=False))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs``: doc_id, ids, starts, ends (arrays of int) of the whole text.

    ``ids`` are as the sentencepiece library gives them without begin and end
    ids. Piece i covers the bytes ``starts[i]`` up to ``ends[i]`` of the text's
    UTF-8 form: the space put before a text covers none, signs that the
    character map joins or drops belong to the piece of what they became, and
    of the byte pieces of one sign the last covers it. Null and empty texts have
    no pieces. Repeated rows stay, other columns are not looked at.
    """
    spark = docs.sparkSession
    byte_batches(spark, "1m")
    shared = broadcast_model(spark, path)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared)
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                found = list(codec.encode_batch([t or "" for t in part.column("text").to_pylist()]))
                lists = [_listed(column, pa.int32()) for column in zip(*found, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *lists], ["doc_id", "ids", "starts", "ends"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>, starts array<int>, ends array<int>")


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """The rows with the text of their ids in ``text_col`` in place of the ids; null ids give an empty text. Raises IndexError for ids that the model lacks."""
    spark = encoded.sparkSession
    byte_batches(spark, "1m")
    shared = broadcast_model(spark, path)
    kept = [c for c in encoded.columns if c not in (ids_col, text_col)]
    rows = encoded.select(*kept, F.col(ids_col).cast("array<int>").alias(ids_col))
    schema = rows.drop(ids_col).withColumn(text_col, F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared)
        for batch in batches:
            lists = batch.column(ids_col)
            flat, ends = lists.flatten().to_pylist(), np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).tolist()
            texts = [codec.decode(flat[a:b]) for a, b in pairwise([0, *ends])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*kept, text_col])

    return rows.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256, of what ``encode`` and ``decode`` give.

    Null and empty texts: 0 tokens, hashes of nothing.
    """
    ids = encode(docs, path, id_col, text_col).select(
        "doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256")
    )
    return decode(ids, path).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
