"""Byte-level BPE encoding and decoding by proposing and verifying.

For each distinct word of a batch a greedy longest match proposes tokens. A BPE
result is right exactly if each token encodes to itself and each pair of
neighbours, encoded alone, gives that pair back; so all neighbours of a batch are
tested at once against a table of known pairs, a new pair is merged once, and
only words with a failing pair are merged exactly.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache
from hashlib import sha256
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftloom.llm.common import small_batches

#: Entries that a worker's tables of words and of pairs hold at most; a full table starts anew.
WORD_ENTRIES = 250_000
PAIR_ENTRIES = 500_000
#: Longest word, in bytes, that is kept in the table of words.
KEPT_BYTES = 64
#: Documents that are encoded together.
STEP = 200
#: Bytes of a word that is merged by scanning; longer ones use a heap.
SHORT = 48
NEVER = 1 << 40

# The published split pattern of this kind of tokenizer. \s there
# is the Unicode property White_Space, which Python's own \s is not.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
ASCII_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary, by the published rule.

    Printable Latin-1 characters stand for themselves; the other bytes, in
    order, are the characters from U+0100 on.
    """
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_vocabulary(path: str) -> dict:
    """What workers need of a tokenizer file: tokens as bytes by id, merges as ids, special tokens.

    Raises ValueError for files whose tokenizer is not plain byte-level BPE.
    """
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    model, before = told["model"], told.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    if not plain or told.get("normalizer") or model.get("ignore_merges") or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
        raise ValueError(f"{path}: not a plain byte-level BPE tokenizer")
    special = {t["content"]: t["id"] for t in told.get("added_tokens", [])}
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in told.get("added_tokens", [])):
        raise ValueError(f"{path}: special tokens that take white space are not handled")
    letters = byte_letters()
    tokens: list[bytes | None] = [None] * (1 + max([*model["vocab"].values(), *special.values()]))
    for token, i in model["vocab"].items():
        if token not in special:
            tokens[i] = bytes(letters[c] for c in token)
    for token, i in special.items():
        tokens[i] = token.encode()
    ids = model["vocab"]
    merges = []
    for merge in model["merges"]:
        left, right = merge.split(" ") if isinstance(merge, str) else merge
        merges.append((ids[left], ids[right], ids[left + right]))
    return {"tokens": tokens, "merges": np.array(merges, dtype=np.int64), "special": special}


class SpeculativeBPE:
    """Encodes and decodes with one vocabulary; its tables grow to fixed bounds."""

    def __init__(self, vocabulary: dict):
        self.tokens: list[bytes] = vocabulary["tokens"]
        special = vocabulary["special"]
        self.ids = {t: i for i, t in enumerate(self.tokens) if t is not None and i not in set(special.values())}
        self.starts = {t[:n]: -1 for t in self.ids for n in range(1, len(t))} | self.ids
        self.single = [self.ids[bytes([b])] for b in range(256)]
        self.rank = {(int(a) << 20) | int(b): r for r, (a, b, _) in enumerate(vocabulary["merges"])}
        self.made = [int(c) for _, _, c in vocabulary["merges"]]
        self.special = special
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.wide, self.narrow = regex.compile(SPLIT), re.compile(ASCII_SPLIT)
        self.alone: dict[int, bool] = {}
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, tuple[int, ...]] = {}

    def merged(self, word: bytes) -> list[int]:
        """Exact merging: the pair of lowest rank first, leftmost of equals."""
        if len(word) > SHORT:
            return self.merged_long(word)
        rank, made = self.rank, self.made
        ids = [self.single[b] for b in word]
        ranks = [rank.get((a << 20) | b, NEVER) for a, b in pairwise(ids)]
        while ranks and (r := min(ranks)) != NEVER:
            i = ranks.index(r)
            ids[i] = new = made[r]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank.get((ids[i - 1] << 20) | new, NEVER)
            if i < len(ranks):
                ranks[i] = rank.get((new << 20) | ids[i + 1], NEVER)
        return ids

    def merged_long(self, word: bytes) -> list[int]:
        """The same in O(n log n), for words without a bound of length."""
        rank, made = self.rank, self.made
        ids = [self.single[b] for b in word]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank[k], i, k) for i, k in enumerate((a << 20) | b for a, b in pairwise(ids)) if k in rank]
        heapq.heapify(heap)
        while heap:
            r, i, key = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or (ids[i] << 20) | ids[j] != key:
                continue
            new = made[r]
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (p := (new << 20) | ids[k]) in rank:
                    heapq.heappush(heap, (rank[p], i, p))
            if (h := before[i]) >= 0 and (p := (ids[h] << 20) | new) in rank:
                heapq.heappush(heap, (rank[p], h, p))
        return [t for t in ids if t >= 0]

    def proposed(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        starts, found = self.starts, []
        at, n = 0, len(word)
        while at < n:
            best, end, stop = self.single[word[at]], at + 2, at + 1
            while end <= n and (t := starts.get(word[at:end])) is not None:
                if t >= 0:
                    best, stop = t, end
                end += 1
            found.append(best)
            at = stop
        return found

    def stands_alone(self, token: int) -> bool:
        if (known := self.alone.get(token)) is None:
            known = self.alone[token] = self.merged(self.tokens[token]) == [token]
        return known

    def fits(self, key: int) -> bool:
        """Whether the two tokens of a key, as one word, are encoded as these two."""
        if (known := self.pairs.get(key)) is None:
            if len(self.pairs) >= PAIR_ENTRIES:
                self.pairs.clear()
            left, right = key >> 20, key & 0xFFFFF
            known = self.pairs[key] = self.merged(self.tokens[left] + self.tokens[right]) == [left, right]
        return known

    def encode_words(self, words: Sequence[bytes]) -> list[list[int]]:
        """The tokens of each word: proposals for all, one test of all neighbours, merging where it fails."""
        proposals = [self.proposed(w) for w in words]
        sizes = np.fromiter(map(len, proposals), dtype=np.int64, count=len(proposals))
        flat = np.fromiter(chain.from_iterable(proposals), dtype=np.int64, count=int(sizes.sum()))
        word = np.repeat(np.arange(len(words)), sizes)
        kinds, kind = np.unique(flat, return_inverse=True)
        bad = ~np.fromiter(map(self.stands_alone, kinds.tolist()), dtype=bool, count=len(kinds))[kind]
        inside = word[1:] == word[:-1]
        keys, key = np.unique(((flat[:-1] << 20) | flat[1:])[inside], return_inverse=True)
        unfit = ~np.fromiter(map(self.fits, keys.tolist()), dtype=bool, count=len(keys))[key]
        for i in np.unique(np.concatenate([word[bad], word[1:][inside][unfit]])).tolist():
            proposals[i] = self.merged(words[i])
        return proposals

    def pieces(self, text: str) -> list[str | int]:
        """The text's words in order; special tokens as ids."""
        if self.cut is None or not self.cut.search(text):
            return (self.narrow if text.isascii() else self.wide).findall(text)
        found: list[str | int] = []
        for part in self.cut.split(text):
            if part in self.special:
                found.append(self.special[part])
            elif part:
                found += (self.narrow if part.isascii() else self.wide).findall(part)
        return found

    def encode_batch(self, texts: Sequence[str]) -> Iterator[list[int]]:
        """The ids of each text, in order."""
        split = [self.pieces(t) for t in texts]
        known = self.words
        if len(known) >= WORD_ENTRIES:
            known.clear()
        new = [w for w in set().union(*split) - known.keys() if isinstance(w, str)]
        here: dict[str | int, Sequence[int]] = {}
        for w, ids in zip(new, self.encode_words([w.encode() for w in new]) if new else [], strict=True):
            if len(w) <= KEPT_BYTES and len(known) < 2 * WORD_ENTRIES:
                known[w] = tuple(ids)
            else:
                here[w] = ids
        for words in split:
            try:
                yield list(chain.from_iterable(map(known.__getitem__, words)))
            except KeyError:
                yield list(chain.from_iterable(known.get(w) or here.get(w) or (w,) for w in words))

    def decode(self, ids: Sequence[int]) -> str:
        """The tokens' bytes as UTF-8; what is not UTF-8 becomes U+FFFD. Raises IndexError or TypeError for ids that the vocabulary lacks."""
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids]).decode("utf-8", "replace")


_CODECS: dict[int, SpeculativeBPE] = {}


def codec_of(shared: Broadcast) -> SpeculativeBPE:
    """The worker's codec for a broadcast vocabulary; built once for each worker process."""
    key = shared._jbroadcast.id() if hasattr(shared, "_jbroadcast") and shared._jbroadcast is not None else id(shared.value)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = SpeculativeBPE(shared.value)
    return _CODECS[key]


@lru_cache(maxsize=4)
def _vocabulary(path: str) -> dict:
    return load_vocabulary(path)


def broadcast_vocabulary(spark: SparkSession, path: str) -> Broadcast:
    """The vocabulary for the workers; its size is that of the tokenizer file, whatever the data."""
    return spark.sparkContext.broadcast(_vocabulary(path))


def encoded_batches(codec: SpeculativeBPE, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str], list[list[int]]]]:
    """Slices of STEP rows with their texts (null: empty) and ids."""
    for batch in batches:
        for at in range(0, batch.num_rows, STEP):
            part = batch.slice(at, STEP)
            texts = [t or "" for t in part.column("text").to_pylist()]
            yield part, texts, list(codec.encode_batch(texts))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs``: doc_id and ids (array<int>), the tokens of the whole text.

    As the tokenizers library does without added special tokens, truncation and
    padding; a special token's string in a text is that token. Null and empty
    texts have no tokens.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = broadcast_vocabulary(spark, path)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, ids in encoded_batches(codec_of(shared), batches):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """A row for each row: doc_id and text; null ids give an empty text."""
    spark = encoded.sparkSession
    small_batches(spark)
    shared = broadcast_vocabulary(spark, path)
    rows = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared)
        for batch in batches:
            texts = [codec.decode(x or ()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Encodes each whole text and decodes its ids in one pass, so that ids need
    not leave the worker. Null and empty texts: 0 tokens, hashes of nothing.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = broadcast_vocabulary(spark, path)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared)
        names = [str(i) for i in range(len(codec.tokens))]
        for part, _, ids in encoded_batches(codec, batches):
            hashed = [sha256(",".join([names[i] for i in x]).encode()).hexdigest() for x in ids]
            decoded = [sha256(codec.decode(x).encode()).hexdigest() for x in ids]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(map(len, ids), pa.int64()), pa.array(hashed, pa.string()), pa.array(decoded, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
