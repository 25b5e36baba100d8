"""N-gram Jaccard join: which documents share enough of their word n-grams.

The join is a sparse product of the document by n-gram incidence matrix with
its transpose, in blocks of columns and of rows, that never forms what cannot
reach the threshold:

1. Columns in a fixed part of the hash space form a first block. A document goes
   on only if, in that block, the number of its n-grams that some other document
   also has reaches the bound that its size gives. The rest link with nothing.
2. Equal sets become one row of the matrix, their representative.
3. The remaining columns are ordered by how many rows have them. A pair that
   reaches the threshold meets in the first, rarest columns of each row, as far
   as the two sizes give (prefix bound).
4. In each such column every row is multiplied with the row in which the column
   comes earliest. Overlaps are accumulated over the blocks of columns; after each
   a pair goes unless what it has and what the rest may add reach its bound. Links
   give components. Only pairs of different components that still meet the bounds
   are multiplied after that, so no link between different components is lost.
5. Within each component blocks of rows are multiplied with one another, block of
   columns by block of columns, and each row's links are counted where they are
   formed: no pairs are written, however large a group of near copies is.

Components are the smallest id reachable, found by min-label propagation with
pointer jumping over written tables. Columns and components that very many rows
have come by broadcast, as few can have so many, so none is a task's hot key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftloom.llm.common import cut, small_batches

#: The first block of columns: hashes below FIRST * 2**64.
FIRST = 0.25
#: Ids that the filter sent to the second reading of the texts is built for at most, at 16 bits or more each: 64 MB. More are joined by shuffle.
FILTER_IDS = 1 << 25
#: Documents that one message of the first block covers at least and at most; rows of a message's bucket are packed bytes.
CHUNK, MAX_CHUNK = 4000, 32_000
#: Blocks of columns, by the first bits of their hashes, in which overlaps are accumulated.
BLOCKS = 4
#: Rows and entries that a block of rows holds about; columns that are multiplied at a time.
BLOCK_ROWS, BLOCK_ENTRIES, BLOCK_COLUMNS = 2000, 1 << 21, 2048
#: Keys that are joined by broadcast at most: those with at least this many rows, and at least total / HOT_KEYS.
HOT_KEYS, HOT_ROWS = 20_000, 256
#: Hashes of words that a worker keeps.
KEPT_WORDS = 400_000

_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, so that each bit of a sum matters."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """64-bit hashes of the distinct word n-grams of texts, A-Z lower-cased; sorted."""

    def __init__(self, n: int):
        self.n = n
        self.known: dict[bytes, int] = {}
        self.factors = np.array([mix64(_FACTORS[i % 8] + np.array([i], dtype=np.uint64))[0] | np.uint64(1) for i in range(n)], dtype=np.uint64)

    def hashes(self, text: bytes | None) -> np.ndarray:
        words = text.lower().split() if text else ()
        if not words:
            return np.empty(0, dtype=np.uint64)
        known = self.known
        try:
            h = [known[w] for w in words]
        except KeyError:
            if len(known) > KEPT_WORDS:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            h = [known[w] for w in words]
        h = np.array(h, dtype=np.uint64)
        n = min(self.n, len(h))
        with np.errstate(over="ignore"):
            total = h[: len(h) - n + 1] * self.factors[0]
            for i in range(1, n):
                total = total + mix64(h[i : len(h) - n + 1 + i]) * self.factors[i]
            return np.unique(mix64(total + np.uint64(n)))


def least_overlap(size_a: Column, size_b: Column, percent: int) -> Column:
    """The least intersection with which two sets of these sizes reach the threshold."""
    return F.ceil(F.lit(percent) * (size_a + size_b) / F.lit(100 + percent))


def prefix_length(n: int, percent: int) -> int:
    """How many of a set's n-grams, in any common order, a linked set cannot all lack."""
    return n - -(-n * percent // 100) + 1


def first_block(docs: DataFrame, n: int, percent: int, buckets: int) -> DataFrame:
    """Per document: doc_id, n_shingles, class_a, class_b, wanted and found; per class that meets others: class_a, far.

    A task sends, for each chunk of documents and bucket of hashes, the hashes
    of the first block that the chunk holds, each once, with the class of the
    set that has it, or 0 if several of the chunk have it; those count as found
    at once. So a passage that all documents have is one entry for each chunk,
    not for each document. The documents' own rows are dealt over the buckets in
    turn, so a class of very many copies is in no one bucket.
    """
    chunk = min(max(CHUNK, buckets // 16), MAX_CHUNK)
    limit = np.uint64(int(FIRST * 2**64))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(n)
        ids: list[int | None] = []
        blocks: list[np.ndarray] = []
        sizes: list[int] = []
        classes: list[tuple[int, int]] = []
        context = TaskContext.get()
        turn = 7919 * (context.partitionId() if context else 0)

        def flush() -> Iterator[pa.RecordBatch]:
            # of equal sets in the chunk one sends and counts for all
            lead: dict[tuple[int, int], int] = {}
            first = [lead.setdefault(c, i) for i, c in enumerate(classes)]
            own = np.fromiter(lead.values(), np.int64, len(lead))
            flat = np.concatenate([blocks[i] for i in own])
            of = np.repeat(own, [len(blocks[i]) for i in own])
            order = np.argsort(flat, kind="stable")
            flat, of = flat[order], of[order]
            starts = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]]) if len(flat) else np.empty(0, np.int64)
            counts = np.diff(np.r_[starts, len(flat)])
            local = np.bincount(of[np.repeat(counts > 1, counts)], minlength=len(ids))
            wanted = [len(x) - (s - -(-s * percent // 100)) for x, s in zip(blocks, sizes, strict=True)]
            yield _message(
                bucket=[(turn + i) % buckets for i in range(len(ids))], doc_id=ids, n_shingles=sizes, class_a=[c[0] for c in classes],
                class_b=[c[1] for c in classes], wanted=wanted, found=local[first].tolist(),
            )
            names = np.array([c[0] for c in classes], dtype=np.int64)
            kinds, who = flat[starts], np.where(counts > 1, 0, names[of[starts]])
            part = (kinds % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            edges = np.searchsorted(part[order], np.arange(buckets + 1))
            full = np.flatnonzero(np.diff(edges)).tolist()
            cuts = [order[edges[b] : edges[b + 1]] for b in full]
            if full:
                yield _message(bucket=full, hashes=[kinds[x].tobytes() for x in cuts], classes=[who[x].tobytes() for x in cuts])
            for x in (ids, blocks, sizes, classes):
                x.clear()

        for batch in batches:
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                h = shingler.hashes(text)
                digest = xxhash.xxh3_128_digest(h.tobytes())
                ids.append(i)
                blocks.append(h[: int(np.searchsorted(h, limit))].copy() if i is not None else h[:0])
                sizes.append(len(h))
                # the last bit set: 0 stays free; a document without an id has a class of its own
                classes.append((int.from_bytes(digest[:8], "little", signed=True) | 1, int.from_bytes(digest[8:], "little", signed=True) if i is not None else None))
                if len(ids) >= chunk:
                    yield from flush()
        if ids:
            yield from flush()

    def meet(key: tuple, part: pa.Table) -> pa.Table:
        heads = part.filter(pc.is_valid(part.column("n_shingles"))).select([*_HEADS, "far"])
        sent = part.filter(pc.is_valid(part.column("hashes")))
        if not sent.num_rows:
            return heads
        hashes, classes = (np.concatenate([np.frombuffer(x, kind) for x in sent.column(name).to_pylist()]) for name, kind in (("hashes", np.uint64), ("classes", np.int64)))
        order = np.lexsort((classes, hashes))
        hashes, classes = hashes[order], classes[order]
        new = np.r_[True, (hashes[1:] != hashes[:-1]) | (classes[1:] != classes[:-1])]
        hashes, classes = hashes[new], classes[new]
        starts = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]])
        counts = np.diff(np.r_[starts, len(hashes)])
        who, far = np.unique(classes[np.repeat(counts > 1, counts) & (classes != 0)], return_counts=True)
        met = pa.table({k: pa.array(who) if k == "class_a" else pa.array(far, pa.int64()) if k == "far" else pa.nulls(len(who), _TYPES[k]) for k in [*_HEADS, "far"]})
        return pa.concat_tables([heads, met])

    schema = "bucket int, doc_id long, n_shingles long, class_a long, class_b long, wanted long, found long, far long, hashes binary, classes binary"
    return docs.mapInArrow(send, schema).groupBy("bucket").applyInArrow(meet, "doc_id long, n_shingles long, class_a long, class_b long, wanted long, found long, far long")


_HEADS = ["doc_id", "n_shingles", "class_a", "class_b", "wanted", "found"]
_TYPES = {"bucket": pa.int32()} | {k: pa.int64() for k in [*_HEADS, "far"]} | {"hashes": pa.binary(), "classes": pa.binary()}


def _message(**columns: list) -> pa.RecordBatch:
    n = len(columns["bucket"])
    return pa.RecordBatch.from_arrays([pa.array(columns[k], t) if k in columns else pa.nulls(n, t) for k, t in _TYPES.items()], list(_TYPES))


class IdFilter:
    """A Bloom filter of ids, sized by their number; it may let others through, never stops a member."""

    def __init__(self, words: np.ndarray):
        self.words = words

    @staticmethod
    def size_for(n_ids: int) -> int:
        """The number of 64-bit words: a power of two with 16 bits for each id or more."""
        return 1 << max(14, (n_ids * 16 // 64).bit_length())

    @staticmethod
    def places(ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Two bits of the filter for each id."""
        with np.errstate(over="ignore"):
            h = mix64(ids.astype(np.uint64))
        low = np.uint64(64 * size - 1)
        return h & low, (h >> np.uint64(32)) & low

    @classmethod
    def build(cls, ids: DataFrame, n_ids: int) -> IdFilter:
        """Each task sends its words that are not zero; the driver holds the whole filter and no ids."""
        size = cls.size_for(n_ids)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words = np.zeros(size, dtype=np.uint64)
            for batch in batches:
                for place in cls.places(batch.column(0).to_numpy(zero_copy_only=False), size):
                    np.bitwise_or.at(words, (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
            at = np.flatnonzero(words)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(words[at].view(np.int64), pa.int64())], ["at", "word"])

        rows = ids.mapInArrow(run, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
        words = np.zeros(size, dtype=np.int64)
        words[rows.column("at").to_numpy()] = rows.column("word").to_numpy()
        return cls(words.view(np.uint64))

    def has(self, ids: np.ndarray) -> np.ndarray:
        a, b = self.places(ids, len(self.words))
        bit = lambda p: (self.words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1)
        return (bit(a) & bit(b)).astype(bool)


def sets_of(docs: DataFrame, chosen: DataFrame, n: int) -> DataFrame:
    """The sets of the chosen ids: rep, size, one array of shingles for each block of columns, and how many later blocks hold.

    A filter spares the other texts, and an exact join does the rest; more ids
    than a filter can hold are joined with their texts first.
    """
    spark = docs.sparkSession
    chosen = chosen.select(F.col(chosen.columns[0]).alias("doc_id"))
    n_ids = chosen.count()
    filtered = n_ids <= FILTER_IDS
    if not filtered:
        docs = docs.join(chosen, "doc_id", "left_semi")
    ids = spark.sparkContext.broadcast(IdFilter.build(chosen, n_ids) if filtered else None)
    edges = np.array([i * (2**64 // BLOCKS) for i in range(1, BLOCKS)], dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(n)
        for batch in batches:
            if ids.value is not None:
                batch = batch.filter(pa.array(ids.value.has(batch.column("doc_id").fill_null(-1).to_numpy(zero_copy_only=False))))
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                sets = [shingler.hashes(x) for x in part.column("text").cast(pa.binary()).to_pylist()]
                cuts = np.array([[0, *np.searchsorted(s, edges), len(s)] for s in sets]).reshape(len(sets), BLOCKS + 1)
                columns = [part.column("doc_id"), pa.array(cuts[:, -1], pa.int64())]
                for k in range(BLOCKS):
                    flat = np.concatenate([s[c[k] : c[k + 1]] for s, c in zip(sets, cuts, strict=True)]).view(np.int64)
                    columns.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(cuts[:, k + 1] - cuts[:, k])], pa.int32()), pa.array(flat, pa.int64())))
                rest = (cuts[:, -1:] - cuts[:, 1:]).ravel()
                columns.append(pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * BLOCKS, pa.int32()), pa.array(rest, pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, ["rep", "size", *_SLICES, "rest"])

    rows = docs.mapInArrow(run, "rep long, size long, " + ", ".join(f"{k} array<long>" for k in _SLICES) + ", rest array<int>")
    if filtered:
        rows = rows.join(chosen.withColumnRenamed("doc_id", "rep"), "rep", "left_semi")
    return rows.dropDuplicates(["rep"])


_SLICES = [f"s{k}" for k in range(BLOCKS)]


def beside(rows: DataFrame, keyed: DataFrame, key: str, n: str) -> DataFrame:
    """``rows`` with the one row of the written table ``keyed`` that has their key; rows without one go.

    ``n`` is the number of rows that have a key. Keys of very many rows come by
    broadcast: those with a share of 1 / HOT_KEYS or more, HOT_KEYS of them at
    most. Their rows are spread over the join that the others take.
    """
    total = keyed.agg(F.sum(n)).first()[0] or 0
    least = max(HOT_ROWS, total // HOT_KEYS)
    told = [c for c in keyed.columns if c != key]
    pack = lambda part, name, to: part.select(F.col(key).alias(to), F.struct(*told).alias(name))
    hot, cold = pack(keyed.where(F.col(n) >= least), "_hot", key), pack(keyed.where(F.col(n) < least), "_cold", "_key")
    met = rows.join(F.broadcast(hot), key, "left")
    met = met.withColumn("_key", F.when(F.col("_hot").isNull(), F.col(key)).otherwise(F.xxhash64(*rows.columns)))
    met = met.join(cold, "_key", "left").withColumn("_told", F.coalesce("_hot", "_cold")).where("_told is not null")
    return met.select(*rows.columns, *(F.col(f"_told.{c}").alias(c) for c in told))


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """The entries of the rarest columns: shingle, rep, size, pos; those of a single row are left out."""
    flat = sets.select("rep", F.explode(F.concat(*_SLICES)).alias("shingle"))
    rows = cut(flat.groupBy("shingle").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"), "columns")
    known = beside(flat, rows, "shingle", "rows").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("rows", "shingle"))).alias("known"))
    length = F.col("size") - F.ceil(F.col("size") * F.lit(percent) / F.lit(100)) + 1
    alone = F.col("size") - F.size("known")
    kept = known.join(sets.select("rep", "size"), "rep").withColumns({"alone": alone, "length": length}).where("alone < length")
    kept = kept.select("rep", "size", "alone", F.slice("known", 1, F.greatest(F.col("length") - F.col("alone"), F.lit(0)).cast("int")).alias("known"))
    return kept.select("rep", "size", "alone", F.posexplode("known").alias("at", "x")).select(F.col("x.shingle").alias("shingle"), "rep", "size", (F.col("alone") + F.col("at")).cast("long").alias("pos"))


def within_bounds(a: str, b: str, percent: int) -> Column:
    """Whether two entries of a column may be the first that their rows have in common."""
    need = least_overlap(F.col(f"{a}.size"), F.col(f"{b}.size"), percent)
    rest = F.least(F.col(f"{a}.size") - F.col(f"{a}.pos"), F.col(f"{b}.size") - F.col(f"{b}.pos"))
    return rest >= need


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the distinct pairs (a, b) whose overlap reaches the threshold.

    Overlaps are accumulated block of columns by block of columns; a pair goes
    as soon as the rest of the smaller row could not take it to its bound.
    """
    pairs = pairs.select("a", "b", F.lit(0).alias("overlap"))
    for k, column in enumerate(_SLICES):
        side = lambda end: sets.select(F.col("rep").alias(end), F.col("size").alias(f"size_{end}"), F.col(column).alias(f"set_{end}"), F.col("rest")[k].alias(f"rest_{end}"))  # noqa: B023, E731
        met = pairs.join(side("a"), "a").join(side("b"), "b")
        met = met.withColumn("overlap", F.col("overlap") + F.size(F.array_intersect("set_a", "set_b")))
        most = F.col("overlap") + F.least("rest_a", "rest_b")
        pairs = met.where(most * (100 + percent) >= (F.col("size_a") + F.col("size_b")) * percent).select("a", "b", "overlap")
    return pairs.select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """For each id that a link (a, b) names: node and the smallest id of its component.

    Rounds of taking the smallest label of all neighbours, then that label's
    own label, until nothing changes.
    """
    edges = cut(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = cut(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), "labels")
    while True:
        around = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        near = labels.join(around, "node").select("node", "label", F.least("label", "near").alias("near"))
        jump = labels.select(F.col("node").alias("near"), F.col("label").alias("far"))
        moved = cut(near.join(jump, "near", "left").select("node", F.col("label").alias("old"), F.least("near", F.coalesce("far", "near")).alias("label")), "labels")
        labels = moved.select("node", "label")
        if moved.where("label <> old").isEmpty():
            return labels


def matrix(docs: DataFrame, n: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Steps 1 to 3: the documents, their classes, the sets of the representatives that go on and their prefix entries."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    buckets = max(32, rows.count() // 2000)
    told = cut(first_block(rows, n, percent, buckets), "block")
    heads = told.where("n_shingles is not null").select("doc_id", "n_shingles", "class_a", "class_b", "wanted", "found")
    far = told.where("n_shingles is null").groupBy("class_a").agg(F.sum("far").alias("far"))
    by_class = heads.where("n_shingles > 0 and doc_id is not null").groupBy("class_a", "class_b").agg(F.min("doc_id").alias("rep"), F.min("wanted").alias("wanted"), F.max("found").alias("found"))
    goes_on = F.col("found") + F.coalesce("far", F.lit(0)) >= F.col("wanted")
    by_class = cut(by_class.join(far, "class_a", "left").select("class_a", "class_b", "rep", goes_on.alias("goes_on")), "classes")
    sets = cut(sets_of(rows, by_class.where("goes_on").select("rep"), n), "sets")
    entries = cut(prefixes(sets, percent), "prefixes")
    return heads, by_class, sets, entries


def products(rows: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the rows of one component and the sum of the members of the rows that each links with.

    Rows of two parts are multiplied across only, those of one with one another.
    Overlaps are accumulated over blocks of columns; a row goes as soon as no
    pair of its can still reach its bound.
    """
    reps, members, sizes, parts = (rows.column(c).to_numpy() for c in ("rep", "members", "size", "part"))
    slices = [rows.column(k).combine_chunks() for k in _SLICES]
    lengths = np.stack([np.diff(x.offsets.to_numpy()) for x in slices])
    first, total = parts == parts.min(), np.zeros(len(reps), dtype=np.int64)
    across = not first.all()
    i, j = (np.flatnonzero(first), np.flatnonzero(~first)) if across else (np.arange(len(reps)),) * 2
    need = -(-(sizes[i][:, None] + sizes[j][None, :]) * percent // (100 + percent))
    found = np.zeros((len(i), len(j)), dtype=np.float32)
    rest = sizes.astype(np.int64).copy()
    for k, x in enumerate(slices):
        flat, of = x.flatten().to_numpy(), np.repeat(np.arange(len(reps)), lengths[k])
        alive = np.zeros(len(reps), dtype=bool)
        alive[i], alive[j] = True, True
        flat, of = flat[alive[of]], of[alive[of]]
        _, column, counts = np.unique(flat, return_inverse=True, return_counts=True)
        shared = counts[column] > 1
        of, column = of[shared], (np.cumsum(counts > 1) - 1)[column[shared]]
        order = np.argsort(column, kind="stable")
        of, column = of[order], column[order]
        place = np.full(len(reps), -1)
        for at in range(0, int(column[-1]) + 1 if len(column) else 0, BLOCK_COLUMNS):
            a, b = np.searchsorted(column, (at, at + BLOCK_COLUMNS))
            dense = lambda side: _incidence(place, side, of[a:b], column[a:b] - at)  # noqa: B023, E731
            left = dense(i)
            found += left @ (dense(j) if across else left).T
        rest -= lengths[k]
        open_ = found + np.minimum(rest[i][:, None], rest[j][None, :]) >= need
        if not across:
            np.fill_diagonal(open_, False)
        keep_i, keep_j = open_.any(1), open_.any(0)
        i, j, found, need = i[keep_i], j[keep_j], found[np.ix_(keep_i, keep_j)], need[np.ix_(keep_i, keep_j)]
    links = found >= need
    if not across:
        np.fill_diagonal(links, False)
    total[i] += links @ members[j]
    if across:
        total[j] += links.T @ members[i]
    return reps, total


def _incidence(place: np.ndarray, side: np.ndarray, of: np.ndarray, column: np.ndarray) -> np.ndarray:
    """The dense block of the incidence matrix of some rows and a block of columns."""
    place[:] = -1
    place[side] = np.arange(len(side))
    out = np.zeros((len(side), BLOCK_COLUMNS), dtype=np.float32)
    own = place[of] >= 0
    out[place[of[own]], column[own]] = 1
    return out


def link_counts(classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """For classes (rep, label, members) that lie in components of several: rep and n, the members of the other classes that it links with.

    A component is dealt into parts of about BLOCK_ROWS rows and BLOCK_ENTRIES
    entries; each pair of parts is a task's group, and small components share one.
    """
    several = classes.groupBy("label").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    rows = beside(classes, cut(several, "several"), "label", "rows").join(sets, "rep")
    rows = cut(rows, "rows")
    sizes = rows.groupBy("label").agg(F.sum("size").alias("entries"), F.count(F.lit(1)).alias("n"))
    parts = F.greatest(F.ceil(F.col("n") / BLOCK_ROWS), F.ceil(F.col("entries") / BLOCK_ENTRIES))
    sizes = cut(sizes.select("label", "n", "entries", parts.cast("int").alias("parts")), "sizes")
    lots = 1 + (sizes.agg(F.sum("entries")).first()[0] or 0) // (BLOCK_ENTRIES // 4)
    dealt = beside(rows, sizes, "label", "n").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    one = F.col("parts") == 1
    dealt = dealt.select(
        F.when(one, F.pmod(F.xxhash64("label"), F.lit(lots))).otherwise(F.col("label")).alias("lot"),
        F.when(one, -1).otherwise(F.least("part", "other")).alias("low"),
        F.greatest("part", "other").alias("high"),
        "label", "part", "rep", "members", "size", *_SLICES,
    )

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("label")
        labels = table.column("label").to_numpy()
        edges = np.flatnonzero(np.r_[True, labels[1:] != labels[:-1], True])
        told = [products(table.slice(a, b - a), percent) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        reps, totals = (np.concatenate(x) for x in zip(*told, strict=True))
        return pa.table({"rep": reps, "n": totals})

    return dealt.groupBy("lot", "low", "high").applyInArrow(run, "rep long, n long").groupBy("rep").agg(F.sum("n").alias("n"))


def jaccard_classes(docs: DataFrame, n: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", counted: bool = True) -> DataFrame:
    """A row for each row of ``docs``: doc_id (long), n_shingles, class_id, component_id and, if ``counted``, n_links.

    A document's set holds its distinct ``n``-word shingles, A-Z lower-cased;
    fewer words form one shingle together; null texts and texts without words
    have an empty set and link with nothing. Documents link when 100 times
    their sets' intersection is at least ``percent`` times the union.
    ``class_id`` is the smallest id with an equal set, ``component_id`` the
    smallest that links lead to; for an empty set or a null id the id itself.
    ``n_links`` is the number of other ids that the document links with, copies
    included. Sets are compared by 64-bit hashes of shingles and 128-bit hashes of
    sets. Rows that repeat an id must repeat its text; together they are one document.
    """
    heads, by_class, sets, entries = matrix(docs, n, percent, id_col, text_col)

    head = F.min(F.struct("pos", "rep", "size"))
    lead = cut(entries.groupBy("shingle").agg(head.alias("x"), F.count(F.lit(1)).alias("n")).where("n > 1"), "lead")
    starred = beside(entries.select("shingle", F.struct("pos", "rep", "size").alias("y")), lead, "shingle", "n")
    starred = starred.where((F.col("x.rep") != F.col("y.rep")) & within_bounds("x", "y", percent))
    ends = [F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")]
    stars = cut(starred.select(*ends).distinct(), "stars")
    links = cut(linked(stars, sets, percent), "links")
    labels = components(links)

    at = cut(entries.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep")), "labelled")
    several = at.groupBy("shingle").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min("size").alias("least"), F.count(F.lit(1)).alias("n")).where("low < high")
    mixed = beside(at, cut(several.select("shingle", "least", "n"), "several"), "shingle", "n").drop("n")
    # as the larger of a pair a row meets partners no longer than this bound; the smaller one keeps the size
    reach = F.floor((F.col("size") - F.col("pos")) * F.lit(100 + percent) / F.lit(percent)) - F.col("size")
    mixed = cut(mixed.withColumn("reach", reach).where("reach >= least").drop("least"), "mixed")
    met = mixed.alias("x").join(
        mixed.alias("y"),
        (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.label") != F.col("y.label"))
        & ((F.col("x.size") > F.col("y.size")) | ((F.col("x.size") == F.col("y.size")) & (F.col("x.rep") < F.col("y.rep"))))
        & (F.col("y.size") <= F.col("x.reach")) & (F.col("x.size") <= F.col("y.reach")) & (F.col("y.size") * 100 >= F.col("x.size") * percent),
    )
    rest = met.select(*ends).distinct().join(stars, ["a", "b"], "left_anti")
    more = cut(linked(rest, sets, percent), "links")
    if not more.isEmpty():
        labels = components(links.union(more))

    whole = heads.where("n_shingles > 0 and doc_id is not null")
    alone = heads.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"))
    classes = by_class.join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left").select("class_a", "class_b", "rep", F.coalesce("label", "rep").alias("label"))
    if not counted:
        return with_classes(whole, classes).unionByName(alone)
    sizes = whole.groupBy("class_a", "class_b").agg(F.count_distinct("doc_id").alias("members"))
    classes = cut(classes.join(sizes, ["class_a", "class_b"]), "members")
    others = link_counts(classes.select("rep", "label", "members"), sets, percent)
    classes = classes.join(others, "rep", "left").withColumn("n_links", F.col("members") - 1 + F.coalesce("n", F.lit(0)))
    return with_classes(whole, classes, "n_links").unionByName(alone.withColumn("n_links", F.lit(0).cast("long")))


def jaccard_links(docs: DataFrame, n: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs``: doc_id, class_id and n_links, as :func:`jaccard_classes` has them."""
    return jaccard_classes(docs, n, percent, id_col, text_col).select("doc_id", "class_id", "n_links")


def with_classes(heads: DataFrame, classes: DataFrame, *more: str) -> DataFrame:
    """Each document with its class's ids; a class of very many copies is one row on the other side, so Spark can split it."""
    return heads.join(classes, ["class_a", "class_b"]).select("doc_id", "n_shingles", F.col("rep").alias("class_id"), F.col("label").alias("component_id"), *more)
