"""SentencePiece encoding against the library: ids, spans and text, with other character maps too."""

import hashlib
import itertools
import random

import pytest
import sentencepiece
from pyspark.sql import functions as F

from siftloom.llm import pieces, queries

PATH = queries.tokenizer_path(queries.PIECE_FILE)
SIGNS = [*"abcdefghij  \n\t.,▁éß漢😀\x00́  zyxтеst0123456789%ﬁ①ｱﾞÅ ２㌀​　\r", "the ", "  ", "    ", "ing", "<s>", "</s>", "<unk>", "<0x0A>"]
HARD = ["", " ", "  ", "▁", "▁▁a", " ▁ b", "a" * 500, "ab" * 400, " " * 1000, "the " * 300, "x" * 5000, "漢" * 300, "　 a", " a "]


def texts(n, seed):
    r = random.Random(seed)
    return HARD + ["".join(r.choices(SIGNS, k=r.randint(1, 120))) for _ in range(n)]


def with_spec(mapping, prefix, squeeze):
    """The public pieces with another way to normalise."""

    def number(n):
        return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + number(n >> 7)

    def part(field, value):
        return number(field << 3 | 2) + number(len(value)) + value

    with open(PATH, "rb") as f:
        kept = b"".join(part(field, value) for field, value in pieces._fields(f.read()) if field != 3)
    return kept + part(3, part(2, mapping) + number(3 << 3) + number(prefix) + number(4 << 3) + number(squeeze))


@pytest.mark.parametrize(("rule", "prefix", "squeeze"), [("identity", 1, 0), ("identity", 0, 1), ("nfkc", 1, 0), ("nmt_nfkc", 1, 1), ("nmt_nfkc_cf", 0, 0)])
def test_ids_spans_and_text_as_the_library(rule, prefix, squeeze):
    spec = sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_normalizer_spec
    model = with_spec(dict(pieces._fields(spec() if callable(spec) else spec)).get(2, b""), prefix, squeeze)
    library, codec = sentencepiece.SentencePieceProcessor(model_proto=model), pieces.PieceCodec(pieces.parse_model(model))
    asked = texts(300, 5)
    for text, (ids, starts, ends) in zip(asked, codec.encode_batch(asked), strict=True):
        want = library.encode(text, return_type="proto").pieces
        assert [(p.id, p.begin, p.end) for p in want] == list(zip(ids.tolist(), starts.tolist(), ends.tolist(), strict=True)), text
        assert codec.decode(ids.tolist()) == library.decode(ids.tolist())


def test_any_ids_decode_as_in_the_library():
    library, codec = sentencepiece.SentencePieceProcessor(model_file=PATH), pieces.PieceCodec(pieces.load_model(PATH))
    r = random.Random(1)
    kinds = [0, 1, 2, 259, 260, 261, 262, *(3 + b for b in (0xC3, 0xA9, 0xE2, 0x96, 0x81, 0xF0, 0x9F, 0xED, 0xA0, 0x80, 32, 0xEF, 0xBF, 0xBD))]
    for _ in range(3000):
        ids = r.choices(kinds, k=r.randint(0, 8))
        assert codec.decode(ids) == library.decode(ids), ids
    with pytest.raises(IndexError):
        codec.decode([-1])
    with pytest.raises(IndexError):
        codec.decode([32_000])


def test_long_words_merge_alike():
    codec = pieces.PieceCodec(pieces.load_model(PATH))
    r = random.Random(2)
    for _ in range(200):
        word = "".join(r.choices("aetn▁▁hors", k=r.randint(2, 200)))
        assert codec._merged_short(word) == codec._merged_long(word)


def test_query_is_the_librarys(spark):
    docs = spark.createDataFrame([(i, t, "x", [i]) for i, t in enumerate([None, *texts(60, 9), "long text. " * 40_000])] + [(None, "one", "y", None)] * 2, "doc_id long, text string, ids string, starts array<int>")
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)

    def digest(text):
        return hashlib.sha256(text.encode()).hexdigest()

    def want(text):
        ids = library.encode(text or "")
        return len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids))

    got = pieces.digests(docs, PATH)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(((r.doc_id, *want(r.text)) for r in docs.collect()), key=key)
    assert pieces.digests(docs.limit(0), PATH).count() == 0


def test_spans_cover_the_text_and_decode_gives_it_back(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["plain words here", "漢字 and é", "", None])], "doc_id long, text string")
    found = pieces.encode(docs, PATH)
    for r in found.join(docs, "doc_id").collect():
        data = (r.text or "").encode()
        assert b"".join(data[a:b] for a, b in zip(r.starts, r.ends, strict=True)) == data
    back = {r.doc_id: r.decoded for r in pieces.decode(found.select("doc_id", "ids"), PATH).collect()}
    assert back == {0: "plain words here", 1: "漢字 and é", 2: "", 3: ""}
    assert [r.decoded for r in pieces.decode(found.select(F.lit(None).cast("array<int>").alias("ids")), PATH).collect()] == [""] * 4


def test_other_kinds_of_models_are_refused():
    with pytest.raises(ValueError, match="not a BPE model"):
        pieces.parse_model(b"")
    assert len(list(itertools.islice(pieces._fields(with_spec(b"", 1, 0)), 5))) == 5
