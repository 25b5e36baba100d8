"""Collocations against counting every phrase, with small bounds so that every path is taken."""

import random
import re
from collections import Counter
from itertools import pairwise

import pytest

from siftloom.llm import collocations
from siftloom.llm.common import cut

LOWER = {c: c + 32 for c in range(65, 91)}


def pieces(text):
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER))]


def brute_counts(rows, size):
    found = {}
    for lang, text in rows:
        f = found.setdefault(lang or "und", Counter())
        for w in pieces(text):
            f.update(tuple(w[i : i + k]) for k in range(1, size + 1) for i in range(len(w) - k + 1))
    return found


def brute(rows, least, size=4, top=2000):
    out = []
    for lang, f in brute_counts(rows, size).items():
        n = sum(c for g, c in f.items() if len(g) == 1)
        frequent = {g: c for g, c in f.items() if len(g) > 1 and c >= least}
        inside = {}
        for g, c in frequent.items():
            for k in range(2, len(g)):
                for i in range(len(g) - k + 1):
                    inside[g[i : i + k]] = max(inside.get(g[i : i + k], 0), c)
        scored = []
        for g, a in frequent.items():
            if 100 * inside.get(g, 0) >= 80 * a:
                continue
            score, _, left, right = min((2_000_000 * a // (f[g[:k]] + f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
            scored.append((-score, -a, " ".join(g).encode(), left, right))
        for i, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, i, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    vocabulary = ["the", "The", "of", "a", "b", "c", "été", "漢", "x1", "no-break word", "w" * 100, "\x00", *(f"rare{i}" for i in range(40))]
    weights = [20, 5, 12, 9, 8, 7, 5, 5, 4, 3, 2, 2, *[0.3] * 40]
    found = [("en", None), (None, None), ("en", ""), ("en", " ,.;\n\t "), ("en", "one"), ("fr", "the the the the the the the"), (None, "of the of the of the. of the")]
    for _ in range(150):
        text = "".join(w + r.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\x0b"]) for w in r.choices(vocabulary, weights, k=r.randint(0, 60)))
        found.append((r.choice(["en", "en", "en", "fr", None, "und"]), text))
    return found + found[10:40] + [("en", "common line of the page. " * 400)]


def table(spark, rows):
    return spark.createDataFrame([(i, text, lang, "p", 1) for i, (lang, text) in enumerate(rows)], "doc_id long, text string, lang string, phrase string, n int").repartition(3)


@pytest.mark.parametrize(("least", "size", "limit", "share"), [(5, 4, 400_000, 1024), (5, 4, 3, 8), (2, 3, 0, 1024), (3, 5, 6, 2)])
def test_as_brute_force(spark, rows, monkeypatch, least, size, limit, share):
    monkeypatch.setattr(collocations, "SHARE", share)
    got = collocations.collocations(table(spark, rows), least, size, limit=limit)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = brute(rows, least, size)
    assert len(want) > 50
    assert sorted(map(tuple, got.collect())) == want
    if limit == 3:
        assert sorted(map(tuple, collocations.collocations(table(spark, rows), least, size, top=7, limit=limit).collect())) == brute(rows, least, size, 7)


def test_counts_that_are_handed_on_in_parts(spark, rows):
    docs = table(spark, [(lang or "und", text) for lang, text in rows if text is not None]).select("lang", "text")
    counts = cut(collocations.word_counts(docs))
    want = {(lang, " ".join(g)): n for lang, f in brute_counts([r for r in rows if r[1] is not None], 4).items() for g, n in f.items() if len(g) > 1 and n >= 4}
    found = collocations.mined(collocations.fragments(docs, counts, 4, 4, 100, held_most=10), 4, 4, held_most=10)
    assert {(r.lang, r.phrase): r.a for r in found.collect()} == want
    assert {(r.lang, r.word): r.n for r in counts.collect()} == {(lang, g[0]): n for lang, f in brute_counts(rows, 1).items() for g, n in f.items()}


def test_an_occurrence_reaches_one_pivot():
    r = random.Random(4)
    for _ in range(200):
        tokens = [r.choice([b"a", b"b", b"c", b"d", b"."]) for _ in range(r.randint(1, 30))]
        order = {b"a": 1, b"b": 2, b"c": 3, b".": -1} | ({b"d": 4} if r.random() < 0.5 else {})
        whole = r.random() < 0.5
        left, right = collocations.reaches(tokens, order, whole, 3, 4)
        got = Counter()
        for i, (a, b) in enumerate(zip(left.tolist(), right.tolist(), strict=True)):
            got.update(collocations.owned(b" ".join(tokens[i - a : i + b + 1]), a, 4))
        out = {b"."} | ({b"d"} if whole and b"d" not in order else set())
        ends = [-1, *(i for i, t in enumerate(tokens) if t in out), len(tokens)]
        want = Counter(b" ".join(tokens[i : i + k]) for a, b in pairwise(ends) for k in (2, 3, 4) for i in range(a + 1, b - k + 1))
        assert got == want


def test_sums_beyond_64_bits(spark):
    big = 4_000_000_000_000_000_000
    found = spark.createDataFrame([("en", "a b", 2, big), ("en", "a b c", 3, big // 5 * 4 - 1)], "lang string, phrase string, size int, a long")
    counts = spark.createDataFrame([("en", w, big + 7) for w in "abc"], "lang string, word string, n long")
    got = {r.phrase: (r.l, r.r, r.score) for r in collocations.scored(found, counts).collect()}
    assert got["a b"] == (big + 7, big + 7, 2_000_000 * big // (2 * big + 14))
    assert [r.phrase for r in collocations.without_contained(found).orderBy("phrase").collect()] == ["a b", "a b c"]
    assert [r.phrase for r in collocations.without_contained(found.withColumn("a", found.a + (found["size"] == 3).cast("int"))).collect()] == ["a b c"]


def test_empty_and_refused(spark, rows):
    assert collocations.collocations(table(spark, rows).limit(0)).count() == 0
    assert collocations.collocations(table(spark, rows[:6])).count() == 0
    with pytest.raises(ValueError, match="2 to 8"):
        collocations.collocations(table(spark, rows), size=9)
