"""Collocations against plain counters."""

import random
import re
from collections import Counter

import pytest

from terradelta.llm import collocations
from terradelta.llm.collocations import collocations as find

SCHEMA = "doc_id long, text string, lang string, next string, n int, f int"


def brute(rows, least, longest, scale, first):
    f, n = Counter(), Counter()
    for r in rows:
        lang = "und" if r[2] is None else r[2]
        text = "".join(c.lower() if c.isascii() else c for c in r[1] or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                for i in range(len(w) - m + 1):
                    f[lang, tuple(w[i : i + m])] += 1
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    gone = set()
    for (lang, p), b in found.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                if 100 * b >= 80 * found[lang, p[i : i + m]]:
                    gone.add((lang, p[i : i + m]))
    out = []
    for (lang, p), a in found.items():
        if (lang, p) not in gone:
            cuts = [(scale * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            out.append((lang, -score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]], n[lang]))
    ranks, rows = Counter(), []
    for lang, score, a, p, left, right, total in sorted(out):
        ranks[lang] += 1
        if ranks[lang] <= first:
            rows.append((lang, ranks[lang], p.decode(), -a, left, right, total, -score))
    return rows


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    common = ["The", "of", "and", "New", "York", "times", "é", "Ünd", "x\x00y", "\xa0", "\u3000w", "\x1c", "\U0001f600", "\uffee"]
    said = ["in the long run", "new york city hall", "a b c d e", "É É É É", "one two three"]
    rows = []
    for n in range(160):
        words = []
        for _ in range(rng.randrange(0, 60)):
            words.append(rng.choice(said) if rng.random() < 0.3 else rng.choice(common) if rng.random() < 0.6 else f"w{rng.randrange(300)}")
            words.append(rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "!? ", "\x0b", "\r\n", ";:", "\x0c"]))
        rows.append((n, "".join(words), ["en", "de", None, "und", ""][n % 5] if n % 3 else "en", "a", 1, 2))
    rows += [(1, None, "en", None, None, None), (2, "", None, None, None, None), (3, " \t.\n", "fr", None, None, None), (4, "the " * 5000 + "end", "en", None, None, None), (5, "hot hot cold " * 2000, "hot", None, None, None)]
    return [*rows, rows[0], rows[0], (None, rows[5][1], "en", None, None, None)]


@pytest.mark.parametrize("small", [False, True])
def test_against_counters(spark, texts, monkeypatch, small):
    if small:  # many flushes, a filter that tells little, stripes cut in parts
        monkeypatch.setattr(collocations, "CHARS", 3000)
        monkeypatch.setattr(collocations, "FILTER_BITS", 1 << 8)
        monkeypatch.setattr(collocations, "HOT", 10**9)
    docs = spark.createDataFrame(texts, SCHEMA).repartition(5)
    for least, longest, scale, first in ((5, 4, 2_000_000, 2000), (9, 3, 1000, 7)):
        got = find(docs, least=least, longest=longest, scale=scale, first=first)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(map(tuple, got.collect())) == sorted(brute(texts, least, longest, scale, first))


def test_nothing(spark, texts):
    assert find(spark.createDataFrame([], SCHEMA)).count() == 0
    assert find(spark.createDataFrame([(1, None, "en", None, None, None), (2, "one word", "en", None, None, None)], SCHEMA)).count() == 0


def test_a_filter_keeps_rare_phrases_out_of_stripes(spark):
    docs = spark.createDataFrame([(n, f"rare{n} other{n} red car red car", "en", None, None, None) for n in range(40)], SCHEMA)
    every = {(r.m, r.phrase): r.f for r in collocations.frequent_phrases(docs, least=30, longest=3).collect()}
    assert every == {(0, ""): 240, (1, "red"): 80, (1, "car"): 80, (2, "red car"): 80, (2, "car red"): 40, (3, "red car red"): 40, (3, "car red car"): 40}
    bits = [collocations.filter_of(spark.createDataFrame([("en", "red"), ("en", "car")], "lang string, phrase string"))]
    texts = docs.selectExpr("CAST(lang AS BINARY) AS lang", "CAST(text AS BINARY) AS text")
    made = collocations.stripes(collocations.number_words(texts), bits, set()).collect()
    assert {(r.prefix, w) for r in made for w in r.next.split(" ")} == {("red", "car"), ("car", "red")}
