import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, th string, row string, runs int"


def prose(rng, n):
    return " ".join(rng.choice("aeiou") + rng.choice("bcdfg") + str(rng.randrange(400)) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Documents with every hard case: nulls in any column, empty and very long texts, copies, repeated rows, ties,
    repeated lines and passages, one hot source, extra columns with names that operators use inside."""
    rng = random.Random(5)
    passage = prose(rng, 60)
    license_line = "This text is free for all to use and to share again."
    texts = [prose(rng, rng.randrange(1, 120)) for _ in range(60)]
    texts += [f"{prose(rng, 30)}\n{passage}\n{prose(rng, 20)}" for _ in range(6)]
    texts += [f"{license_line}\n{prose(rng, 40)}\n\n{license_line}\nyes" for _ in range(5)]
    texts += [texts[3], texts[3], texts[3], texts[64], texts[64] + " tail"]
    long = prose(rng, 9000).split(" ")
    texts += [" ".join(long), " ".join([*long[:4000], "changed", *long[4001:]]), "a a a a a a a a a a " * 12, "same line of words that repeats itself over and over\n" * 6]
    texts += ["", "", None, None, "   \n\t ", "\n\n", "one", "Zß Éa zß ÉA", "tab\tnew\x0bline\x0c \xa0nbsp", " ".join(["x"] * 34), " ".join(["y"] * 35), " ".join(["z"] * 36), "\x00 \x1c \x01 " * 20]
    out = [(n, t, "en", "hot" if n % 3 else f"s{n % 5}", len(t) if t else None, n * 7, "th", "row", 1) for n, t in enumerate(texts)]
    out += [(5, texts[5], None, None, None, None, None, None, None), (5, texts[5], None, None, None, None, None, None, None)]
    out += [(7, "another text under a number that is taken " * 3, "en", None, None, None, None, None, None), (None, prose(rng, 50), None, "s1", None, None, None, None, None), (None, texts[6], None, None, None, None, None, None, None), (-3, texts[6], "de", "s2", 3, None, None, None, None)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
