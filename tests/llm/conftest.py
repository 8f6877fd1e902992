"""Small tables for the training-data operators: hand-made awkward rows, and a slice of invented prose."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, words=400):
    def rare(k):
        return "".join(chr(97 + k // 26 ** d % 26) for d in range(4)) + "er"
    return " ".join(rng.choice(["the", "of", "and", "to", "in"]) if rng.random() < 0.4 else rare(rng.randrange(words)) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Nulls in every column, empty and very long texts, blanks of all kinds, repeated rows and ids, near copies."""
    rng = random.Random(5)
    base = [prose(rng, 120) for _ in range(12)]
    edited = []
    for text in base[:4]:
        for k in range(6):
            words = text.split(" ")
            for _ in range(k):
                words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
            edited.append(" ".join(words))
    texts = [*base, *edited, *([base[5]] * 15), "", None, " \t\n\v\f\r ", "one", "One  two", "one two three", "\n\n", "ÄÖ ÜB é x ſ K",
             "Common Line\nrare one", *[f" common line \nown {i}\n" for i in range(12)], prose(rng, 60_000, 40_000), "x" * 300_000,
             "\n".join(["again and again"] * 3000)]
    out = [(i, t, "en", f"s{i % 3}", len(t) if t is not None else None) for i, t in enumerate(texts)]
    out += [out[0], out[13], (None, base[1], None, None, None), (None, None, None, None, None), (200, None, "en", None, 0),
            (201, base[2] + " tail", None, "s1", None), (7, base[3], "en", "s2", 5)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows, with extra columns whose names the operators use themselves."""
    from pyspark.sql import functions as F
    names = ["key", "v", "comp", "held", "bench_row", "line_key", "line_text", "mix_size", "n_words", "hit", "score", "y", "stats", "block", "turn"]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return df.select("*", *[F.lit("extra").alias(n) for n in names])


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


SF = "/root/testdata/sf0.001"
