import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __qr_text string, component string"


@pytest.fixture(scope="session")
def rows():
    """Nulls in each column, empty, blank and long texts, repeated rows, ties, near copies."""
    rnd = random.Random(4)
    words = ["alpha", "beta", "Gamma", "delta", "épsilon", "zeta", "eta", "theta", "iota", "kappa", "lambda", "mu"]
    line = lambda n: " ".join(rnd.choice(words) + rnd.choice("aeiouxyz") + rnd.choice("nrst") for _ in range(n))
    out = [(i, "\n".join(line(25) for _ in range(4)), "en", f"s{i % 3}", 1) for i in range(24)]
    out += [(100, None, None, None, None), (101, "", "en", "s0", 0), (102, " \t\n ", "en", "s1", 4), (103, "one", "en", "s1", 3), (None, "no id here", "en", "s2", 1)]
    out += [(104, line(6000), "en", "s0", 1), (105, out[0][1], "en", "s1", 1), (106, out[1][1] + " more", "fr", "s2", 1), (107, "word " * 60, "en", "s0", 1)]
    out += [(108, out[2][1], "en", "s0", 1), (108, out[2][1], "en", "s0", 1), (109, "<|endoftext|>It's ΣΑΣ x  y\n\n z ", None, "s0", 2)]
    near = out[3][1].split("\n")
    out += [(110, "\n".join([near[0] + " extra", *near[1:]]), "en", "s0", 1)]
    return [(*r, "clash", "clash") for r in out]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
