import random
import re

import pytest

SF = "/root/testdata/sf0.001"
SPACES = re.compile("[^\x20\x09-\x0d]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return SPACES.findall(text or "")


def shingle_set(text, width):
    w = words(lower(text))
    if not w:
        return set()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)}


DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
CLASHES = ("part", "rep", "value", "score", "slot", "shard", "share", "tokens", "held", "hashed", "group", "key", "topic", "rate", "kept", "component_id")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, repeated rows, ties, and extra columns with clashing names."""
    rng = random.Random(3)
    long = " ".join(f"w{rng.randint(0, 5000)}" for _ in range(150_000))
    text = " ".join(f"t{rng.randint(0, 400)}" for _ in range(120))
    rows = [
        (1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n\t ", "en", "s", 4), (4, "one", "en", "s", 3), (5, long, "en", "s", len(long)),
        (6, text, "en", "s", 1), (6, text, "en", "s", 1), (7, text, "de", None, 1), (None, text, None, "s", 1), (None, "lonely words here", None, "s", 1),
        (8, text + " tail", "fr", "s", 1), (9, "ünï cödé \u2003 wörds\x00 x", "fr", "s", 1), (10, "one", "es", "s", -5),
    ]
    df = spark.createDataFrame(rows, DOCS)
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("clash") for c in CLASHES})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def small_docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def small_texts(small_docs):
    return {r["doc_id"]: r["text"] for r in small_docs.collect()}
