"""Fixtures of the training-data operators: small tables with every odd case, and plain-Python versions of what they share."""

import re

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
CLASHES = ["digest", "bands", "node", "root", "key", "n", "word", "row", "ids", "terms", "of", "score", "kind", "part", "window", "tie", "_toxicity", "_kept_id", "_leak", "_of", "_to"]


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls, empty and blank texts, one word, ties, repeated rows, other white space, other alphabets, special strings, a long text, clashing columns."""
    base = "the quick brown fox jumps over the lazy dog near the river bank"
    rows = [
        (1, base), (2, base), (3, base.upper()), (4, base + " today"), (5, ""), (6, " \t\n"), (7, None), (8, "word"), (9, "Word"), (10, "two words"),
        (10, "two words"), (11, "one text"), (11, "another text of this id"), (None, "no id at all here my friend"), (None, None),
        (12, "tab\tand\x0bvertical\x0cform\rreturn\nline nbsp wide"), (13, "Straße İstanbul ﬁne 漢字かな 🙂 é é"), (14, "<|endoftext|> and <|startoftext|> inside"), (15, "x" * 5000), (16, "don't we're 12345 $%&* it's   "),
        (17, " ".join(f"w{i % 977}" for i in range(60_000))), (18, "\x00zero\x00"),
    ]
    df = spark.createDataFrame([(i, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else f"s{k % 3}", None) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("clash") for c in CLASHES})


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def shingle_set(text, width=5):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < width else (tuple(w[k : k + width]) for k in range(len(w) - width + 1)))


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def ordered(rows):
    return sorted(rows, key=lambda r: [(x is not None, x) for x in r])
