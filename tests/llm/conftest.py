import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in every column, empty and long texts, repeated rows, equal ids, ties."""
    rng = random.Random(5)
    words = [" ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(80)) for _ in range(30)]
    rows = [(k, w, "en", f"s{k % 4}", len(w)) for k, w in enumerate(words)]
    rows += [(100, None, "en", "s0", None), (101, "", None, None, 0), (None, "a null id " * 12, "de", "s1", 1), (None, None, None, None, None)]
    rows += [rows[3], rows[3], (3, "another text with the same id", "fr", "s2", 5), (102, words[5], "en", "s3", 3), (103, words[5] + " tail", "en", "s3", 3)]
    rows += [(104, ("long " + words[7] + " ") * 300, "en", "s0", 9), (105, " \t\n ", "en", "s1", 4), (106, words[8][:300] + "\n" + words[9], "en", "s1", 4), (107, words[9] + "\n#*$ | <b> %%%", "en", "s2", 4)]
    rows += [(108, "é" * 500, "fr", "s2", 500), (109, "x" + "é" * 450, "fr", "s2", 451), (110, "The THE the the the " * 20, "en", "s0", 400)]
    return rows


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing_docs(edge_docs):
    """Extra columns with the names that operators use inside."""
    from pyspark.sql import functions as F

    extra = ["d", "tag", "fp", "spans", "_size", "_key", "target", "taken", "c0", "row", "score", "key", "ids", "_d", "_n", "stratum", "toxic", "quality", "y"]
    return edge_docs.select("*", *[F.lit(k).alias(c) for k, c in enumerate(extra)])


@pytest.fixture(scope="session")
def edge_labels(spark, edge_rows):
    rows = [(r[0], k % 2, int("#" in (r[1] or ""))) for k, r in enumerate(edge_rows)] + [(None, 1, 1), (7, None, None), (999, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
