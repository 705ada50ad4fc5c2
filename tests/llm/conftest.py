import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and blank texts, repeated rows and ids, separators of all kinds, and columns with clashing names."""
    long_ = " ".join(f"w{i}" for i in range(5000))
    run = " ".join(f"r{i}" for i in range(40))
    rows = [
        (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, run), (5, run), (6, f"lead {run} tail"), (None, run), (7, long_ + " " + long_),
        (8, "a b c\x0bd\x0ce\rf"), (9, " non breaking 日本語"), (10, "x " * 90), (11, " ".join(f"r{i}" for i in range(34))), (None, None), (12, "A b C d e"), (13, "a B c D E"),
    ]
    extra = [(i, t, "s", "s", 0, "fp") for i, t in rows]
    return spark.createDataFrame(extra, "doc_id long, text string, shard string, bucket string, owner int, fp string")
