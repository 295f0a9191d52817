import os

import pytest

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")

LONG = " ".join(f"w{i % 977}" for i in range(60000))
ODD_TEXTS = [None, "", " \t\n", "one", LONG, "á ñ\x0b漢字 \r\n\n x", "same text here twice", "same text here twice", "a\x00b \u2028 c"]


@pytest.fixture
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, ties, an extra column with a clashing name."""
    rows = [(i, t, "en", f"s{i % 2}", 1, "x") for i, t in enumerate(ODD_TEXTS)]
    rows += [rows[-1], (None, None, None, None, None, None), (None, "null id", None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")


@pytest.fixture
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture
def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")
