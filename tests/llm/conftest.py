import os
import tempfile

import pytest


@pytest.fixture(scope="session", autouse=True)
def checkpoints(spark):
    """A shared folder for the operators' tables, as a cluster names one."""
    with tempfile.TemporaryDirectory(prefix="llm-tests-") as folder:
        spark.sparkContext.setCheckpointDir(folder)
        yield os.path.realpath(folder)


@pytest.fixture
def docs(spark):
    """A function from texts, or tuples with more columns, to a table of documents."""

    def make(rows):
        full = []
        for i, row in enumerate(rows):
            if isinstance(row, str) or row is None:
                row = (i, row)
            doc_id, text, lang, source = (*row, *("en", f"s{i % 3}")[len(row) - 2 :]) if len(row) < 4 else row
            full.append((doc_id, text, lang, source, len(text or ""), "clash"))
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, id string")

    return make
