from __future__ import annotations

import pytest

from wardwatch.session import local_session

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def spark():
    return local_session(4, "tests", shuffle_partitions=4)


@pytest.fixture
def docs_of(spark):
    """Documents of (doc_id, text[, lang]) tuples, over three partitions."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, DOCS).repartition(3) if full else spark.createDataFrame([], DOCS)

    return make
