import pytest
from pyspark.sql import Row


@pytest.fixture()
def docs_of(spark):
    """A documents table from (doc_id, text) pairs, with an extra column whose name an operator might use itself."""

    def make(rows, **more):
        schema = "doc_id long, text string, lang string, source string, n_chars long, score string"
        return spark.createDataFrame([Row(doc_id=i, text=t, lang="en", source=more.get("source", {}).get(i, f"s{(i or 0) % 3}"), n_chars=None if t is None else len(t), score="x") for i, t in rows], schema)

    return make
