import pytest

from claimspark.llm.common import workers_find_package


@pytest.fixture(scope="session", autouse=True)
def _workers(spark):
    workers_find_package(spark)


DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture()
def docs(spark):
    def make(rows, schema=DOCS):
        """Rows are (doc_id, text) or (doc_id, text, lang, source)."""
        full = [(*r, "en", "src0")[:4] for r in rows]
        return spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None) for r in full], schema)
    return make
