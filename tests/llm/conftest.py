import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns of a user that have the names that operators use themselves, and types that can't be compared.
NAMES = "size key h g rank first kept _key _ls start copies _rid rid distance fp row lines exact near k1 k2 no root found _w _s _at leaf".split()
CLASHES = [*[f"'{x}' AS {x}" for x in NAMES], "map('a', doc_id) AS tags", "named_struct('text', 7) AS `a.b`"]


@pytest.fixture
def docs(spark):
    """A table of documents from (doc_id, text) or longer tuples, with columns that clash by name."""

    def make(rows, extra=True):
        full = [(*r, *("en", "s", len(r[1] or ""))[len(r) - 2 :])[:5] for r in rows]
        df = spark.createDataFrame(full, DOCS)
        return df.selectExpr("*", *CLASHES) if extra else df

    return make
