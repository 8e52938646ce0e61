import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """A documents table from texts (ids from 0) or (id, text, source) rows, with columns that
    clash with names the operators use."""

    def make(rows):
        rows = [(i, r, "s0") if not isinstance(r, tuple) else r for i, r in enumerate(rows)]
        df = spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOCS)
        return df.selectExpr("*", "1L as slot", "'x' as key", "2 as n_words", "0.5D as score", "true as kept", "3L as token", "'y' as content")
    return make
