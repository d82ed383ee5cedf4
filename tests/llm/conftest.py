import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


@pytest.fixture
def docs(spark):
    """Rows of (doc_id, text) as documents, with columns whose names operators use inside."""

    def make(*rows):
        full = [(i, t, "en", f"src{(i or 0) % 3}", None if t is None else len(t), 1, "x") for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, fp long, _place string")

    return make
