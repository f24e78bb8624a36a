from __future__ import annotations

import pytest

DDL = "doc_id long, text string, lang string, source string, n_chars long, place string, fp string, w string"


@pytest.fixture
def docs(spark):
    """Documents from ``(id, text)`` pairs, with extra columns whose names operators use inside."""

    def build(rows):
        return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "p", "f", "w") for i, t in rows], DDL)

    return build
