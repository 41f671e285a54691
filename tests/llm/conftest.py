from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, stats int, part int, key string, label int"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang, source), with extra columns whose names the operators use inside."""

    def docs(rows):
        full = [(r[0], r[1], *(r[2:4] if len(r) > 2 else ("en", "s")), len(r[1] or ""), 1, 2, "k", 3) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return docs


EDGE = [(3, "a b c d e f g h i j"), (None, "x y z"), (1, None), (2, ""), (2, ""), (5, " \n\t "), (7, "long " * 30000), (8, "é ñ 漢字 \U0001f600 end")]
