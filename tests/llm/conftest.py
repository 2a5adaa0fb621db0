import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))


@pytest.fixture(scope="session")
def docs_of(spark):
    """A table of documents from (doc_id, text[, lang[, source]]) tuples, with an extra column of a clashing name."""

    def make(*rows):
        full = [(*r, *("en", "s0")[len(r) - 2 :]) if len(r) < 4 else r for r in rows]
        return spark.createDataFrame([(*r, 7) for r in full], "doc_id long, text string, lang string, source string, id int")

    return make
