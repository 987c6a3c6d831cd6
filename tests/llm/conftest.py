import pytest


@pytest.fixture()
def documents(spark):
    """Frames of documents; a row is (doc_id, text) or (doc_id, text, lang, source)."""
    def build(rows):
        full = [(*r, *[None] * (4 - len(r)), None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return build
