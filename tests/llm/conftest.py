import pytest

LONG = " ".join(f"word{i % 977} of the long text" for i in range(8000))
CLASHING = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, predicted string, fp string, " \
           "block string, term string, lang_pred string, piece string, held_out string, text_hash string, length string, " \
           "_doc string, _hash string, _llm_fp string, _llm_row string, _llm_lang_pred string, _llm_score string, _llm_known_share string"


def rows(pairs):
    """Documents with every clashing column from (doc_id, text, lang)."""
    return [(i, t, lang, "s", None if t is None else len(t), *["x"] * 17) for i, t, lang in pairs]


EDGE = [(1, None, "en"), (2, "", "en"), (3, " \n\t", "de"), (4, LONG, "en"), (5, "the same text twice and again", "en"),
        (5, "the same text twice and again", "en"), (6, "the same text twice and again", None), (None, "a row without an id", "de"),
        (7, "漢字かな交じり文 \U0001f600 é", "ja"), (8, "... 123 !!", "en"), (9, "kurzer deutscher Satz über Würste", "de")]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls, empty and long texts, repeated rows, an id twice, and extra columns whose names clash with results."""
    return spark.createDataFrame(rows(EDGE), CLASHING)


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], CLASHING)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet").cache()


@pytest.fixture(scope="session")
def texts(documents):
    """doc_id -> text of the small documents table."""
    return {r["doc_id"]: r["text"] for r in documents.select("doc_id", "text").collect()}
