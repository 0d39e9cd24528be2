import pytest

LONG = " ".join(f"lang{i % 97} wort{i % 89} tal{i % 83}" for i in range(30_000))
PHRASE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, one id with two texts, clashing extra columns."""
    rows = [
        (1, "The words of one plain text, here.", "en", "a", 34), (2, "The words of one plain text, here.", "en", "a", 34), (2, "The words of one plain text, here.", "en", "a", 34), (3, None, "en", "a", None),
        (4, "", None, None, 0), (None, "no id but words enough to read", "en", None, 1), (None, None, None, None, None), (5, "   \n\t \n", "en", "b", 7), (6, LONG, "en", "b", len(LONG)), (7, f"x {PHRASE.upper()} y", "en", "c", 1),
        (7, "another text of the same id", "en", "c", 1), (8, "1234 5678 !!", "en", "c", 1), (9, "un", "fr", "c", 2), (10, "é́ ß \U0001f600\x00 İ", "fr", "c", 2),
    ]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, text_key string, rid int, removed_lines int, gone_id int, of_key int, score double, words string"
    return spark.createDataFrame([(*r, "clash", 1, 2, 3, 4, 0.5, "w") for r in rows], schema)


@pytest.fixture(scope="session")
def no_docs(spark, odd_docs):
    return spark.createDataFrame([], odd_docs.schema)


@pytest.fixture(scope="session")
def items(spark):
    return spark.createDataFrame([(1, PHRASE), (2, "plain TEXT here"), (3, None), (4, ""), (None, "un"), (5, "no such words in any of the documents at all, none")], "item_id bigint, text string")


def write_tables(spark, folder, **tables):
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)
