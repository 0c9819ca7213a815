import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in each column, empty and very long texts, repeated rows, odd characters and clashing columns."""
    texts = [
        (1, "Of the people and the land there is a long story to be told here. " * 3, "en", "s", 10),
        (1, "Of the people and the land there is a long story to be told here. " * 3, "en", "s", 10),
        (2, None, "en", None, None),
        (3, "", None, "s", 0),
        (None, "der die das und ist nicht ein Haus", "de", "s", 3),
        (4, "word " * 40_000, "en", "s", 5),
        (5, "x" * 150_000, "en", "s", 5),
        (6, " \n\t ", "en", "s", 5),
        (7, "🙂 emoji\x85 é ß <|endoftext|> mail me@example.com or 4111 1111 1111 1111", "de", "s", 5),
        (8, "12345 67890", None, "s", 5),
        (9, "Le chat et la souris sont dans la maison", "fr", "s", 5),
    ]
    df = spark.createDataFrame(texts, SCHEMA)
    for extra in ("id", "fp", "word", "n_tokens", "score", "row", "component_id", "leftover", "bits"):
        df = df.selectExpr("*", f"'clash' as {extra}")
    return df


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")
