import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, size int, fp string"

#: Nulls, empty and long texts, ties, repeated rows and extra columns with clashing names.
ROWS = [
    (1, "Mail a.b@c.example.org or +1 (555) 010-9999 now", "en", "s1", 1, "x"),
    (2, None, "en", "s1", 2, None),
    (3, "", None, None, 3, "y"),
    (4, " \t\n", "fr", "s2", 4, "y"),
    (5, "the cat sat on the mat and the dog sat on the log", "en", "s2", 5, "z"),
    (6, "the cat sat on the mat and  the dog sat on the log", "en", "s2", 6, "z"),
    (7, "the cat sat on the mat and the dog sat on the log", "en", None, 7, "z"),
    (7, "the cat sat on the mat and the dog sat on the log", "en", None, 7, "z"),
    (None, "le chat est sur la table et le chien est dans la rue", "fr", "s1", None, None),
    (9, "le chat est sur la table et le chien est dans la rue", "fr", "s3", None, None),
    (10, "1234 5678 $$ 9", "de", "s3", 0, ""),
    (11, "word " * 5000 + "end", "en", "s3", 0, ""),
    (12, "é中\U0001f600 a b\x1cc", None, "sé", 0, ""),
    (-13, "x" * 100000, "en", "s1", 0, ""),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
