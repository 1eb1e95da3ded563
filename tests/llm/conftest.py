import pytest

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long, score double, key string, tokens string"


@pytest.fixture(scope="session")
def documents(spark):
    """Documents with nulls in every column, repeated rows, ties, very short and very long texts.

    The last columns have names that operators use for columns of their own.
    """
    words = "the quick brown fox and a lazy dog of the old town went to sea for some more bread".split()

    def text(seed, n):
        return " ".join(words[(seed * 7 + k * k + k * seed) % len(words)] for k in range(n))

    rows = [
        (1, text(1, 120), "en"),
        (2, text(1, 119) + " Change", "en"),
        (3, text(1, 120).upper(), None),
        (4, text(2, 90) + "\n" + text(2, 90), "en"),
        (5, None, "en"),
        (6, "", "fr"),
        (7, "  \n\t ", None),
        (8, "le chat de la maison et des amis que une porte " * 9, "fr"),
        (9, "word", "en"),
        (10, "word", "en"),
        (11, "12 345 !!! ???", "xx"),
        (12, text(3, 400) + " x" * 4000 + " " + "y" * 3000, "en"),
        (12, text(5, 60), "en"),
        (13, " ".join(f"z{k}" for k in range(60)), "en"),
        (13, " ".join(f"z{k}" for k in range(60)), "en"),
        (None, text(1, 120), None),
        (14, "mail a.b@mail.example.org or +1 (555) 010-0199 from 10.0.0.255 with 4111 1111 1111 1111 now", "en"),
        (15, "日本語 のテキスト 🙂 <|endoftext|> ñandú ß", None),
    ]
    full = [(i, t, lang, None if k % 3 else f"s{k}", None if t is None else len(t), None, None, "x") for k, (i, t, lang) in enumerate(rows)]
    return spark.createDataFrame(full, DOCUMENT)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], DOCUMENT)
