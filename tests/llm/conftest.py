import pytest


@pytest.fixture(scope="session")
def ready(spark):
    from tillcast.llm.common import ship_package
    from tillcast.session import checkpoint_dir
    ship_package(spark)
    checkpoint_dir(spark)
    return spark


ODD_DOCS = [
    # doc_id, text, lang, source, n_chars, size, sig, row: extra columns with clashing names
    (1, None, "en", "a", None, 1, "x", 0), (2, "", None, "a", 0, 1, None, 0), (3, " \n\t ", "en", None, 4, 1, "x", 0),
    (4, "one two three four five six seven eight nine ten", "en", "a", 48, 1, "x", 0),
    (5, "one  two three four five six seven eight nine\nten", "en", "b", 49, 1, "x", 0),
    (5, "one  two three four five six seven eight nine\nten", "en", "b", 49, 1, "x", 0),
    (None, "a row without an id", None, None, 19, None, None, None),
    (6, "long " * 30000 + "ends <|endoftext|> here é\U0001f642", "en", "b", 150020, 1, "x", 0),
    (7, "Rep rep rep\nline one\nline one\n<|im_end|> | ###", "de", "b", 45, 1, "x", 0),
]
ODD_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, sig string, row int"


@pytest.fixture(scope="session")
def odd(ready):
    return ready.createDataFrame(ODD_DOCS, ODD_SCHEMA)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)
