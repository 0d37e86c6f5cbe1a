import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(seed: int, n: int, words: int = 400) -> str:
    rng = random.Random(seed)
    vocabulary = ["".join(random.Random(i).choice("aeioubcdfgklmnprst") for _ in range(2 + i % 7)) for i in range(words)]
    return " ".join(rng.choice(vocabulary) for _ in range(n))


def edited(text: str, seed: int, share: float) -> str:
    rng = random.Random(seed)
    return " ".join("changed" + str(rng.randrange(10**6)) if rng.random() < share else w for w in text.split(" "))


ROWS = [
    (1, prose(1, 300), "en", "a", 1), (2, prose(1, 300), "en", "b", 2), (3, edited(prose(1, 300), 5, 0.05), "en", "a", 3), (4, prose(4, 200), "de", "a", 4),
    (5, None, "en", "b", None), (6, "", None, None, 0), (7, " \n\t", "fr", "b", 3), (8, "...!!", None, "a", 5), (9, "one", "en", None, 3), (10, "One", "en", "b", 3),
    (11, prose(11, 20000, 5000), "en", "a", 9), (12, "née Ünï 日本語 \x00 tab\tend  two  spaces ", "fr", "c", 1), (None, "no id here at all", "en", "a", 1), (4, prose(4, 200), "de", "a", 4),
    (13, edited(prose(4, 200), 3, 0.08), None, "a", 1), (14, prose(14, 250), "es", "b", 1),
]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(spark, docs):
    """Extra columns of every name that the operators' source has as a literal,
    alone and after the prefix of their own columns."""
    import glob
    import os
    import re

    from pyspark.sql import functions as F

    names = set()
    for path in [*glob.glob(os.path.join(os.path.dirname(__file__), "../../quern/llm/*.py")), os.path.join(os.path.dirname(__file__), "../../quern/session.py")]:
        with open(path) as f:
            names |= {x.lower() for x in re.findall(r"""["']([A-Za-z_][A-Za-z0-9_]{0,24})["']""", f.read())}
    names = {n for n in names | {"__quern_" + n.removeprefix("__quern_") for n in names}} - {c.lower() for c in docs.columns}
    return docs.select("*", *(F.lit("x").alias(n) for n in sorted(names)))
