import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, rid string, spans string, label string"


def prose(rng, n, alphabet="abcdefgh"):
    return [("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 5)))) for _ in range(n)]


def corpus(seed=0):
    """Copies, near copies, shared passages, repeats inside a text, odd white space, nulls, ties and repeated rows."""
    rng = random.Random(seed)
    passage, short = prose(rng, 70), prose(rng, 55)
    base = prose(rng, 150)
    texts = []
    for k in range(14):
        body = prose(rng, rng.choice([3, 4, 5, 30, 120]))
        if k % 3 == 0:
            at = rng.randrange(len(body) + 1)
            body[at:at] = passage[rng.choice([0, 5]) :]
        if k % 4 == 1:
            body += short + short
        texts.append((" " if k % 2 else "\n").join(body))
    for k in range(12):
        copy = list(base)
        for _ in range(k % 5):
            copy[rng.randrange(len(copy))] = "x%d" % rng.randrange(1000)
        texts.append(" ".join(copy))
    texts += [texts[-1], texts[0], "", None, " \t\n ", "ab " * 400, "é" * 120 + " ü", "é" * 130, "one two three", "One TWO three", "!!! 123", "z" * 300, "z" * 299, " ".join(prose(rng, 6000))]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    rows = [(i * 3 - 5, t) for i, t in zip(ids, texts, strict=True)]
    rows += [rows[3], rows[20], (rows[5][0], "another text under a used number " + " ".join(passage)), (None, " ".join(passage)), (None, None)]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, ["en", "de", None][k % 3], "s", None if t is None else len(t), "r", "s", "l") for k, (i, t) in enumerate(rows)], SCHEMA)


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return frame(spark, rows).repartition(3).persist()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
