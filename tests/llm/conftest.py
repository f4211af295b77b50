import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, row string, score double, size int, component string, digest string, pieces string"


def vocabulary(rng, n=300):
    return ["".join(rng.choice("abcdeéfghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(n)]


def texts(seed=5, n=60):
    """Prose with exact copies, near copies, shared passages and the odd cases."""
    rng = random.Random(seed)
    words = vocabulary(rng)
    prose = lambda k: " ".join(rng.choice(words) for _ in range(k))
    base = [prose(rng.randrange(20, 160)) for _ in range(n)]
    passage = prose(40)
    out = list(base)
    out += [base[0]] * 6 + [base[1], base[1]]
    for k in range(12):  # near copies: a few words changed
        w = base[k % 4].split()
        for _ in range(1 + k % 3):
            w[rng.randrange(len(w))] = rng.choice(words)
        out.append(" ".join(w))
    out += [f"{prose(30)} {passage} {prose(25)}" for _ in range(10)]
    out += [None, "", "   \n", "one", "two words", "Two Words", "only four words here", "日本語 テスト 😀 ▁ <s>", prose(6000), "aaaa " * 400]
    return out


@pytest.fixture(scope="module")
def rows():
    """Rows in scrambled order with every column of ours clashing, null ids and a repeated row."""
    rng = random.Random(9)
    data = [(i, t, "en", None if i % 17 == 0 else f"src{i % 5}", len(t or ""), None, "r", None, 3, "c", "d", "p") for i, t in enumerate(texts())]
    rng.shuffle(data)
    return data


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids and rows that repeat id and text."""
    rows = [(None, "a null id text", None, None), (None, None, None, None), (3, "the same text twice here", "en", "s"), (3, "the same text twice here", "en", "s"), (4, "the same text twice here", "en", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
