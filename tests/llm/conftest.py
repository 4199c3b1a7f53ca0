import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `key` string, `sum` int, score string, items string, digest int, root string, label string"


@pytest.fixture(scope="session")
def hard_rows():
    """Documents with nulls, empty and long texts, ties, repeated rows, shared passages and names that operators use themselves."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, long = prose(160), prose(6000)
    texts = [None, "", " ", "\n", "one", "one two three", "ONE two, three!", "a" * 1300, "ab" * 700, long, long + " end", passage, prose(40) + passage + prose(40), passage + prose(20)]
    base = prose(120).split()
    for i in range(12):  # near copies: a few words changed
        own = list(base)
        own[i * 7] = "x%d" % i
        texts.append(" ".join(own))
    texts += [prose(rng.randint(3, 90)) for _ in range(12)] + [passage[:500], passage[:430] + "!" + passage[431:900]]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(100, texts[12]), (100, texts[12]), (101, texts[13]), (None, texts[14]), (None, None), (7, texts[9])]
    return rows


@pytest.fixture(scope="session")
def hard_docs(spark, hard_rows):
    full = [(d, t, "en", f"s{i % 3}" if i % 5 else None, None, "k", 1, "s", "i", 2, "r", "l") for i, (d, t) in enumerate(hard_rows)]
    return spark.createDataFrame(full, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
