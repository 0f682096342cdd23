"""Small tables that hold every awkward case."""

import random

import pytest

VOCABULARY = [f"{a}{b}{c}" for a in ("ba", "te", "ro") for b in ("", "lin", "mou", "é") for c in ("s", "n", "ka", "r")]


def prose(seed: int, words: int) -> str:
    """Sentences of made-up words, a line for every few."""
    draw = random.Random(seed)
    out = []
    for i in range(words):
        word = draw.choice(VOCABULARY) + str(draw.randrange(40))
        end = "." if i % 9 == 8 or i == words - 1 else ""
        out.append(word + end + ("\n" if end and draw.random() < 0.3 else " "))
    return "".join(out).strip()


def corpus() -> list[tuple]:
    """(doc_id, text): nulls, empty and very long texts, copies, near copies, shared passages, odd characters."""
    shared = prose(1, 90)
    base = prose(2, 200)
    words = base.split(" ")
    near = " ".join([*words[:100], "changed", *words[101:]])
    rows = [
        (0, None), (1, ""), (2, " \n\t "), (3, base), (4, base), (5, near), (6, f"{prose(3, 60)} {shared} {prose(4, 70)}"),
        (7, f"{prose(5, 80)}\n{shared}"), (8, "x" * 5000), (9, prose(6, 6000)), (None, prose(7, 80)), (10, base), (10, base),
        (11, "don't  STOP　now \u0001 <|endoftext|> 12345 ﬁé中文 \U0001f600 'RE\r\n\r\n  end "), (12, "word " * 300), (13, prose(8, 120)),
        (14, "a|b > c ### $$$ &&& " * 40), (15, "Σίσυφος İstanbul é"), (16, "one two"), (17, "\n".join([prose(9, 30)] * 5)), (18, "'"), (-5, prose(10, 55)),
    ]
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    """The corpus with columns whose names operators use themselves, over three partitions."""
    rows = [(i, t, "en", "src0", None if t is None else len(t), 7, 1.5) for i, t in corpus()]
    ddl = "doc_id long, text string, lang string, source string, n_chars long, mark int, score double"
    return spark.createDataFrame(rows, ddl).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def texts():
    return corpus()
