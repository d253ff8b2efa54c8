import random

import pytest


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text) rows with copies, near copies, shared passages, odd white space, nulls and one long text."""
    rnd = random.Random(7)
    words = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 6))) for _ in range(150)]
    passage = " ".join(rnd.choice(words) for _ in range(60))
    rows = []
    for i in range(60):
        text = "\n".join(" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 12))) for _ in range(rnd.randint(1, 9)))
        if i % 4 == 0:
            text += "\n" + passage
        rows.append((i, text))
    rows += [(100 + i, rows[3][1]) for i in range(5)]
    rows += [(110 + i, rows[5][1] + " " + w) for i, w in enumerate(words[:5])]
    rows += [(120, None), (121, ""), (122, " \t\n "), (123, "one"), (124, "A b"), (125, passage.replace(" ", "\x0b\x0c ").upper())]
    rows += [(126, " ".join(rnd.choice(words) for _ in range(30_000))), (127, "x" * 5000), (128, "l\nm\nn\n" * 3)]
    rnd.shuffle(rows)
    return rows


def frame(spark, rows, extra=True):
    """The rows as a table with null values and clashing names in other columns."""
    if not extra:
        return spark.createDataFrame(rows, "doc_id long, text string")
    own = [(i, t, None if k % 2 else "en", k if k % 3 else None, f"v{k}") for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(own, "doc_id long, text string, lang string, n_words long, _other string")
