"""Small tables with the awkward cases: nulls, empty and long texts, repeated rows, clashing column names."""

import random

WORDS = "alpha beta gamma delta river stone cloud paper seven north amber violet copper silver quiet morning evening bridge window garden".split()
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, size long, slot string, score string, label int"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ".", ","]) for _ in range(n))


def documents(n=60, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = prose(rng, rng.randint(1, 60))
        rows.append((i, text, rng.choice(["en", "de", None]), rng.choice(["a", "a", "a", "b", "c", None]), len(text)))
    rows += [(1000 + i, rows[3][1], "en", "a", 5) for i in range(25)]
    rows += [(2000, None, None, None, None), (2001, "", "en", "b", 0), (2002, " \n\t ", "en", "b", 4), (None, "no id here", "en", "c", 10), (None, None, None, None, None)]
    rows += [(2003, prose(rng, 4000), "en", "a", 1), rows[5], rows[5], (rows[6][0], "same id, other text", "en", "a", 19)]
    return [(*r, 7, "x", "y", 1) for r in rows]


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, DOCS)
