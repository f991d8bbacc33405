"""Small tables with the awkward rows that every operator must take."""

import random

LONG = " ".join(f"word{i % 977} tail{i}" for i in range(20_000))


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def documents(spark, rows):
    """(doc_id, text, source) rows as a table with extra columns whose names operators use inside."""
    full = [(i, t, "en", s, None if t is None else len(t), "x", 7, "y") for i, t, s in rows]
    return spark.createDataFrame(
        full,
        "doc_id long, text string, lang string, source string, n_chars long, "
        "seed string, start int, bucket string",
    )


def awkward(seed=1, n=60):
    """Null and empty texts, a very long one, ties, repeated rows, null sources, copies."""
    rng = random.Random(seed)
    rows = [(i, prose(rng, rng.choice([1, 3, 8, 60, 200])), f"s{i % 4}") for i in range(n)]
    rows += [(n, None, None), (n + 1, "", "s0"), (n + 2, " \n\t", None), (n + 3, LONG, "s1")]
    rows += [(n + 4, rows[3][1], "s2"), (n + 5, rows[3][1], "s3"), rows[7], rows[7]]
    rows += [(n + 6, LONG, "s1"), (n + 7, "éß中 \U0001f600 " * 30, None), (None, "no id here at all", "s0")]
    return rows
