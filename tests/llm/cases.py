"""Awkward tables for every operator."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, t string, key long, kept boolean, row string, h int, size string, s string, n int"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(30)) for _ in range(n))


def texts():
    """``(doc_id, text, source)``: nulls, blanks, copies, near copies, shared passages, repeated rows and a very long text."""
    passage = prose(99, 60)
    near = prose(7, 120).split()
    rows = [
        (1, None, "a"), (2, "", "a"), (3, " \t\n", None), (4, "one", "b"), (5, "One two\tthree four", "b"), (6, "one TWO three four", "b"),
        (10, prose(1, 80), "a"), (11, prose(1, 80), "a"), (12, prose(1, 80), "c"), (12, prose(1, 80), "c"), (13, prose(2, 90), None),
        (20, " ".join(near), "a"), (21, " ".join([*near[:60], "changed", *near[61:]]), "b"), (22, " ".join([*near[:90], *near[91:]]), "c"),
        (30, prose(3, 40) + " " + passage, "a"), (31, passage + " " + prose(4, 40), "b"), (32, "é日本😀 " * 60 + passage, "b"),
        (40, "a" * 400, "c"), (41, "ab" * 300, "c"), (50, prose(5, 30_000), "b"), (51, prose(6, 200) + prose(5, 3000), "a"),
        (None, "no id " + prose(8, 30), "a"), (None, None, None), (60, "Licensed under the Apache License, Version 2.0. " + prose(9, 30), "a"), (61, prose(10, 30) + " released   under the\nMIT License", "a"),
    ]
    return rows


def docs(spark, rows=None):
    made = [(i, t, "en", s, 0, "x", "y", 7, True, "r", 1, "z", "q", 3) for i, t, s in (texts() if rows is None else rows)]
    return spark.createDataFrame(made, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
