"""Small tables with the awkward cases: nulls, empties, ties, repeats, long texts, clashing columns."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, hit int, class string, slot int"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    out, x = [], seed * 7919 + 1
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(WORDS[(x >> 8) % len(WORDS)] + str((x >> 16) % 50))
    return " ".join(out)


def near(text: str, at: int) -> str:
    w = text.split()
    w[at] = "changed"
    return " ".join(w)


LONG = prose(99, 30_000)
BASE = prose(1, 120)

ROWS = [
    (1, BASE), (2, BASE), (3, near(BASE, 50)), (4, near(BASE, 3)), (5, prose(2, 80)), (6, ""), (7, None), (8, "one two"),
    (9, "ONE two"), (10, LONG), (11, LONG), (12, "  \t\n \x0b "), (13, "a\nb c\na\nb c\n\nwörter Straße"), (None, BASE),
    (None, "only null"), (14, prose(3, 9) + "\n" + prose(3, 9)), (15, BASE), (15, BASE), (16, 'token = "0a1b2c3d4e5f0a1b2c3d4e5f" x'),
    (17, "naïve ⁠zero   triple  ▁ mark\x00 🙂🙂"), (18, "Licensed under the Apache License, Version 2.0."),
]


def documents(spark, rows=None):
    full = [(i, t, "en", None, None if t is None else len(t), 0.5, "own", 7, "c", 3) for i, t in (ROWS if rows is None else rows)]
    return spark.createDataFrame(full, SCHEMA)
