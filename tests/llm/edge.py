"""Rows that every operator must stand: nulls, empty and long texts, repeats, ties, and clashing extra columns."""
from __future__ import annotations

import random

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, doc long, n string, size string, row string, sid string, label string, "
          "pii string, stats string, lang_pred string, word string, _words string, score string, gone string, component string, h1 string")


def words(rng: random.Random, n: int, stem: str = "w") -> str:
    return " ".join(f"{stem}{rng.randrange(400)}" for _ in range(n))


def rows() -> list[tuple]:
    rng = random.Random(7)
    base = words(rng, 80)
    near = base.replace(" ", "  ", 3).replace("w1", "W1") + " tail"
    texts = [(1, base), (2, near), (3, base), (3, base), (4, None), (5, ""), (6, " \t\n "), (7, "one"), (8, "One"), (None, base), (None, None),
             (9, "1234 5678 !!"), (10, words(rng, 30_000)), (11, "ünï 日本語 🎉 don't\r\n\x0bstop."), (12, "x" * 50_000), (13, "<|endoftext|>" + chr(0) + "end"), (13, words(rng, 60, "z"))]
    extra = tuple("clash" for _ in range(14))
    return [(i, t, [None, "en", "fr"][k % 3], [None, "a", "b", "c"][k % 4], None if t is None else len(t), k, *extra) for k, (i, t) in enumerate(texts)]


def frame(spark, some: list[tuple] | None = None):
    return spark.createDataFrame(rows() if some is None else some, SCHEMA)
