"""Small documents with every edge: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id string, score string, kept string, label string, g string, text_hash string"


def texts(seed: int = 7) -> list[tuple[int | None, str | None]]:
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8)))
    base = [" ".join(word() for _ in range(60)) for _ in range(8)]
    shared = " ".join(word() for _ in range(20))
    rows: list[tuple[int | None, str | None]] = []
    for i in range(40):
        words = base[i % 8].split()
        for _ in range(i % 5):
            words[rng.randrange(len(words))] = word()
        rows.append((100 + i, " ".join(words) + (f" {shared} {word()}" if i % 3 == 0 else "")))
    rows += [(1, base[0]), (2, base[0]), (3, ""), (4, None), (5, "one"), (6, "one"), (7, "two words"), (8, "  \t\n "), (9, "日本語 über Ñandú 🙂 " * 5), (10, "12345 67890 !!!")]
    rows += [(11, " ".join(word() for _ in range(4000))), (12, "ab " * 3000), (2, base[0]), (None, base[1]), (None, None), (13, "a\nb\r\nc d\x00e"), (14, "<|endoftext|> in a text <|endoftext|>")]
    return rows


def frame(spark, rows: list[tuple[int | None, str | None]] | None = None):
    rows = texts() if rows is None else rows
    return spark.createDataFrame([(i, t, "en", "s", 1, "x", "y", "z", "l", "g", "h") for i, t in rows], SCHEMA).repartition(3)


def empty(spark):
    return frame(spark, [])
