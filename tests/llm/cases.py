"""Small document tables with what real ones have: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

SHAPE = "doc_id long, text string, lang string, source string, n_chars long, row string, score double, hits int, r long"


def words(rng: random.Random, n: int, vocabulary: int = 800) -> str:
    return " ".join(f"w{rng.randint(0, vocabulary)}" for _ in range(n))


def documents(seed: int = 1, n: int = 60) -> list[tuple]:
    """Rows of SHAPE: unique texts, exact copies, near copies, shared passages, junk."""
    rng = random.Random(seed)
    texts: list = [words(rng, rng.randint(60, 160)) for _ in range(n)]
    for i in range(0, n, 6):
        texts.append(texts[i])
        near = texts[i + 1].split()
        near[len(near) // 2] = "changed"
        texts.append(" ".join(near))
    passage = words(rng, 70)
    for i in range(2, n, 9):
        texts[i] = texts[i] + "\n" + passage + " " + words(rng, 5)
    texts += [None, None, "", "", " \n\t", "one", "ONE", "a b c", "A b c", "éß x", "?!.", "中文", "x" * 500, "lo " * 4000, "same line\nsame line\n" * 30, "#$% *** <<>>", words(rng, 6000)]
    rows = [(i, t, ("en", "de")[i % 2] if i % 7 else None, f"s{i % 3}" if i % 5 else None, len(t or ""), "clash", 1.0, 3, 7) for i, t in enumerate(texts)]
    return [*rows, rows[3], rows[3], (None, texts[4], "en", None, 1, "c", 0.0, 0, 0), (None, None, None, None, None, None, None, None, None), (-5, texts[5], "en", "s9", 2, "c", 0.0, 0, 0)]


def frame(spark, rows=None, partitions: int = 3):
    return spark.createDataFrame(documents() if rows is None else rows, SHAPE).repartition(partitions)
