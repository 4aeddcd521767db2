"""Small tables with the awkward cases that every operator has to take."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng: random.Random, n: int, size: int = 400) -> list[str]:
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def awkward(rng: random.Random, n: int = 60) -> list[tuple]:
    """Rows with near copies, exact copies, short, empty, null and long texts, ties, nulls in every column."""
    texts = []
    for _ in range(n // 3):
        base = words(rng, rng.choice([3, 4, 5, 6, 30, 80, 200]))
        texts.append(" ".join(base))
        for _ in range(rng.randrange(3)):
            near = list(base)
            for _ in range(rng.randrange(3)):
                near[rng.randrange(len(near))] = f"x{rng.randrange(1000)}"
            texts.append((" " if rng.random() < 0.7 else "\n").join(near))
    texts += ["", None, " \n\t ", "A", "a", "...", "\n", "é É é 　 x", "a a a a a a a a a a a a a", texts[0], texts[0].upper()]
    texts.append(" ".join(words(rng, 6000, 5000)))
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["s0", "s1", None]), None if t is None else len(t)) for i, t in enumerate(texts)]
    return rows + [rows[0], rows[0], (None, texts[0], None, None, None), (None, None, None, None, None)]
