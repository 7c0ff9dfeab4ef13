from __future__ import annotations

import random

SYLLABLES = "ba be bi bo da de di do ka ke ki ko la le li lo ma me mi mo na ne ni no ra re ri ro sa se si so ta te ti to".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long, _id long, size long, key string, row_number long, h string, verdict string"


def prose(rng: random.Random, n: int) -> str:
    words = ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(n)]
    return " ".join(w + ("." if k % 9 == 8 else "") for k, w in enumerate(words))


def corpus(seed: int = 0, n: int = 60) -> list[tuple]:
    """(doc_id, text, source): prose, copies, near copies, NULLs, empty and white texts, repeated rows."""
    rng = random.Random(seed)
    texts: list[str | None] = [prose(rng, rng.randint(1, 120)) for _ in range(n)]
    texts += [None, "", " \n\t ", "one", prose(rng, 4000)]
    base = prose(rng, 100).split(" ")
    for k in range(12):
        words = list(base)
        for _ in range(k):
            words[rng.randrange(len(words))] = prose(rng, 1)
        texts.append(" ".join(words))
    texts += texts[:6] + [texts[3]] * 5
    rows = [(k, t, [None, "a", "b", "é", ""][k % 5]) for k, t in enumerate(texts)]
    rows += [rows[2], rows[2], (None, texts[5], "a"), (None, None, None)]
    return rows
