"""Small documents with the awkward cases, and edge-case frames."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def corpus(n=120, seed=3):
    """Documents with exact copies (some in capitals), near copies, shared passages, short, empty and null texts."""
    rng = random.Random(seed)
    passage = words(rng, 55)
    out = []
    for i in range(n):
        kind = i % 10
        if kind == 0 or len(out) < 5:
            text = " ".join(words(rng, rng.randrange(20, 120)))
        elif kind == 1:
            text = rng.choice(out)[1] or ""
            text = text.upper() if rng.random() < 0.5 else text
        elif kind in (2, 3, 4):
            w = (rng.choice(out)[1] or "a b c d e f").split()
            for _ in range(rng.randrange(0, 4)):
                if w:
                    w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            text = " ".join(w)
        elif kind == 5:
            text = " ".join(words(rng, 15) + passage + words(rng, rng.randrange(5, 40)))
        elif kind == 6:
            text = " ".join(words(rng, rng.randrange(0, 7)))
        elif kind == 7:
            text = rng.choice(["", None, "  \n ", "one", "a\x0bb\tc"])
        else:
            text = " ".join(words(rng, 60)) + ".\n" + " ".join(words(rng, 30))
        out.append((i, text, "en", None if i % 17 == 0 else f"src{i % 5}", len(text or "")))
    out.append((n, " ".join(words(rng, 6000, 5000)), "en", "src1", 1))
    return out


def frame(spark, rows, schema=SCHEMA, parts=3):
    return spark.createDataFrame(rows, schema).repartition(parts)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
