"""Small corpora with what real ones hold: copies, near copies, shared passages, odd rows."""

import random

SYLLABLES = "an be co du el fi go hu is ja ko lu me no op qu re su ti ul va wo xy ze".split()


def text(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def documents(seed=3, n=60):
    """(doc_id, text) with repeated rows, nulls, empties, ties, a very long text."""
    rng = random.Random(seed)
    out = [(i, text(rng, rng.randrange(1, 250))) for i in range(n)]
    passage = text(rng, 90)
    for i in range(10):
        out.append((n + i, f"{text(rng, rng.randrange(0, 30))} {passage} {text(rng, rng.randrange(0, 30))}"))
    long = text(rng, 6000)
    out += [(900, long), (901, long[:20000] + " é☃ " + long[20000:]), (902, passage * 3), (903, "same " * 900), (904, "x" * 3000), (905, "x" * 3000 + "y")]
    copy = out[3][1]
    out += [(950 + i, copy) for i in range(12)] + [(12, out[12][1]), (3, "another text with the same key " * 20)]
    out += [(910, None), (911, ""), (912, " \n\t "), (913, "one"), (None, text(rng, 120)), (None, passage), (914, "Ünïcode ☃ \x0b text here\x1c and"), (915, "é" * 500), (916, "é" * 500)]
    return out


def frame(spark, rows, parts=3):
    """The rows with extra columns whose names clash with those of operators."""
    return spark.createDataFrame([(i, t, "k", 5, None) for i, t in rows], "doc_id long, text string, key string, n_words int, raw string").repartition(parts)
