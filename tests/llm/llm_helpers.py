"""Small tables for the operators' tests."""

import random

CLASH = ("ids", "n", "h", "g", "w", "id", "label", "score", "shard", "region", "k", "th", "set", "rep", "x", "lang_pred", "quality_stats")


def docs_frame(spark, rows, clash=True):
    """documents of (doc_id, text[, lang]) rows, with extra columns whose names
    the operators use inside."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", 0) for r in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    if clash:
        full = [r + ("?",) * len(CLASH) for r in full]
        schema += "".join(f", {c} string" for c in CLASH)
    return spark.createDataFrame(full, schema)


def words(n, seed, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


ODD = [(1, None), (2, ""), (3, "  \n\t "), (None, "some text without an id"), (4, "twice the same"), (4, "twice the same"),
       (5, "x"), (6, "ünïcödé ßtraße 中文 \u0085\x1c  end"), (7, "a" * 50_000), (8, "long " * 20_000)]
