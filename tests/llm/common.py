"""Texts and tables that every operator must take."""

import random

ODD = [
    (1, None, "en", "b", 0),
    (2, "", "en", None, 0),
    (3, "   \n\t", "en", "a", 5),
    (4, "One two three four five six seven.", "en", "a", 34),
    (5, "one TWO three four five six seven.", "de", "a", 34),
    (6, "x", "fr", None, 1),
    (7, "word " * 6000, "en", "b", 30000),
    (8, "é ü 日本   naïve café’s don't stop!!", "fr", "c", 36),
    (9, "One two three four five six seven.", "en", "a", 34),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def odd(spark, rows=None):
    """The odd documents, one repeated as a whole row."""
    return spark.createDataFrame(ODD if rows is None else rows, SCHEMA)


def clashing(df):
    """More columns, named as operators name their own."""
    from pyspark.sql import functions as F

    names = ["size", "start", "h", "n", "shard", "score", "component", "position", "_part", "_bin", "url"]
    return df.withColumns({c: F.lit("taken") for c in names})


def near_copies(seed=3, count=260, words=120):
    """Random texts of which some are changed in a few words: (doc_id, text)."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    out, base = [], []
    for i in range(count):
        if base and rng.random() < 0.7:
            text = list(rng.choice(base))
            for _ in range(rng.choice([0, 1, 1, 2, 3, 6, 12])):
                k = rng.randrange(len(text))
                if rng.random() < 0.5:
                    text[k] = rng.choice(vocabulary)
                else:
                    text.insert(k, rng.choice(vocabulary))
        else:
            text = [rng.choice(vocabulary) for _ in range(rng.randint(1, words))]
        base.append(text)
        out.append((i, " ".join(text)))
    return out
