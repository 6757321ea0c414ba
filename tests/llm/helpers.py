"""Tables that every operator has to survive."""

from __future__ import annotations

import random

#: Odd texts: null, empty, blanks, one word, ties and repeats, other scripts, special tokens, low entropy, long.
ODD = [None, "", "  \n\t", "word", "word", "a b", "The the THE", "é日本 🙂", "<|endoftext|> x <|end", "a" * 3000, "ab " * 900, "x\u0000y", "one two three four five six seven", "one two three four five six seven"]


def odd_docs(spark, repeat_row=True):
    """With columns whose names clash with those that operators make; the last row is there twice."""
    rows = [(i, t, "en", "s", 1, 2.0, 3) for i, t in enumerate(ODD)]
    if repeat_row:
        rows.append(rows[-1])
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, rank int")


def empty_docs(spark):
    return odd_docs(spark).limit(0)


def random_texts(n, seed, alphabet="abcdefgh "):
    r = random.Random(seed)
    base = ["".join(r.choices(alphabet, k=300)) for _ in range(10)]
    out = []
    for _ in range(n):
        text = ""
        for _ in range(r.randint(1, 5)):
            s = r.randint(0, 200)
            text += r.choice(base)[s : r.randint(s, 300)] + "".join(r.choices(alphabet, k=r.randint(0, 60)))
        out.append(text)
    return out


def texts_df(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
