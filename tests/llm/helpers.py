"""Small documents with awkward cases, and brute-force versions."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, matches string, spans string, n_words string, kept string"


def words(rng, n, vocabulary):
    return [rng.choice(vocabulary) for _ in range(n)]


def corpus(seed=1, n=60):
    """(doc_id, text) with copies, near copies, shared passages, empty, null, short and long texts."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgéß") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    docs = [words(rng, rng.randint(0, 160), vocabulary) for _ in range(n)]
    for i in range(0, n // 3):  # near copies: a few words changed
        x = list(docs[i])
        for _ in range(len(x) // 40):
            x[rng.randrange(len(x))] = "changed" + str(rng.randint(0, 9))
        docs.append(x)
    for i in range(5):
        docs.append(list(docs[i + 20]))
    passage = words(rng, 70, vocabulary)
    for i in range(6):
        docs.append(words(rng, 30, vocabulary) + passage + words(rng, 30 + i, vocabulary))
    docs.append(words(rng, 6000, vocabulary))
    docs.append(["same"] * 300)
    rows = [(i, "\n".join(" ".join(d[j : j + 12]) for j in range(0, len(d), 12))) for i, d in enumerate(docs)]
    rows += [(9001, None), (9002, ""), (9003, " \t\n "), (9004, "Two words"), (9005, "two WORDS"), (None, rows[0][1]), (None, None), (3, rows[3][1])]
    return rows


def frame(spark, rows):
    """documents with the columns of the table, and more whose names clash with what the operators add."""
    return spark.createDataFrame([(i, t, "en", "src", len(t) if t is not None else None, "x", "y", None, "w", "k") for i, t in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
