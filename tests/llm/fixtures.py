"""Small documents with what the operators must stand: nulls, empty and long texts, ties, repeated rows, extra columns."""

import random

SCHEMA = "doc_id long, text string, lang string, n_words long, row_key long"


def documents():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7)))
    line = lambda n: " ".join(word() for _ in range(n)) + "."
    base = [" ".join(line(rng.randrange(4, 12)) for _ in range(8)) for _ in range(12)]
    passage = line(60)
    out = []
    for i in range(60):
        text = base[i % 12]
        if i % 3 == 1:  # near copies
            words = text.split(" ")
            for _ in range(rng.randrange(1, 9)):
                words[rng.randrange(len(words))] = word()
            text = " ".join(words)
        if i % 4 == 2:
            text = text + "\n" + passage + "\n" + line(20)
        out.append((i, text))
    out += [(100, None), (101, ""), (102, " \n\t"), (103, "one two"), (103, "one two"), (None, base[0]), (None, None), (104, "Ünï　x\xa0y don't  stop \n z"), (105, "|".join(base))]
    out += [(106, "\n".join([base[3]] * 3)), (107, " ".join(base) * 5)]
    return [(d, t, None if d is None else "en", 7, 1) for d, t in out]


def frame(spark):
    return spark.createDataFrame(documents(), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
