import random

import pytest


@pytest.fixture(scope="session")
def hard_docs(spark):
    """Null, empty, blank, short, long and repeated texts, ties, null ids, and columns with clashing names."""
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(rnd.choices(words, k=60)) for _ in range(6)]
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "one"), (6, "one two"), (7, "ONE TWO"), (8, base[0]), (8, base[0]), (9, base[0].replace(" ", "  ")), (None, base[1]), (10, "x" * 5000), (11, " ".join(rnd.choices(words, k=20000))), (12, "ünï cödé “quoted” — ½ 漢字"), (13, "12 " * 400)]
    n = 20
    for b in base[2:]:
        for _ in range(8):
            w = b.split()
            for _ in range(rnd.choice((0, 1, 1, 2, 4))):
                w[rnd.randrange(len(w))] = rnd.choice(words)
            rows.append((n, " ".join(w)))
            n += 1
    rows = [(i, t, "en", 7, "c", 1.5) for i, t in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, id long, cell string, score double")
