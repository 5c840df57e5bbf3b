import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagsmith.llm import exact_dedup as X
from tagsmith.llm import jaccard_join as J
from tagsmith.llm.jaccard_join import jaccard_join, leading

FOLD = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def brute_groups(rows, k, num, den):
    sets = {}
    for i, t in rows:
        if i is None:
            continue
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(FOLD))
        sets[i] = frozenset(zip(*[w[j:] for j in range(k)])) if len(w) >= k else frozenset([tuple(w)]) if w else frozenset()
    top = {i: i for i in sets}

    def find(a):
        while top[a] != a:
            a = top[a]
        return a

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            both = len(sets[x] & sets[y])
            if x < y and both and both * den >= num * (len(sets[x]) + len(sets[y]) - both):
                a, b = find(x), find(y)
                top[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("k,num,den", [(3, 9, 10), (5, 4, 5)])
def test_jaccard_join_equals_brute_force(spark, hard_docs, k, num, den):
    got = {r[0]: (r[1], r[2]) for r in jaccard_join(hard_docs, k=k, num=num, den=den).collect()}
    want = brute_groups([(r[0], r[1]) for r in hard_docs.select("doc_id", "text").collect()], k, num, den)
    assert got == want
    assert len({c for _, c in got.values()}) < len(got)


def test_linked_sets_meet_in_a_region():
    """Whatever the levels, two sets of just enough similarity lead with a common shingle; one that no one else holds leads nowhere."""
    rng = np.random.default_rng(5)
    for num, den in ((9, 10), (4, 5)):
        for n in range(1, 300):
            for m in range(-(-n * num // den), n + 1):
                both = -(-num * (n + m) // (num + den))  # the least intersection of linked sets of these sizes
                if both > m:
                    continue
                pool = np.unique(rng.integers(1, 2**63, 2 * (n + m), dtype=np.uint64))[: n + m - both]
                rng.shuffle(pool)
                levels = rng.integers(0, 4, len(pool))
                levels[:both] = np.maximum(levels[:both], 1)  # what both hold is held by two
                level = dict(zip(pool.tolist(), levels.tolist(), strict=True))
                sets = np.sort(pool[:n]), np.sort(np.concatenate([pool[:both], pool[n:]]))
                x, y = (leading(s, np.array([level[e] for e in s.tolist()], np.uint8), num, den) for s in sets)
                assert np.intersect1d(x, y).size, (n, m)
    alone = np.arange(1, 50, dtype=np.uint64)
    assert not leading(alone, np.zeros(49, np.uint8), 9, 10).size


def test_jaccard_join_members_of_one_region_link_apart_from_the_pivot(spark):
    """Unlike texts share a long passage; two families of near copies inside it, and an id with two texts."""
    passage = " ".join(f"p{i}" for i in range(60))
    family = lambda f: [f"{passage} " + " ".join(f"{f}{i}" if i != v else f"x{f}{v}" for i in range(90)) for v in (20, 50, 80)]
    texts = family("a") + family("b") + [f"{passage} " + " ".join(f"{c}{i}" for i in range(40 + 9 * n)) for n, c in enumerate("cdefg")]
    rows = [(i + 1, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows + [(1, "zz " + texts[3])], "doc_id long, text string")
    for k, num, den in ((3, 9, 10), (5, 4, 5)):
        got = {r[0]: (r[1], r[2]) for r in jaccard_join(docs, k=k, num=num, den=den).collect()}
        assert got == brute_groups(rows, k, num, den)


def test_jaccard_join_of_nothing(spark):
    assert jaccard_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_exact_dedup(spark, hard_docs):
    rows = [(r[0], r[1]) for r in hard_docs.select("doc_id", "text").collect()]
    groups = defaultdict(list)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    for i, t in rows:
        groups[norm(t)].append(i)
    want = []
    for i, t in rows:
        g = groups[norm(t)]
        keep = min((x for x in g if x is not None), default=None)
        want.append((i, keep, len(g), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    got = [tuple(r) for r in X.exact_dedup(hard_docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_runs_merge_into_an_index_of_before(spark):
    digests = lambda ids: spark.createDataFrame([(i, bytes([i % 3])) for i in ids], "id long, digest binary")
    old = X.compact(X.flush(digests(range(5, 10))))
    got = {bytes(r["digest"]): (r["keep_id"], r["n"]) for r in X.compact(old, X.flush(digests(range(0, 5)))).collect()}
    assert got == {b"\x00": (0, 4), b"\x01": (1, 3), b"\x02": (2, 3)}


def test_colliding_digests_are_told_apart_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(F, "sha2", lambda c, n: F.lit("00"))
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "b"), (5, "c")], "doc_id long, text string")
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in X.exact_dedup(docs).collect()}
    assert got == {1: (1, 2), 2: (2, 2), 3: (1, 2), 4: (2, 2), 5: (5, 1)}


def test_exact_dedup_of_nothing(spark):
    assert X.exact_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_jaccard_join_divides_cells_again(spark, monkeypatch):
    """Near copies of one text, most of them not linked to it, with every open cell divided until the last level."""
    for name, value in (("PAIRS_PER_ROW", 0), ("PAIRS_PER_DOCUMENT", 0), ("SMALL", 1), ("LEVELS", 2)):
        monkeypatch.setattr(J, name, value)
    rnd = random.Random(4)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(60):
        # sixteen words that every third copy changes alike, and some of its own
        own = {j: f"o{i % 3}x{j}" for j in range(0, 32, 2)} | {j: f"n{i}x{j}" for j in rnd.sample(range(120), i % 4)}
        rows.append((i, " ".join(own.get(j, w) for j, w in enumerate(base))))
    rows.append((60, " ".join(base)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r[0]: (r[1], r[2]) for r in jaccard_join(docs, k=5, num=4, den=5).collect()} == brute_groups(rows, 5, 4, 5)


def test_shingles_are_counted_as_runs(spark, monkeypatch):
    """A row a shingle overfilled an executor over check_l: the counts come from runs of shingles, right at each level and over many runs."""
    rnd = random.Random(8)
    rows = [(i, " ".join(rnd.choices("abcd", k=30) + [f"n{i}", "all", "of", "them"])) for i in range(300)] + [(300, None), (301, "a"), (302, "a"), (303, "a a b")]
    held, plans = [], []
    stage = J.staged

    def seen(df, name):
        out = stage(df, name)
        if name == "jaccard-counts":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            held.extend(r["count"] for r in out.collect())
        return out

    monkeypatch.setattr(J, "staged", seen)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = defaultdict(int)
    for _, t in rows:
        w = (t or "").split()
        for g in {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} - {()}:
            want[g] += 1
    cut = lambda counts: sorted(min(c, J.LEVEL_COUNTS[-1]) for c in counts if c >= 2)
    for size in (1 << 20, 500):
        monkeypatch.setattr(J, "RUN_SHINGLES", size, raising=False)
        held.clear()
        jaccard_join(docs).count()
        assert cut(held) == cut(want.values()) and max(cut(held)) == 64
    assert not any("HashAggregate" in p for p in plans)


def test_join_passes_small_batches_to_python(spark, monkeypatch):
    """Whole texts by ten thousand rows at once took much of an executor; the session's own setting is back afterwards."""
    key, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before, stage = spark.conf.get(key), J.staged
    monkeypatch.setattr(J, "staged", lambda df, name: (seen.append(int(spark.conf.get(key))), stage(df, name))[1])
    jaccard_join(spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")).count()
    assert seen and max(seen) <= 2000 and spark.conf.get(key) == before
