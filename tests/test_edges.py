import math
import random

from pyspark.sql import functions as F

from tagsmith.operators import edges, logo


def by_hand(v):
    """Edge pixels of a list of rows."""
    h, w = len(v), len(v[0])
    val = lambda y, x: v[min(max(y, 0), h - 1)][min(max(x, 0), w - 1)]
    g = {}
    for y in range(h):
        for x in range(w):
            g[y, x] = (sum(k * (val(y + d, x + 1) - val(y + d, x - 1)) for d, k in ((-1, 1), (0, 2), (1, 1))), sum(k * (val(y + 1, x + d) - val(y - 1, x + d)) for d, k in ((-1, 1), (0, 2), (1, 1))))
    size = lambda y, x: sum(map(abs, g.get((y, x), (0, 0))))
    weak = set()
    for (y, x), (gx, gy) in g.items():
        m, angle = size(y, x), math.degrees(math.atan2(abs(gy), abs(gx)))
        if m <= edges.LOW:
            continue
        if angle < 22.5:
            ok = m > size(y, x - 1) and m >= size(y, x + 1)
        elif angle > 67.5:
            ok = m > size(y - 1, x) and m >= size(y + 1, x)
        else:
            s = -1 if (gx < 0) != (gy < 0) else 1
            ok = m > size(y - 1, x - s) and m > size(y + 1, x + s)
        if ok:
            weak.add((y, x))
    found = {p for p in weak if size(*p) > edges.HIGH}
    new = found
    while new:
        new = {(y + i, x + j) for y, x in new for i in (-1, 0, 1) for j in (-1, 0, 1)} & weak - found
        found = found | new
    return found


def test_edges_by_brute_force(spark):
    rnd = random.Random(2)
    images = {0: [[100] * 9 for _ in range(7)], 1: [[0] * 4 + [255] * 5 for _ in range(6)], 2: [[rnd.randrange(256) for _ in range(11)] for _ in range(9)], 5: [[7]]}
    # a weak winding line that is strong at one end alone
    images[3] = [[20 if (x + y // 3) % 7 < 3 else 45 for x in range(20)] for y in range(15)]
    images[3][0][0:3] = [250, 250, 250]
    images[4] = [[min(255, abs(x - y) * 30) for x in range(12)] for y in range(12)]
    rows = [(i, y, x, c) for i, v in images.items() for y, row in enumerate(v) for x, c in enumerate(row)]
    pixels = spark.createDataFrame(rows, "image_id long, y int, x int, v int")
    got = {(r["image_id"], r["y"], r["x"]) for r in edges.edge_pixels(pixels).collect()}
    assert got == {(i, y, x) for i, v in images.items() for y, x in by_hand(v)}
    flagged = edges.with_edges(pixels)
    assert flagged.where("edge = 1").count() == len(got) and flagged.count() == len(rows)
    gate = {r["image_id"]: r["has_content"] for r in logo.content(flagged, "image_id").collect()}
    assert gate[2] and not gate[0]
    assert edges.edge_pixels(pixels.where(F.lit(False))).count() == 0


def test_edges_of_an_image_are_grown_inside_its_row(spark):
    """No turns over written tables: one plan, whose driver holds nothing that grows with the images."""
    rows = [(i, y, x, 255 * (x > 4)) for i in range(3) for y in range(8) for x in range(9)]
    pixels = spark.createDataFrame(rows, "image_id long, y int, x int, v int")
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("edges", "edges")
    found = edges.edge_pixels(pixels)
    assert not jobs.getJobIdsForGroup("edges") and "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 3 * 8
