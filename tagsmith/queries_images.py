"""Queries of edges in images."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagsmith import fixtures as X
from tagsmith.operators import edges
from tagsmith.queries import _PIX, query


def _v(dy: int, dx: int) -> str:
    return f"vs[CAST(greatest(0, least(y + {dy}, 31)) * 32 + greatest(0, least(x + {dx}, 31)) + 1 AS int)]"


def _m(dy: int, dx: int) -> str:
    return f"CASE WHEN y + {dy} BETWEEN 0 AND 31 AND x + {dx} BETWEEN 0 AND 31 THEN ms[CAST((y + {dy}) * 32 + x + {dx} + 1 AS int)] ELSE 0 END"


@query(f"""WITH RECURSIVE {_PIX}, big AS (SELECT image_id // 16 AS image_id, (image_id % 16) // 4 * 8 + y AS y, image_id % 4 * 8 + x AS x, v FROM pix),
img AS (SELECT image_id, list(v ORDER BY y, x) AS vs FROM big GROUP BY image_id HAVING count(*) = 1024),
gr AS (SELECT image_id, i, y, x, ({_v(-1, 1)} + 2 * {_v(0, 1)} + {_v(1, 1)}) - ({_v(-1, -1)} + 2 * {_v(0, -1)} + {_v(1, -1)}) AS gx, ({_v(1, -1)} + 2 * {_v(1, 0)} + {_v(1, 1)}) - ({_v(-1, -1)} + 2 * {_v(-1, 0)} + {_v(-1, 1)}) AS gy
  FROM (SELECT image_id, vs, i, i // 32 AS y, i % 32 AS x FROM img CROSS JOIN range(1024) g(i))),
ma AS (SELECT image_id, list(abs(gx) + abs(gy) ORDER BY i) AS ms FROM gr GROUP BY image_id),
cand AS MATERIALIZED (SELECT image_id, y, x, m > 150 AS strong FROM (SELECT *, ms[CAST(i + 1 AS int)] AS m FROM gr JOIN ma USING (image_id)) WHERE m > 50 AND CASE
  WHEN abs(gy) < abs(gx) * 0.41421356237309503::double THEN m > {_m(0, -1)} AND m >= {_m(0, 1)} WHEN abs(gy) * 0.41421356237309503::double > abs(gx) THEN m > {_m(-1, 0)} AND m >= {_m(1, 0)}
  WHEN (gx < 0) <> (gy < 0) THEN m > {_m(-1, 1)} AND m > {_m(1, -1)} ELSE m > {_m(-1, -1)} AND m > {_m(1, 1)} END),
grown AS (SELECT image_id, y, x FROM cand WHERE strong UNION SELECT c.image_id, c.y, c.x FROM grown g JOIN cand c ON c.image_id = g.image_id AND abs(c.y - g.y) <= 1 AND abs(c.x - g.x) <= 1)
SELECT image_id, CAST(y AS int) AS y, CAST(x AS int) AS x FROM grown""")
def edge_pixels(spark, d):
    """Images of sixteen vectors each, 32 x 32; vectors that fill no image are left out."""
    pix = X.label_pixels(spark, d)
    big = pix.select(F.expr("image_id div 16").alias("image_id"), F.expr("(image_id % 16) div 4 * 8 + y").alias("y"), F.expr("image_id % 4 * 8 + x").alias("x"), "v")
    whole = big.groupBy("image_id").agg(F.count(F.lit(1)).alias("n")).where("n = 1024").select("image_id")
    return edges.edge_pixels(big.join(whole, "image_id", "left_semi"))
