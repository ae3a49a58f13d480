"""Derived point views over the given tables; the same SQL text runs on any engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pulseframe.session import cut_lineage
from pulseframe.sources.points import spread

# Each order gives four returns on a sloping 20 m wide strip, about 20 per m2.
POINTS_SQL = """
WITH src AS (SELECT o_orderkey AS ok, o_orderpriority AS pr, {gen} AS k FROM {orders}),
h AS (SELECT ok, k, pr, ok*4+k AS point_id,
  (ok*7919 + k*104729) % 2000 AS hx,
  (ok*6151 + k*15485863) % 1000 AS hy,
  (ok*3571 + k*611953) % 997 AS hz FROM src),
p AS (SELECT point_id, ok, k, pr, hz,
  CAST(hx AS DOUBLE)/100.0 AS x,
  CAST(ok AS DOUBLE)/100.0 + CAST(hy AS DOUBLE)/1000.0 AS y FROM h)
SELECT CAST(point_id AS BIGINT) AS point_id, x, y,
  CAST(0.05 AS DOUBLE)*x + CAST(0.02 AS DOUBLE)*y + CASE WHEN pr LIKE '1%' THEN CAST(3.0 AS DOUBLE)
                         WHEN pr LIKE '2%' THEN CAST(hz AS DOUBLE)/100.0
                         ELSE CAST(hz AS DOUBLE)/20000.0 END AS z,
  CAST(CASE WHEN pr LIKE '1%' THEN 6 WHEN pr LIKE '2%' THEN 5 ELSE 2 END AS INT) AS classification,
  CAST(1 + k % 2 AS INT) AS return_number,
  CAST(2 AS INT) AS number_of_returns,
  CASE WHEN hz % 7 = 0 THEN NULL ELSE CAST(hz AS DOUBLE) END AS intensity
FROM p
"""

DUCK_POINTS = POINTS_SQL.format(gen="unnest([0,1,2,3])", orders="orders")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``point_id, x, y, z, classification, return_number, number_of_returns, intensity``."""
    return spark.sql(POINTS_SQL.format(gen="explode(array(0,1,2,3))", orders="{src_orders}"),
                     src_orders=spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")))


# Sites of 1,600 returns, 40 m apart: ground grid, roof, wall, tree, wire and pole.
# Every fourth site has its wall apart from the roof, another one a broken wire,
# another one missing measurements.  Measured columns follow the part.
SCENE_SQL = """
WITH src AS (SELECT o_orderkey AS ok, {gen} AS k FROM {orders}),
a AS (SELECT ok*4+k AS point_id, CAST(FLOOR(ok/400.0) AS BIGINT) AS site, (ok % 400)*4+k AS j FROM src),
b AS (SELECT *, CASE WHEN j < 600 THEN 'ground' WHEN j < 1000 THEN 'roof' WHEN j < 1240 THEN 'wall'
        WHEN j < 1400 THEN 'tree' WHEN j < 1560 THEN 'wire' ELSE 'pole' END AS part,
      CASE WHEN j < 600 THEN j WHEN j < 1000 THEN j-600 WHEN j < 1240 THEN j-1000
        WHEN j < 1400 THEN j-1240 WHEN j < 1560 THEN j-1400 ELSE j-1560 END AS q FROM a),
c AS (SELECT *, CAST(FLOOR(q/10.0) AS BIGINT) AS q10, CAST(FLOOR(q/16.0) AS BIGINT) AS q16,
        CAST(FLOOR(q/30.0) AS BIGINT) AS q30, CAST(FLOOR(q/60.0) AS BIGINT) AS q60,
        CAST(FLOOR(q/100.0) AS BIGINT) AS q100, CAST(FLOOR(q/5.0) AS BIGINT) AS q5, site % 4 AS kind FROM b),
d AS (SELECT *,
  CASE part WHEN 'ground' THEN CAST(q % 30 AS DOUBLE) + 0.5
    WHEN 'roof' THEN CAST(q % 10 AS DOUBLE) + 5.1 + CAST(q100 AS DOUBLE)/5.0
    WHEN 'wall' THEN 5.1 + CAST(q60 AS DOUBLE)/10.0 + CASE WHEN kind = 1 THEN 12.0 ELSE 0.0 END
    WHEN 'tree' THEN 20.0 + CAST((q*7) % 40 AS DOUBLE)/10.0
    WHEN 'wire' THEN CAST(q % 16 AS DOUBLE) + 0.1 + CAST(q16 AS DOUBLE)/20.0 + CASE WHEN kind = 2 AND q % 16 >= 8 THEN 3.0 ELSE 0.0 END
    ELSE 0.4 END AS px,
  CASE part WHEN 'ground' THEN CAST(q30 AS DOUBLE) + 0.5
    WHEN 'roof' THEN CAST(q10 % 10 AS DOUBLE) + 5.3 + CAST(q100 AS DOUBLE)/10.0
    WHEN 'wall' THEN CAST(q % 10 AS DOUBLE) + 5.1 + CAST(q60 AS DOUBLE)/5.0
    WHEN 'tree' THEN 5.0 + CAST((q*13) % 40 AS DOUBLE)/10.0
    WHEN 'wire' THEN 18.2 ELSE 18.3 END AS py,
  CASE part WHEN 'ground' THEN 0.05 WHEN 'roof' THEN 6.2
    WHEN 'wall' THEN CAST(q10 % 6 AS DOUBLE) + 0.3 + CAST(q60 AS DOUBLE)/10.0
    WHEN 'tree' THEN 1.0 + CAST((q*11) % 50 AS DOUBLE)/10.0
    WHEN 'wire' THEN 8.4 ELSE CAST(q5 AS DOUBLE) + 0.2 + CAST(q % 5 AS DOUBLE)/10.0 END AS pz FROM c)
SELECT CAST(point_id AS BIGINT) AS point_id, site, part,
  CAST(px AS DOUBLE) AS x, CAST(py AS DOUBLE) + CAST(site*40 AS DOUBLE) AS y, CAST(pz AS DOUBLE) AS z,
  part = 'ground' AS is_ground,
  CAST(CASE part WHEN 'ground' THEN 2 WHEN 'roof' THEN 6 WHEN 'wall' THEN 6 WHEN 'tree' THEN 5 WHEN 'wire' THEN 14 ELSE 15 END AS INT) AS classification,
  CAST(CASE part WHEN 'ground' THEN 2 WHEN 'roof' THEN 6 WHEN 'wall' THEN 129 WHEN 'tree' THEN CASE WHEN q % 3 = 0 THEN 6 ELSE 5 END ELSE 1 END AS INT) AS working_class,
  CAST(1 AS INT) AS return_number,
  CAST(CASE WHEN part = 'tree' OR j % 17 = 0 THEN 2 ELSE 1 END AS INT) AS number_of_returns,
  CAST(CASE WHEN part = 'tree' AND j % 23 = 0 THEN NULL ELSE pz END AS DOUBLE) AS hag,
  CAST(CASE part WHEN 'ground' THEN 0.85 WHEN 'tree' THEN 0.2 + CAST(j % 20 AS DOUBLE)/100.0 WHEN 'wire' THEN 0.1 WHEN 'pole' THEN 0.1
    ELSE CASE WHEN j % 29 = 0 THEN 0.5 ELSE 0.8 + CAST(j % 10 AS DOUBLE)/100.0 END END AS DOUBLE) AS planarity_r2,
  CAST(CASE WHEN kind = 3 AND j % 37 = 0 THEN NULL ELSE CASE part WHEN 'ground' THEN 0.02 WHEN 'tree' THEN 0.25 + CAST(j % 10 AS DOUBLE)/100.0
    WHEN 'wire' THEN 0.03 WHEN 'pole' THEN 0.03 ELSE 0.05 END END AS DOUBLE) AS sphericity_r2,
  CAST(CASE part WHEN 'ground' THEN 0.99 WHEN 'roof' THEN 0.98 WHEN 'wall' THEN 0.05 WHEN 'tree' THEN 0.5 WHEN 'wire' THEN 0.6 ELSE 0.02 END AS DOUBLE) AS normal_z_absolute_r2,
  CAST(CASE part WHEN 'ground' THEN 0.8 WHEN 'tree' THEN 0.3 WHEN 'wire' THEN 0.1 WHEN 'pole' THEN 0.1 ELSE 0.7 END AS DOUBLE) AS planarity_r4,
  CAST(CASE part WHEN 'ground' THEN 0.02 WHEN 'tree' THEN 0.3 WHEN 'wire' THEN 0.05 WHEN 'pole' THEN 0.05 ELSE 0.1 END AS DOUBLE) AS sphericity_r4,
  CAST(CASE part WHEN 'wire' THEN 0.95 WHEN 'pole' THEN 0.95 ELSE 0.2 END AS DOUBLE) AS linearity_r2,
  CAST(CASE part WHEN 'wire' THEN 0.9 WHEN 'pole' THEN 0.9 ELSE 0.2 END AS DOUBLE) AS linearity_r4,
  CAST(CASE part WHEN 'wire' THEN 0.2 WHEN 'pole' THEN 3.5 ELSE 1.0 END AS DOUBLE) AS z_range_r2,
  CAST(CASE part WHEN 'wire' THEN 0.5 WHEN 'pole' THEN 6.0 ELSE 2.0 END AS DOUBLE) AS z_range_r4
FROM d
"""

DUCK_SCENE = SCENE_SQL.format(gen="unnest([0,1,2,3])", orders="orders")


def scene_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spatially coherent sites with measured columns, for the structure rules.

    Written once: the rules read it many times, and its long expressions would
    otherwise be inlined into every filter.
    """
    return cut_lineage(spark.sql(SCENE_SQL.format(gen="explode(array(0,1,2,3))", orders="{src_orders}"),
                     src_orders=spread(table(spark, sf_dir, "orders").select("o_orderkey"))))


# Label columns that follow from the point number: truth, prediction, confidence, measured scales.
LABELS = """
  CAST(CASE (point_id*31) % 10 WHEN 0 THEN 2 WHEN 1 THEN 5 WHEN 2 THEN -1 ELSE classification END AS INT) AS pred_class,
  CASE WHEN point_id % 13 = 0 THEN NULL ELSE CAST((point_id*37) % 101 AS DOUBLE)/100.0 END AS confidence,
  CASE WHEN point_id % 11 = 0 THEN NULL ELSE CAST((point_id*31) % 120 AS DOUBLE)/10.0 - 1.0 END AS hag,
  CASE WHEN point_id % 9 = 0 THEN NULL ELSE CAST((point_id*53) % 1000 AS DOUBLE)/1000.0 END AS score,
  (point_id*7) % 5 = 0 AS is_ground,
  CASE WHEN point_id % 3 = 0 THEN classification ELSE NULL END AS trusted_class,
  point_id % 3 = 0 AS is_trusted
"""


def labelled_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points view with derived label, prediction and height columns."""
    return points_view(spark, sf_dir).selectExpr("*", *[t.strip() for t in _split(LABELS)])


def _split(text: str) -> list[str]:
    """Split a select list at the commas that are outside parentheses."""
    out, depth, part = [], 0, ""
    for ch in text:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            out.append(part)
            part = ""
        else:
            part += ch
    return [*out, part]


DUCK_LABELLED = f"SELECT *, {LABELS} FROM ({DUCK_POINTS})"
