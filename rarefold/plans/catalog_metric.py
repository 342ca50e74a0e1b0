"""Registered queries: neighbours and metric learning."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.seeded import seeded_matrix
from ..operators import lmnn, neighbors
from . import fixtures as fx
from .catalog import U, register

SQL_PAIRS = f"""WITH {fx.SQL_VEC_BIN},
pr AS (SELECT a.id AS i, b.id AS j, a.label = b.label AS same,
              list_sum(list_transform(list_zip(a.features, b.features), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) AS d2
       FROM vec_bin a JOIN vec_bin b ON a.id <> b.id),
tn AS (SELECT i, j, d2, r FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d2, j) AS r FROM pr WHERE same)
       WHERE r <= 3)"""


@register("g1_g3_target_neighbors", SQL_PAIRS + """
SELECT i AS qid, CAST(r AS INTEGER) AS nbr_rank, j AS nbr_id, round(sqrt(d2), 6) AS dist FROM tn""")
def g1_g3_target_neighbors(spark, sf):
    tn = neighbors.target_neighbors(fx.vec_bin(spark, sf), 3, cell_rows=64)
    return tn.select("qid", "nbr_rank", "nbr_id", F.round("dist", 6).alias("dist"))


@register("g4_impostors_identity", SQL_PAIRS + """,
far AS (SELECT i, max(d2) AS far FROM tn GROUP BY i),
imp AS (SELECT p.i, count(*) AS n FROM pr p JOIN far f ON p.i = f.i WHERE NOT p.same AND p.d2 < f.far + 1 GROUP BY p.i),
act AS (SELECT t.i, count(*) AS n FROM tn t JOIN pr p ON t.i = p.i AND NOT p.same AND 1 + t.d2 - p.d2 > 0 GROUP BY t.i)
SELECT v.id, coalesce(imp.n, 0)::BIGINT AS n_impostors, coalesce(act.n, 0)::BIGINT AS n_active
FROM vec_bin v LEFT JOIN imp ON v.id = imp.i LEFT JOIN act ON v.id = act.i""")
def g4_impostors_identity(spark, sf):
    return lmnn.impostor_counts(fx.vec_bin(spark, sf), block_rows=256)


@register("g5_lmnn_loss_identity", SQL_PAIRS + """,
h AS (SELECT sum(1 + t.d2 - p.d2) AS push FROM tn t JOIN pr p ON t.i = p.i AND NOT p.same AND 1 + t.d2 - p.d2 > 0),
pl AS (SELECT sum(d2) AS pull FROM tn)
SELECT round(pull, 6) AS pull, round(push, 6) AS push, round(0.5 * pull + 0.5 * push, 6) AS loss FROM pl, h""")
def g5_lmnn_loss_identity(spark, sf):
    v = fx.vec_bin(spark, sf)
    pull, push, loss = lmnn.loss_terms(v, block_rows=256)
    # the three sums are computed by Spark jobs over the whole table
    return spark.createDataFrame([(round(pull, 6), round(push, 6), round(loss, 6))],
                                 "pull double, push double, loss double")


@register("g6_lmnn_fit_transform", None)
def g6_lmnn_fit_transform(spark, sf):
    """Fit on all rows to its tolerance, map all rows."""
    v = fx.vec_bin(spark, sf)
    model = lmnn.fit(v)
    return lmnn.apply_map(v, model.maps["0"]).select("id", "label", F.transform("z", lambda t: F.round(t, 6)).alias("z"))


G7_DIM = 64


@register("g7_linear_map_arrow", f"""WITH {fx.SQL_VEC_BIN},
L AS (SELECT r, c, {U("'g7'", 'r', 'c')} - 0.5 AS w FROM range(0, {G7_DIM}) a(r), range(0, {G7_DIM}) b(c)),
x AS (SELECT id, unnest(features) AS v, unnest(generate_series(0, len(features) - 1)) AS c FROM vec_bin),
z AS (SELECT x.id, L.r, sum(L.w * x.v) AS s FROM x JOIN L ON x.c = L.c GROUP BY x.id, L.r)
SELECT id, list(round(s, 6) ORDER BY r) AS z FROM z GROUP BY id""")
def g7_linear_map_arrow(spark, sf):
    v = fx.vec_bin(spark, sf)
    L = np.array(seeded_matrix(fx.SEED, "g7", G7_DIM, G7_DIM))
    z = lmnn.apply_map(v, L)
    return z.select("id", F.transform("z", lambda t: F.round(t, 6)).alias("z"))
