"""Exact k nearest neighbours (G1-G3) on Voronoi cells.

Training rows live in the Voronoi cells of their key (``voronoi``), each in one
cell. Round 1 searches every query's own cell, which gives a k-th distance;
with the bound that cell sizes and radii give, it limits how far a neighbour can
be. Round 2 sends the query only to cells that can hold a row within that limit.
Cells near each other share a slot of up to ``SLOT_ROWS`` rows and a query goes
to a slot once, so vectors without structure, whose limits leave all cells, are
copied once per slot and not once per cell. A key with few rows has one cell and
no second round.

A cell or slot is searched on the block grid (``blocks``), so a hot cell is many
tasks. Per grid cell NumPy passes the right block in steps for every left row
with the Gram form, keeps every candidate within a tolerance of the k-th so far,
re-measures what is left exactly as ``sqrt(sum((x - y)^2))`` and emits at most k
rows per left row. Of equal vectors only those that can be emitted are passed.
The final top-k per left row is a window ``row_number() <= k`` over
``(key, qid)``, which Spark limits per task before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .blocks import LARGE32, column, grid, hits, lifted, matrix, scan_bound
from .voronoi import (SLACK, Cells, assign, by_key, cell_stats, distances, key_string, lower_bounds, pivots, slots,
                      upper_bound)

CHUNK = 512   # left rows per NumPy step inside a cell (bounds memory)
COLS = 4096   # right rows per NumPy step
FIRST = 512   # and in the steps that give a query its first limit
SPARSE = 0.03         # share of a step's pairs that are measured one by one, at most
MEASURE = 1 << 16     # pairs measured exactly at a time
SLOT_ROWS = 32_768    # training rows of a slot (cells searched together in round 2) at most
SLOTS = 8             # slots that all keys together are meant to have at least


def _first_copies(R: np.ndarray, tid: np.ndarray, tuid: np.ndarray, k: int) -> np.ndarray:
    """Rows that can be among the ``k`` nearest of some query: of equal vectors the
    first by (id, uid), ``k`` of an id and ``k + 1`` ids (a query may leave out its own)."""
    _, vec = np.unique(np.ascontiguousarray(R).view(np.dtype((np.void, R.shape[1] * R.itemsize))).ravel(), return_inverse=True)
    order = np.lexsort((tuid, tid, vec))
    v, i = vec[order], tid[order]
    new_vec = np.r_[True, v[1:] != v[:-1]]
    new_id = new_vec | np.r_[True, i[1:] != i[:-1]]
    ids = np.cumsum(new_id)
    at = np.arange(len(order))
    nth_id = ids - ids[np.maximum.accumulate(np.where(new_vec, at, 0))]
    nth = at - np.maximum.accumulate(np.where(new_id, at, 0))
    return np.sort(order[(nth_id <= k) & (nth < k)])


def _exact(Q: np.ndarray, R: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of the pairs (r, c), a bounded number at a time."""
    out = np.empty(len(r))
    for s in range(0, len(r), MEASURE):
        diff = Q[r[s:s + MEASURE]] - R[c[s:s + MEASURE]]
        out[s:s + MEASURE] = np.einsum("ij,ij->i", diff, diff)
    return out


def _nearest(Q: np.ndarray, R: np.ndarray, k: int, limit: np.ndarray, skip) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, row) that hold every query's ``k`` nearest rows within
    ``limit`` (a squared distance). Rows are passed some at a time; what is
    found so far lowers the limit. Once all queries have one, rows are scanned in
    single precision with room for its error, and what may be near is measured.
    ``skip(r, c)``: pairs that do not count."""
    qn, rn = np.einsum("ij,ij->i", Q, Q), np.einsum("ij,ij->i", R, R)
    most = rn.max(initial=0.0)
    tol = 1e-9 * 2.0 * (qn + most) + 1e-12
    limit, best = limit.copy(), np.full((len(Q), k), np.inf)
    single = bool(max(qn.max(initial=0.0), most) < LARGE32)
    A = B = None
    rows, cols, vals = [], [], []
    s = 0
    while s < len(R):
        scan = single and bool(np.all(limit < LARGE32))
        e = min(s + (COLS if scan or not single else max(FIRST, 8 * k)), len(R))
        near = None
        if scan:
            if A is None:
                A, B = lifted(Q, qn, True), lifted(R, rn, False)
            M = A @ B[s:e].T > scan_bound(limit + tol, qn, most, Q.shape[1])[:, None]
            if np.count_nonzero(M) <= SPARSE * M.size:
                near = hits(M)
        if near is None:
            approx = Q @ R[s:e].T
            approx *= -2.0
            approx += qn[:, None]
            approx += rn[None, s:e]
            width = approx.shape[1]
            open_ = np.flatnonzero(~np.isfinite(limit))
            if len(open_) and width > 4 * k:      # no limit yet: the k-th of these columns, without the pairs that do not count
                part = approx[open_]
                out = np.nonzero(skip(open_[:, None], s + np.arange(width)[None, :]))
                part[out] = np.inf
                limit[open_] = np.partition(part, k - 1, axis=1)[:, k - 1]
            r, c = np.nonzero(approx <= (limit + tol)[:, None])
        else:
            r, c = np.divmod(near, e - s)
        ok = ~skip(r, c + s)
        r, c = r[ok], c[ok]
        v = approx[r, c] if near is None else _exact(Q, R, r, c + s)
        c = c + s
        s = e
        if not len(r):
            continue
        rows.append(r), cols.append(c), vals.append(v)
        allr, allv = np.concatenate((np.repeat(np.arange(len(Q)), k), r)), np.concatenate((best.ravel(), v))
        order = np.lexsort((allv, allr))
        first = np.searchsorted(allr[order], np.arange(len(Q)))
        best = allv[order][first[:, None] + np.arange(k)[None, :]]
        limit = np.minimum(limit, best[:, k - 1])
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    r, c, v = np.concatenate(rows), np.concatenate(cols), np.concatenate(vals)
    near = v <= (limit + tol)[r]
    return r[near], c[near]


def _ranked(Q: np.ndarray, R: np.ndarray, tid: np.ndarray, tuid: np.ndarray, k: int, limit: np.ndarray, skip):
    """(query, row, squared distance) of at most ``k`` rows a query, by (distance, id, uid)."""
    r, c = _nearest(Q, R, k, limit, skip)
    exact = _exact(Q, R, r, c)
    order = np.lexsort((tuid[c], tid[c], exact, r))
    r, c, exact = r[order], c[order], exact[order]
    # position of each candidate inside its row's sorted run
    first = np.r_[0, np.flatnonzero(np.diff(r)) + 1]
    run_start = np.repeat(first, np.diff(np.r_[first, len(r)]))
    keep = (np.arange(len(r)) - run_start) < k
    return r[keep], c[keep], exact[keep]


def targets_of(X: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``target_neighbors`` of one class's rows in memory: places of each row's ``k``
    nearest rows of another id, and which of these there are."""
    at, have = np.zeros((len(X), k), np.int64), np.zeros((len(X), k), bool)
    kept = _first_copies(X, ids, ids, k)
    R, rid = X[kept], ids[kept]
    for s in range(0, len(X), CHUNK):
        own = ids[s:s + CHUNK]
        r, c, _ = _ranked(X[s:s + CHUNK], R, rid, rid, k, np.full(len(own), np.inf), lambda r, c, own=own: own[r] == rid[c])
        nth = np.arange(len(r)) - np.searchsorted(r, r)
        at[s + r, nth], have[s + r, nth] = kept[c], True
    return at, have


def _cell_topk(k: int, exclude_self: bool, key_fields: list[T.StructField],
               out_schema: T.StructType, further: bool):
    key_names = [f.name for f in key_fields]

    def fn(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0 or right.num_rows == 0:
            return pa.Table.from_pylist([], schema=out_schema_arrow)
        Q = matrix(left, "_f")
        R = matrix(right, "_f")
        qid = column(left, "_qid").astype(np.int64)
        tid = column(right, "_tid").astype(np.int64)
        tuid = column(right, "_tuid").astype(np.int64)
        tlab = column(right, "_tlab").astype(np.int64)
        own = column(left, "_cell") if further else None
        cell = column(right, "_cell") if further else None
        limit = left.column("_kth").combine_chunks().fill_null(np.inf).to_numpy(zero_copy_only=False) ** 2 \
            if further else np.full(len(qid), np.inf)
        keep = _first_copies(R, tid, tuid, k)
        if len(keep) < len(tid):
            R, tid, tuid, tlab = R[keep], tid[keep], tuid[keep], tlab[keep]
            cell = cell[keep] if further else None
        out_q, out_t, out_u, out_l, out_d = [], [], [], [], []
        for s in range(0, Q.shape[0], CHUNK):
            q, qi = Q[s:s + CHUNK], qid[s:s + CHUNK]

            def skip(r, c, s=s, qi=qi):
                no = np.zeros(np.broadcast_shapes(np.shape(r), np.shape(c)), dtype=bool)
                if exclude_self:
                    no |= qi[r] == tid[c]
                if further:                        # round 1 has searched the query's own cell
                    no |= own[s:s + CHUNK][r] == cell[c]
                return no

            r, c, exact = _ranked(q, R, tid, tuid, k, limit[s:s + CHUNK], skip)
            out_q.append(qi[r])
            out_t.append(tid[c])
            out_u.append(tuid[c])
            out_l.append(tlab[c])
            out_d.append(exact)
        n = sum(len(a) for a in out_q)
        cols = {}
        for name in key_names:
            cols[name] = pa.array([left.column(name)[0].as_py()] * n,
                                  type=out_schema_arrow.field(name).type)
        cols["qid"] = pa.array(np.concatenate(out_q), pa.int64())
        cols["nbr_id"] = pa.array(np.concatenate(out_t), pa.int64())
        cols["nbr_uid"] = pa.array(np.concatenate(out_u), pa.int64())
        cols["nbr_label"] = pa.array(np.concatenate(out_l).astype(np.int32), pa.int32())
        cols["d2"] = pa.array(np.concatenate(out_d), pa.float64())
        return pa.table(cols, schema=out_schema_arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    out_schema_arrow = to_arrow_schema(out_schema)
    return fn


def _search(q: DataFrame, t: DataFrame, keys: list[str], k: int, exclude_self: bool, block_rows: int,
            by: str = "_cell") -> DataFrame:
    """At most ``k`` candidates per query and grid cell of (keys, ``by``). By
    ``_slot``: within the queries' ``_kth``, outside of their own cells."""
    lrep, rrep, gcols = grid(q, t, keys + [by], "_qid", "_tuid", block_rows)
    key_fields = [lrep.schema[c] for c in keys]
    out_schema = T.StructType(
        key_fields + [T.StructField("qid", T.LongType()), T.StructField("nbr_id", T.LongType()),
                      T.StructField("nbr_uid", T.LongType()),
                      T.StructField("nbr_label", T.IntegerType()),
                      T.StructField("d2", T.DoubleType())])
    fn = _cell_topk(k, exclude_self, key_fields, out_schema, by == "_slot")
    return lrep.groupBy(*gcols).cogroup(rrep.groupBy(*gcols)).applyInArrow(fn, out_schema)


def _own_cells(q: DataFrame, cells: dict[str, Cells], keys: list[str]) -> DataFrame:
    """``q`` with ``_cell``: the cell with training rows whose pivot is nearest."""
    bc = q.sparkSession.sparkContext.broadcast(cells)
    d = q.withColumn("_k", key_string(keys))
    schema = T.StructType(list(d.schema.fields) + [T.StructField("_cell", T.IntegerType())])

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows == 0:
                continue
            t = pa.Table.from_batches([b])
            X, cell = matrix(t, "_f"), np.zeros(b.num_rows, np.int32)
            for key, i in by_key(t):
                c = bc.value.get(key)
                if c is not None and len(c.P) > 1:
                    cell[i] = np.where(c.n[None, :] > 0, distances(X[i], c.P), np.inf).argmin(axis=1)
            yield pa.RecordBatch.from_arrays(list(b.columns) + [pa.array(cell)], names=list(b.schema.names) + ["_cell"])

    return d.mapInArrow(fn, schema).drop("_k")


def _further_cells(q: DataFrame, cells: dict[str, Cells], keys: list[str], k: int,
                   slot_of: dict[str, np.ndarray] | None = None) -> DataFrame:
    """Round 2: ``q`` (with ``_cell``, and ``_kth``: the k-th distance found
    there, or null) once for every other cell that can hold a neighbour; with
    ``slot_of`` once for every slot (``_slot``) of such cells."""
    bc = q.sparkSession.sparkContext.broadcast((cells, slot_of))
    d = q.withColumn("_k", key_string(keys))
    out = [f for f in q.schema.fields if slot_of is not None or f.name != "_kth"]
    to_name = "_cell" if slot_of is None else "_slot"
    if slot_of is not None:
        out = out + [T.StructField("_slot", T.IntegerType())]

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, slots = bc.value
        for b in batches:
            if b.num_rows == 0:
                continue
            t = pa.Table.from_batches([b])
            X, own = matrix(t, "_f"), column(t, "_cell")
            kth = t.column("_kth").combine_chunks().fill_null(np.inf).to_numpy(zero_copy_only=False)
            rows, to = [], []
            for key, i in by_key(t):
                c = of.get(key)
                if c is None or len(c.P) == 1:
                    continue
                if slots is not None:              # which cells a slot has
                    has = np.arange(slots[key].max() + 1)[None, :] == slots[key][:, None]
                for s in range(0, len(i), CHUNK):
                    at = i[s:s + CHUNK]
                    D = distances(X[at], c.P)
                    limit = np.minimum(kth[at], upper_bound(c, D, k))
                    near = lower_bounds(c, D) <= (limit + SLACK * (1.0 + D.max(axis=1)))[:, None]
                    near &= (c.n > 0)[None, :]
                    near[np.arange(len(at)), own[at]] = False
                    r, j = np.nonzero(near if slots is None else near.astype(np.float32) @ has)
                    rows.append(at[r])
                    to.append(j.astype(np.int32))
            if not rows:
                continue
            rows, to = np.concatenate(rows), np.concatenate(to)
            for s in range(0, len(rows), len(own) or 1):          # no batch larger than what came in
                part = b.take(pa.array(rows[s:s + len(own)]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(to[s:s + len(own)]) if f.name == to_name else part.column(part.schema.get_field_index(f.name)) for f in out],
                    names=[f.name for f in out])

    return d.mapInArrow(fn, T.StructType(out))


def _top(cand: DataFrame, keys: list[str], k: int) -> DataFrame:
    w = Window.partitionBy(*keys, "qid").orderBy("d2", "nbr_id", "nbr_uid")
    return cand.withColumn("nbr_rank", F.row_number().over(w)).filter(F.col("nbr_rank") <= k)


def knn(queries: DataFrame, train: DataFrame, k: int = 5, *,
        key_cols: Sequence[str] = (), id_col: str = "id", feat_col: str = "features",
        label_col: str = "label", train_uid: str | None = None,
        exclude_self: bool = False, block_rows: int = 2048, cell_rows: int | None = None) -> DataFrame:
    """G1: the ``k`` nearest ``train`` rows (Euclidean) of every query row,
    inside ``key_cols``. Ties by (distance, train id, train uid).

    Output: ``key_cols, qid, nbr_rank, nbr_id, nbr_label, dist``. A query whose
    key has no training row gets one row in which the neighbour's columns are
    null (``knn_predict``: no probability, no prediction).
    ``train_uid`` names a unique long per train row when ids repeat (bags);
    ``cell_rows`` is the number of training rows meant for a cell (default: a block)."""
    keys = list(key_cols)
    uid = train_uid or id_col
    q = queries.select(*keys, F.col(id_col).cast("long").alias("_qid"),
                       F.col(feat_col).cast("array<double>").alias("_f"))
    t = train.select(*keys, F.col(id_col).cast("long").alias("_tid"),
                     F.col(uid).cast("long").alias("_tuid"),
                     F.col(label_col).cast("int").alias("_tlab"),
                     F.col(feat_col).cast("array<double>").alias("_f"))
    pv = pivots(t, keys, "_tuid", "_f", cell_rows or block_rows)
    if all(len(p) == 1 for p in pv.values()):        # one cell a key: the grid alone
        one = lambda df: df.withColumn("_cell", F.lit(0))
        top = _top(_search(one(q), one(t), keys, k, exclude_self, block_rows), keys, k)
    else:
        t = materialize(assign(t, pv, keys, "_f"), "knn-cells")
        cells = cell_stats(t, pv, keys)
        q = materialize(_own_cells(q, cells, keys), "knn-queries")
        first = materialize(_top(_search(q, t, keys, k, exclude_self, block_rows), keys, k).drop("nbr_rank"), "knn-first")
        kth = first.groupBy(*keys, F.col("qid").alias("_qid")).agg(
            F.when(F.count(F.lit(1)) >= k, F.sqrt(F.max("d2"))).alias("_kth"))
        # round 2 by slots: a query goes once to all cells of a slot, however many of them are near
        n = sum(int(c.n.sum()) for c in cells.values())
        slot_rows = max(block_rows, min(SLOT_ROWS, n // SLOTS))
        slot_of = {key: slots(c, slot_rows) for key, c in cells.items()}
        named = q.sparkSession.createDataFrame(
            [(key, i, int(x)) for key, own in slot_of.items() for i, x in enumerate(own)], "_k string, _cell int, _slot int")
        placed = t.withColumn("_k", key_string(keys)).join(F.broadcast(named), ["_k", "_cell"]).drop("_k")    # a row per cell
        further = _further_cells(q.join(kth.hint("merge"), on=keys + ["_qid"], how="left"), cells, keys, k + exclude_self, slot_of)
        top = _top(_search(further, placed, keys, k, exclude_self, slot_rows, "_slot").unionByName(first), keys, k)
    cols = keys + ["qid", "nbr_rank", "nbr_id", "nbr_label", "dist"]
    if train_uid:
        cols.insert(len(keys) + 3, "nbr_uid")
    top = top.withColumn("dist", F.sqrt("d2")).select(*cols)
    known = F.broadcast(q.sparkSession.createDataFrame([(x,) for x in pv], "_k string"))    # one row per key
    alone = q.select(*keys, F.col("_qid").alias("qid"), key_string(keys).alias("_k")).join(known, on="_k", how="left_anti")
    return top.unionByName(alone.drop("_k"), allowMissingColumns=True)


def knn_predict(neigh: DataFrame, key_cols: Sequence[str] = ()) -> DataFrame:
    """Uniform vote of the neighbours: ``proba`` = share of positives,
    ``pred`` = 1 when it exceeds one half (binary labels 0/1); both are null
    for a query without neighbours."""
    keys = list(key_cols)
    return (neigh.groupBy(*keys, "qid")
            .agg(F.avg(F.col("nbr_label").cast("double")).alias("proba"))
            .withColumn("pred", (F.col("proba") > 0.5).cast("int")))


def target_neighbors(df: DataFrame, k: int = 3, *, key_cols: Sequence[str] = (),
                     id_col: str = "id", feat_col: str = "features",
                     label_col: str = "label", block_rows: int = 2048, cell_rows: int | None = None) -> DataFrame:
    """The k nearest rows of the same class (self excluded)."""
    keys = list(key_cols)
    d = df.withColumn("_cls", F.col(label_col).cast("int"))
    return knn(d, d, k, key_cols=keys + ["_cls"], id_col=id_col, feat_col=feat_col,
               label_col=label_col, exclude_self=True, block_rows=block_rows, cell_rows=cell_rows
               ).where("nbr_rank IS NOT NULL").withColumnRenamed("_cls", "label")
