"""Large-margin nearest neighbour metric learning (G3-G7), distributed.

Objective (Weinberger & Saul, 2009) for a linear map L:
    f(L) = (1 - mu) * sum_ij |L(xi - xj)|^2
           + mu * sum_ijl [1 + |L(xi - xj)|^2 - |L(xi - xl)|^2]_+
with j one of the k nearest same-class rows of i (fixed in input space) and
l any row of another class. Gradient: 2 L G with
    G = (1 - mu) sum_ij C_ij + mu * sum_active (C_ij - C_il),  C_ab = (xa - xb)(xa - xb)^T.

Layout. The rows of a (member, class) are cut into blocks of at most about
``block_rows`` rows along its Voronoi cells, and every block is written once, as
one row of NumPy buffers: its vectors and their target vectors. What meets is a
list of block pairs, ids only. A pair is left out when no row of its right
block can be an impostor of its left one: the blocks' centroids are further
apart under the map than both radii and the widest margin together. The bound
is taken with room for maps near the one it was taken at (``ROOM``), so the
active pairs stay exact until the map has moved that far, and are then taken
anew. Active pairs are dealt in tiles of up to ``TILE_ROWS`` rows a side, so a row
is copied once per tile and not once per block that it meets; a tile's task
emits d x d partial sums, added JVM-side. Tiles are kept in Spark's cache between
refreshes while they take at most ``KEEP`` times the blocks' rows; beyond that
every iteration shuffles the blocks to their tiles again and sums them where they
arrive, so what is stored stays linear in the rows. The driver holds L and G per
member and a centroid, radius and margin per block. Members (bags, rounds, folds)
are a key column, so many models train in the same jobs. Members of bounded size
(``LOCAL_ROWS``) are each fitted by a task of its own, from their rows to their map, all
of them in one job with the same steps; nothing of them is written but their rows.

The objective is divided by the number of target pairs, so the learning rate
does not depend on the data size.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize, release, row_join
from . import voronoi
from .blocks import LARGE32, column, hits, lifted, matrix, scan_bound
from .neighbors import target_neighbors, targets_of

CHUNK = 512
COLS = 2048         # other rows in a NumPy step
SPARSE = 0.03       # share of a step's pairs that are measured one by one, at most
PAIRS = 8192        # of these in a NumPy step
#: How much longer or shorter a vector may get under a later map before the
#: active block pairs are taken anew.
ROOM = 1.25
TILE_ROWS = 16_384  # rows a side of a tile, at most (a block's at least)
SIDES = 8           # sides that all rows together are meant to make at least
KEEP = 8            # tiles' rows in cache, as a multiple of the blocks' rows
LOCAL_ROWS = 65_536         # a member with at most so many rows may be fitted by one task
LOCAL_BYTES = 384 << 20     # if its vectors and target vectors take at most so many bytes
ALONE_ROWS = 16_384         # and is, however few the members are, with at most so many rows


def _member(df: DataFrame, member_col: str | None) -> DataFrame:
    m = F.col(member_col).cast("string") if member_col else F.lit("0")
    return df.withColumn("_m", m)


_BLOCK = T.StructType([
    T.StructField("_m", T.StringType()), T.StructField("_cls", T.IntegerType()), T.StructField("_b", T.StringType()),
    T.StructField("n", T.IntegerType()), T.StructField("d", T.IntegerType()), T.StructField("ids", T.BinaryType()),
    T.StructField("xi", T.BinaryType()), T.StructField("xt", T.BinaryType()), T.StructField("tm", T.BinaryType())])


def _pack_blocks(rows: DataFrame, tn: DataFrame, k: int, block_rows: int) -> DataFrame:
    """One row per block of a (member, class): ids, vectors and target vectors."""
    keys = ["_m", "label"]
    pv = voronoi.pivots(rows, keys, "id", "features", block_rows)
    cells = voronoi.assign(rows, pv, keys, "features")
    # a cell with more rows than a block is cut by hash; one row per (member, class, cell)
    per = F.broadcast(cells.groupBy(*keys, "_cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).alias("_nb")))
    placed = cells.join(per, keys + ["_cell"]).withColumn(
        "_b", F.concat_ws(".", F.format_string("%05d", "_cell"), F.pmod(F.xxhash64("id"), "_nb")))
    tgt = tn.groupBy("_m", "qid").agg(
        F.sort_array(F.collect_list(F.struct("nbr_rank", "_xj"))).alias("_t"))  # <= k each
    placed = row_join(placed, tgt.withColumnRenamed("qid", "id"), ["_m", "id"], "left").select(
        "_m", F.col("label").alias("_cls"), "_b", "id", "features",
        F.coalesce(F.size("_t"), F.lit(0)).alias("_nt"),
        F.coalesce(F.flatten(F.transform("_t", lambda s: s["_xj"])), F.array().cast("array<double>")).alias("_xt"))

    def pack(key, t):
        X = matrix(t, "features")
        n, d = X.shape
        nt = np.clip(column(t, "_nt"), 0, k)
        tm = np.arange(k)[None, :] < nt[:, None]
        Xt = np.zeros((n, k, d))
        Xt[tm] = t.column("_xt").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
        return pa.Table.from_pydict(
            {"_m": [key[0].as_py()], "_cls": [key[1].as_py()], "_b": [key[2].as_py()], "n": [n], "d": [d],
             "ids": [column(t, "id").astype(np.int64).tobytes()], "xi": [X.tobytes()], "xt": [Xt.tobytes()],
             "tm": [tm.tobytes()]}, schema=_arrow(_BLOCK))

    return placed.groupBy("_m", "_cls", "_b").applyInArrow(pack, _BLOCK)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(schema)


def _unpack(r: dict):
    ids = np.frombuffer(r["ids"], dtype=np.int64)
    n, d = r["n"], r["d"]
    tm = np.frombuffer(r["tm"], dtype=bool).reshape(n, -1)
    return (ids, np.frombuffer(r["xi"]).reshape(n, d), np.frombuffer(r["xt"]).reshape(n, tm.shape[1], d), tm)


def _records(t) -> Iterator[dict]:
    """Blocks of an Arrow table or batch, one at a time."""
    for i in range(t.num_rows):
        yield t.slice(i, 1).to_pylist()[0]


@dataclass
class Blocks:
    """Written blocks, and their names on the driver: (member, class, block, rows)."""
    table: DataFrame
    names: list[tuple[str, int, str, int]]


def _summaries(blocks: Blocks, maps: dict[str, np.ndarray]) -> dict[tuple, tuple]:
    """Per block under its member's map: centroid, radius, and the largest
    squared distance of a row to one of its targets. One linear pass."""
    bc = blocks.table.sparkSession.sparkContext.broadcast(maps)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in _records(b):
                _, X, Xt, tm = _unpack(r)
                L = bc.value[r["_m"]]
                Z = X @ L.T
                c = Z.mean(axis=0)
                dt = np.einsum("qkd,qkd->qk", D := (X[:, None, :] - Xt) @ L.T, D)
                yield pa.RecordBatch.from_pydict(
                    {"_m": [r["_m"]], "_cls": pa.array([r["_cls"]], pa.int32()), "_b": [r["_b"]],
                     "v": [np.concatenate([c, [np.sqrt(((Z - c) ** 2).sum(axis=1).max()),
                                               np.where(tm, dt, -np.inf).max(initial=-np.inf)]]).tolist()]})

    got = blocks.table.mapInArrow(fn, "_m string, _cls int, _b string, v array<double>").collect()
    out = {}
    for r in got:                                             # n / block_rows rows
        v = np.asarray(r["v"])
        out[(r["_m"], r["_cls"], r["_b"])] = (v[:-2], v[-2], v[-1])
    return out


def active_pairs(blocks: Blocks, maps: dict[str, np.ndarray], room: float = ROOM) -> list[tuple[str, int, str, int, str]]:
    """(member, class, block, other class, block) that can hold an impostor under
    ``maps`` or any map that stretches no vector by more than ``room`` and
    shrinks none by more, against ``maps``."""
    by: dict[str, list] = {}
    for m, c, b, _ in blocks.names:
        if m in maps:
            by.setdefault(m, []).append((c, b))
    out = []
    # a member with one block a class has nothing to leave out
    wide = {m: own for m, own in by.items() if len(own) > len({c for c, _ in own})}
    stats = _summaries(blocks, maps) if wide else {}
    for m, own in by.items():
        cls = np.array([c for c, _ in own])
        meet = cls[:, None] != cls[None, :]
        if m in wide:
            c, r, far = (np.array(x) for x in zip(*(stats[(m, *o)] for o in own)))
            # d0 / room <= d and far <= room^2 far0: beyond this no row of the right block is inside the margin
            reach = room * np.sqrt(np.maximum(1.0 + room ** 2 * far, 0.0))
            apart = voronoi.distances(c, c) - r[:, None] - r[None, :]
            meet &= apart <= (reach * (1 + voronoi.SLACK) + voronoi.SLACK)[:, None]
            meet &= np.isfinite(far)[:, None]
        out += [(m, *own[i], *own[j]) for i, j in zip(*np.nonzero(meet))]
    return out


_TILE = T.StructType([T.StructField("_m", T.StringType()), T.StructField("left", T.ArrayType(T.StructType(
    [f for f in _BLOCK.fields if f.name not in ("_m", "_cls", "_b")] + [T.StructField("meets", T.ArrayType(T.IntegerType()))]))),
    T.StructField("right", T.ArrayType(T.BinaryType()))])


def _dealt(blocks: Blocks, pairs: list[tuple]) -> tuple[dict, dict, int]:
    """``pairs`` by tile: (tile, left block) -> right blocks, (tile, right block),
    and the rows that all tiles read."""
    at: dict[tuple, int] = {}
    held: dict[tuple, tuple[int, int]] = {}
    size: dict[tuple, int] = {}
    most = min(TILE_ROWS, sum(x[-1] for x in blocks.names) // SIDES)
    for m, c, b, rows in blocks.names:
        side, n = held.get((m, c), (0, 0))
        if n and n + rows > most:
            side, n = side + 1, 0
        at[(m, c, b)] = side
        held[(m, c)] = (side, n + rows)
        size[(m, c, b)] = rows
    left: dict[tuple, list] = {}
    right: dict[tuple, None] = {}
    for m, c, b, c2, b2 in pairs:
        tile = f"{m}/{c}/{at[(m, c, b)]}/{c2}/{at[(m, c2, b2)]}"
        left.setdefault((tile, m, c, b), []).append(f"{c2}/{b2}")
        right[(tile, m, c2, b2)] = None
    return left, right, sum(size[x[1:]] for own in (left, right) for x in own)


class Tiles:
    """Active pairs by tile: kept in Spark's cache, or cogrouped anew by every pass."""

    def __init__(self, blocks: Blocks, pairs: list[tuple]):
        spark = blocks.table.sparkSession
        left, right, rows = _dealt(blocks, pairs)
        lmap = spark.createDataFrame([(*x, y) for x, y in left.items()], "_tile string, _m string, _cls int, _b string, _with array<string>")
        rmap = spark.createDataFrame(list(right), "_tile string, _m string, _cls int, _b string")
        on = ["_m", "_cls", "_b"]
        # ids only: a row per block and tile
        self.left = blocks.table.join(F.broadcast(lmap), on).groupBy("_tile")
        self.right = blocks.table.select(*on, F.col("xi").alias("xl")).join(F.broadcast(rmap), on).select(
            F.col("_tile").alias("_rt"), F.concat_ws("/", F.col("_cls").cast("string"), "_b").alias("_name"), "xl").groupBy("_rt")
        self.sparkSession, self.kept = spark, None
        if rows <= KEEP * sum(x[-1] for x in blocks.names):
            self.kept = self.left.cogroup(self.right).applyInArrow(
                lambda lt, rt: _pack_tile(lt, rt), _TILE).persist(StorageLevel.MEMORY_AND_DISK)

    @property
    def is_cached(self) -> bool:
        return self.kept is not None

    def map(self, fn, ddl: str) -> DataFrame:
        """``fn`` over batches of tiles."""
        if self.kept is not None:
            return self.kept.mapInArrow(fn, ddl)
        schema = _arrow(T._parse_datatype_string(ddl))

        def run(lt: pa.Table, rt: pa.Table) -> pa.Table:
            if not lt.num_rows or not rt.num_rows:
                return schema.empty_table()
            return pa.Table.from_batches([b.cast(schema) for b in fn(iter([_pack_tile(lt, rt)]))], schema=schema)

        return self.left.cogroup(self.right).applyInArrow(run, ddl)

    def unpersist(self) -> None:
        if self.kept is not None:
            self.kept.unpersist()


def _pack_tile(lt: pa.Table, rt: pa.Table) -> pa.Table:
    place = {name: i for i, name in enumerate(rt.column("_name").to_pylist())}
    own = [{"n": r["n"], "d": r["d"], "ids": r["ids"], "xi": r["xi"], "xt": r["xt"], "tm": r["tm"],
            "meets": [place[x] for x in r["_with"]]} for r in lt.to_pylist()]
    return pa.Table.from_pydict({"_m": [lt.column("_m")[0].as_py()], "left": [own], "right": [rt.column("xl").to_pylist()]},
                                schema=_arrow(_TILE))


def _tiles(blocks: Blocks, pairs: list[tuple]) -> Tiles:
    """One row a tile: its left blocks, each with the places of the right blocks
    that it meets, and the right blocks' vectors."""
    return Tiles(blocks, pairs)


def _cells(t) -> Iterator[tuple]:
    """(member, ids, Xi, Xt, tm, Xl) of every left block of a batch of tiles."""
    for r in _records(t):
        right = [np.frombuffer(x) for x in r["right"]]
        for block in r["left"]:
            ids, Xi, Xt, tm = _unpack(block)
            yield r["_m"], ids, Xi, Xt, tm, np.concatenate([right[i] for i in block["meets"]]).reshape(-1, Xi.shape[1])


class Side:
    """Rows of one class: vectors, vectors to their targets and the mask of these
    (None: the rows are impostors only), and how many equal rows each stands for."""

    def __init__(self, X: np.ndarray, Xt: np.ndarray | None = None, tm: np.ndarray | None = None, w: np.ndarray | None = None):
        self.X, self.w = X, np.ones(len(X)) if w is None else w
        self.T, self.tm = (None, None) if Xt is None else (X[:, None, :] - Xt, tm)

    @classmethod
    def compact(cls, X: np.ndarray, Xt: np.ndarray, tm: np.ndarray) -> Side:
        """Rows that agree in their vector and all targets once (bootstrap slots repeat rows)."""
        key = np.concatenate([X, Xt.reshape(len(X), -1), tm], axis=1)
        _, at, n = np.unique(np.ascontiguousarray(key).view(np.dtype((np.void, key.shape[1] * key.itemsize))).ravel(),
                             return_index=True, return_counts=True)
        order = np.argsort(at)
        return cls(X[at[order]], Xt[at[order]], tm[at[order]], n[order].astype(np.float64))

    def under(self, L: np.ndarray) -> Side:
        """Images under ``L``, thresholds ``1 + d_ij`` and empty counts: ``a`` per target,
        ``imp`` impostors, ``b`` active triplets a row is the owner or the impostor of."""
        self.Z = self.X @ L.T
        self.z2 = np.einsum("ij,ij->i", self.Z, self.Z)
        self.b = np.zeros(len(self.X))
        if self.T is not None:
            n, k, d = self.T.shape
            TL = self.T.reshape(-1, d) @ L.T
            self.thr = np.where(self.tm, 1.0 + np.einsum("ij,ij->i", TL, TL).reshape(n, k), -np.inf)
            self.far = self.thr.max(axis=1, initial=-np.inf)
            self.a, self.imp = np.zeros((n, k)), np.zeros(n)
        return self

    def own_terms(self) -> tuple[float, np.ndarray]:
        """Sum of the active thresholds and sum_ij a_ij C_ij, after ``pair_terms``."""
        T = self.T.reshape(-1, self.X.shape[1])
        return float(np.where(self.a > 0, self.thr * self.a, 0.0).sum()), (T.T * self.a.ravel()) @ T


def _dense(owners, dil: np.ndarray, p: Side, q: Side, rs: slice, cs: slice) -> tuple[float, np.ndarray]:
    """All pairs of a block: sum of the active distances, triplets per pair."""
    b = np.zeros(dil.shape, np.uint16)
    for side, left, _ in owners:
        own, other = (rs, q.w[cs]) if left else (cs, p.w[rs])
        before = b.copy() if len(owners) > 1 else 0
        for j in range(side.thr.shape[1]):             # active with target j: 1 + d_ij > d_il
            act = dil < (side.thr[own, j, None] if left else side.thr[None, own, j])
            b += act
            side.a[own, j] += side.w[own] * (act @ other if left else other @ act)
        some = b > before
        side.imp[own] += some @ other if left else other @ some
    W = b * p.w[rs, None]
    W *= q.w[None, cs]
    p.b[rs] += W.sum(axis=1)
    q.b[cs] += W.sum(axis=0)
    return float(np.einsum("ij,ij->", W, dil)), W


def _sparse(side: Side, left: bool, r: np.ndarray, c: np.ndarray, p: Side, q: Side, rs: slice, cs: slice) -> tuple[float, np.ndarray, np.ndarray]:
    """The same for some pairs of the block, p's rows in order: sum of the active
    distances, p's rows and the sums of their impostors."""
    D = p.Z[rs][r]
    D -= q.Z[cs][c]
    dil = np.einsum("ij,ij->i", D, D)
    own = rs if left else cs
    ok = np.flatnonzero(dil < side.far[own][r if left else c])
    if not len(ok):
        return 0.0, ok, D[:0]
    r, c, dil = r[ok], c[ok], dil[ok]
    i, other = (r, q.w[cs][c]) if left else (c, p.w[rs][r])
    n, w = own.stop - own.start, side.w[own][i] * other
    thr, b = side.thr[own], np.zeros(len(i))
    for j in range(thr.shape[1]):
        act = w * (thr[i, j] > dil)
        side.a[own, j] += np.bincount(i, weights=act, minlength=n)
        b += act
    side.imp[own] += np.bincount(i, weights=other, minlength=n)
    p.b[rs] += np.bincount(r, weights=b, minlength=rs.stop - rs.start)
    q.b[cs] += np.bincount(c, weights=b, minlength=cs.stop - cs.start)
    V = q.X[cs][c]
    V *= b[:, None]
    first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
    return float(b @ dil), r[first], np.add.reduceat(V, first, axis=0)


def pair_terms(p: Side, q: Side, both: bool) -> tuple[float, np.ndarray]:
    """Active triplets of p's rows with impostors in q (``both``: and of q's rows in p),
    exactly: the sum of their distances d_il and sum b_il (x_i - x_l)(x_i - x_l)^T; the
    sides count. Distances are scanned once, in single precision with room for its
    error, and what may be active is measured again in double precision. Where much
    is active, all pairs of the block are measured."""
    d, owners = p.X.shape[1], [(p, True, p)] + ([(q, False, q)] if both else [])
    most = [x.z2.max(initial=0.0) for x in (p, q)] + [np.where(x.tm, x.thr, 0.0).max(initial=0.0) for x, _, _ in owners]
    single = bool(np.max(most) < LARGE32)                                   # False for numbers that are none
    owners = [(x, left, scan_bound(x.far, x.z2, most[left], d) if single else None) for x, left, _ in owners]
    if single:
        A, B = lifted(p.Z, p.z2, True), lifted(q.Z, q.z2, False)
        S_, M_ = np.empty(CHUNK * COLS, np.float32), np.empty(CHUNK * COLS, bool)
    total, cross = 0.0, np.zeros((d, d))
    for s in range(0, len(p.X), CHUNK):
        rs = slice(s, min(s + CHUNK, len(p.X)))
        P = np.zeros((rs.stop - s, d))                             # sum_l b_il x_l
        for c in range(0, len(q.X), COLS):
            cs = slice(c, min(c + COLS, len(q.X)))
            h, w = rs.stop - s, cs.stop - c
            found = []
            if single:
                S, M = S_[:h * w].reshape(h, w), M_[:h * w].reshape(h, w)
                np.matmul(A[rs], B[cs].T, out=S)
                for _, left, low in owners:
                    np.greater(S, low[rs, None] if left else low[None, cs], out=M)
                    if np.count_nonzero(M) > SPARSE * M.size:
                        break
                    found.append(hits(M))
            if len(found) < len(owners):
                dil = p.Z[rs] @ q.Z[cs].T
                dil *= -2.0
                dil += p.z2[rs, None]
                dil += q.z2[None, cs]
                part, W = _dense(owners, np.maximum(dil, 0.0, out=dil), p, q, rs, cs)
                total += part
                P += W @ q.X[cs]
                continue
            for (side, left, _), near in zip(owners, found):
                for x in range(0, len(near), PAIRS):
                    part, at, sums = _sparse(side, left, *np.divmod(near[x:x + PAIRS], w), p, q, rs, cs)
                    total += part
                    P[at] += sums
        cross += p.X[rs].T @ P
    return total, (p.X.T * p.b) @ p.X + (q.X.T * q.b) @ q.X - cross - cross.T


def cell_terms(Xi, Xt, tm, Xl, L, mu):
    """Impostor part of one cell: (mu * sum_active (C_ij - C_il), hinge sum,
    active count, per-row active counts, per-row impostor counts)."""
    p, q = Side(Xi, Xt, tm).under(L), Side(Xl).under(L)
    far, push = pair_terms(p, q, False)
    near, pull = p.own_terms()
    act = p.a.sum(axis=1).astype(np.int64)
    return mu * (pull - push), near - far, int(act.sum()), act, p.imp.astype(np.int64)


def member_terms(sides: list[Side], L: np.ndarray, mu: float) -> tuple[float, np.ndarray]:
    """Hinge sum and impostor gradient of one member's classes."""
    hinge, push = 0.0, np.zeros((L.shape[1],) * 2)
    for x in sides:
        x.under(L)
    for i, p in enumerate(sides):
        for q in sides[i + 1:]:
            p.b, q.b = np.zeros(len(p.X)), np.zeros(len(q.X))
            far, G = pair_terms(p, q, True)
            hinge, push = hinge - far, push + G
    pull = np.zeros_like(push)
    for x in sides:
        near, G = x.own_terms()
        hinge, pull = hinge + near, pull + G
    return hinge, mu * (pull - push)


@dataclass
class LMNNModel:
    maps: dict[str, np.ndarray]
    history: list[dict] = field(default_factory=list)


def _mat_batch(m: str, scalar: float, M: np.ndarray) -> pa.RecordBatch:
    """One member's scalar and d x d matrix as one vector row [scalar, M...]."""
    return pa.RecordBatch.from_arrays(
        [pa.array([m], pa.string()),
         pa.array([np.concatenate([[scalar], M.ravel()]).tolist()], pa.list_(pa.float64()))],
        names=["_m", "v"])


def _vec_sum(part: DataFrame) -> DataFrame:
    """Per-partition vectors added JVM-side (partial aggregation)."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    return part.groupBy("_m").agg(vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v"))


def _target_stats(blocks: Blocks) -> dict[str, tuple[float, np.ndarray]]:
    """Per member: the number of target pairs and sum_ij C_ij, in one linear pass."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc: dict[str, tuple] = {}
        for b in batches:
            for r in _records(b):
                _, X, Xt, tm = _unpack(r)
                D = (X[:, None, :] - Xt)[tm]
                n, C = acc.get(r["_m"], (0, 0.0))
                acc[r["_m"]] = n + len(D), C + D.T @ D
        for m, (n, C) in acc.items():
            yield _mat_batch(m, float(n), C)

    return _collect_mats(_vec_sum(blocks.table.mapInArrow(fn, "_m string, v array<double>")))


def _collect_mats(df: DataFrame) -> dict[str, tuple[float, np.ndarray]]:
    """Per member ``(scalar, d x d)``."""
    out = {}
    for r in df.collect():  # one [scalar, d*d] vector per member: model-sized
        v = np.asarray(r["v"])
        d = int(round((len(v) - 1) ** 0.5))
        out[r["_m"]] = (float(v[0]), v[1:].reshape(d, d))
    return out


def _step_job(tiles: Tiles, maps: dict[str, np.ndarray], mu: float) -> DataFrame:
    """Hinge sum and impostor gradient of the members in ``maps``."""
    bc = tiles.sparkSession.sparkContext.broadcast(maps)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Ls = bc.value
        acc: dict[str, np.ndarray] = {}
        hin: dict[str, float] = {}
        for b in batches:
            for m, _, Xi, Xt, tm, Xl in _cells(b):
                if m not in Ls:
                    continue
                G, h, _, _, _ = cell_terms(Xi, Xt, tm, Xl, Ls[m], mu)
                acc[m] = acc.get(m, 0) + G
                hin[m] = hin.get(m, 0.0) + h
        for m, G in acc.items():
            yield _mat_batch(m, hin[m], G)

    return _vec_sum(tiles.map(fn, "_m string, v array<double>"))


def _rows(df: DataFrame, member_col: str | None) -> DataFrame:
    rows = _member(df.select(*([member_col] if member_col else []), "id",
                             F.col("features").cast("array<double>").alias("features"),
                             F.col("label").cast("int").alias("label")), member_col)
    return materialize(rows.select("_m", "id", "features", "label"), "lmnn-rows")  # read by several passes


def _blocks(rows: DataFrame, k: int, block_rows: int) -> Blocks:
    tn = target_neighbors(rows, k, key_cols=["_m"], block_rows=block_rows)
    feats = rows.select("_m", F.col("id").alias("nbr_id"), F.col("features").alias("_xj"))
    tn = row_join(tn, feats, ["_m", "nbr_id"])
    table = materialize(_pack_blocks(rows, tn, k, block_rows), "lmnn-blocks")
    names = sorted(tuple(r) for r in table.select("_m", "_cls", "_b", "n").collect())   # n / block_rows rows
    return Blocks(table, names)


def prepare(df: DataFrame, k: int = 3, member_col: str | None = None, block_rows: int = 2048) -> Blocks:
    """Target neighbours (fixed through training) and the written blocks."""
    rows = _rows(df, member_col)
    blocks = _blocks(rows, k, block_rows)
    release(rows)
    return blocks


def _moved(L: np.ndarray, since: np.ndarray) -> bool:
    """Whether some vector is now more than ``ROOM`` times longer or shorter."""
    if np.array_equal(L, since):
        return False
    if np.linalg.cond(since) > 1e10:
        return True
    s = np.linalg.svd(L @ np.linalg.inv(since), compute_uv=False)
    return bool(s[0] > ROOM or s[-1] < 1.0 / ROOM)


@dataclass
class _Steps:
    """What the stop rule knows of a member's accepted steps."""
    taken: list[float] = field(default_factory=list)     # sizes of the last accepted steps
    calm: int = 0

    def done(self, step: float, change: float, tol: float) -> bool:
        """A change below ``tol`` counts only at full step, at least half the
        largest of the last ten accepted: one that was halved again and again
        changes little for that reason alone. Two in a row end the fit."""
        self.taken = [*self.taken, step][-10:]
        self.calm = self.calm + 1 if change < tol and step >= 0.5 * max(self.taken) else 0
        return self.calm >= 2


class _Descent:
    """Gradient descent of one member: the step halves (and is retried from the last
    accepted L) when the objective rises, and grows by a fifth after an accepted step."""

    def __init__(self, member: str, npairs: float, Ct: np.ndarray, L: np.ndarray, mu: float, lr: float, tol: float, min_iter: int):
        self.member, self.npairs, self.Ct, self.L, self.mu, self.lr = member, max(npairs, 1.0), Ct, L, mu, lr
        self.tol, self.min_iter = tol, min_iter
        self.best = None                       # (f, L, grad) at the last accepted L
        self.steps, self.history = _Steps(), []

    def update(self, it: int, hinge: float, Gimp: np.ndarray, refreshes: int) -> bool:
        """Takes the impostor part at ``L``, moves ``L`` on; True at the end."""
        f = ((1 - self.mu) * float(np.trace(self.L @ self.Ct @ self.L.T)) + self.mu * hinge) / self.npairs
        G = ((1 - self.mu) * self.Ct + Gimp) / self.npairs
        prev, stop = self.best, False
        accepted = prev is None or f <= prev[0]
        if accepted:
            rel = abs(prev[0] - f) / max(abs(prev[0]), 1e-12) if prev else np.inf
            self.best = (f, self.L.copy(), G)
            stop = self.steps.done(self.lr, rel, self.tol) and it + 1 >= self.min_iter
            if prev is not None:
                self.lr *= 1.2
        else:
            self.lr /= 2.0
        self.history.append({"member": self.member, "iteration": it, "loss": f, "lr": self.lr, "accepted": accepted, "refreshes": refreshes})
        if not stop:
            _, L0, G0 = self.best
            self.L = L0 - self.lr * 2.0 * L0 @ G0
        return stop

    def map(self) -> np.ndarray:
        return self.best[1] if self.best else self.L


def _fit_local(rows: DataFrame, members: list[str], k: int, make, mu: float, max_iter: int) -> dict[str, tuple[np.ndarray, list[dict]]]:
    """Map and history of every member of bounded size: a task has all rows of one
    member, finds their targets and makes all steps."""
    places = rows.sparkSession.createDataFrame([(m, i) for i, m in enumerate(members)], "_m string, _place int")
    # a partition per member: hashed members would share some tasks and leave others idle
    dealt = rows.join(F.broadcast(places), "_m").repartitionById(len(members), F.col("_place")).drop("_place")

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[str, list] = {}
        for b in batches:
            t = pa.Table.from_batches([b])
            X, y, ids = matrix(t, "features"), column(t, "label"), column(t, "id").astype(np.int64)
            for m, i in voronoi.by_key(t, "_m"):
                parts.setdefault(m, []).append((X[i], y[i], ids[i]))
        for m in sorted(parts):
            X, y, ids = (np.concatenate(x) for x in zip(*parts.pop(m)))
            sides, npairs, Ct = [], 0.0, 0.0
            for c in np.unique(y):
                own = np.flatnonzero(y == c)
                own = own[np.argsort(ids[own], kind="stable")]
                Xc = X[own]
                at, tm = targets_of(Xc, ids[own], k)
                Xt = np.where(tm[:, :, None], Xc[at], 0.0)
                D = (Xc[:, None, :] - Xt)[tm]
                npairs, Ct = npairs + len(D), Ct + D.T @ D
                sides.append(Side.compact(Xc, Xt, tm))
            fit = make(m, float(npairs), Ct)
            for it in range(max_iter):
                if fit.update(it, *member_terms(sides, fit.L, mu), 1):
                    break
            yield pa.RecordBatch.from_pydict({"_m": [m], "v": [fit.map().tolist()], "h": [json.dumps(fit.history)]})

    # d x d numbers and a history per member
    return {r["_m"]: (np.array(r["v"]), json.loads(r["h"])) for r in dealt.mapInArrow(fn, "_m string, v array<array<double>>, h string").collect()}


def _local_members(rows: DataFrame, k: int) -> tuple[list[str], list[str]]:
    """The members that are fitted by a task each, larger ones first, and the others."""
    # a row per member
    sizes = {r["_m"]: (r["n"], r["d"]) for r in rows.groupBy("_m").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size("features")).alias("d")).collect()}
    local = [m for m, (n, d) in sizes.items() if n <= LOCAL_ROWS and n * d * 8 * (k + 1) <= LOCAL_BYTES]
    if len(local) < rows.sparkSession.sparkContext.defaultParallelism:
        local = [m for m in local if sizes[m][0] <= ALONE_ROWS]
    return sorted(local, key=lambda m: (-sizes[m][0], m)), sorted(set(sizes) - set(local))


def fit(df: DataFrame, k: int = 3, mu: float = 0.5, max_iter: int = 1000, min_iter: int = 10,
        learn_rate: float = 0.1, tol: float = 1e-3, member_col: str | None = None,
        init: dict[str, np.ndarray] | None = None, block_rows: int = 2048,
        prepared: Blocks | None = None) -> LMNNModel:
    """Gradient descent on L per member (``_Descent``). A member stops when two
    accepted full steps in a row change its objective by less than ``tol`` of it
    (``_Steps``); ``max_iter`` only guards the loop."""
    def make(m: str, npairs: float, Ct: np.ndarray) -> _Descent:
        return _Descent(m, npairs, Ct, init[m].copy() if init and m in init else np.eye(len(Ct)), mu, learn_rate, tol, min_iter)

    maps: dict[str, np.ndarray] = {}
    hist: list[dict] = []
    blocks = prepared
    if blocks is None:
        rows = _rows(df, member_col)
        local, rest = _local_members(rows, k)
        if local:
            for m, (L, own) in sorted(_fit_local(rows, local, k, make, mu, max_iter).items()):
                maps[m] = L
                hist += own
        if rest:
            blocks = _blocks(rows.where(F.col("_m").isin(rest)) if local else rows, k, block_rows)
        release(rows)
    if blocks is not None:
        _fit_tiled(blocks, make, mu, max_iter, maps, hist)
        if prepared is None:
            release(blocks.table)
    return LMNNModel(maps=maps, history=sorted(hist, key=lambda h: (h["iteration"], h["member"])))


def _fit_tiled(blocks: Blocks, make, mu: float, max_iter: int, maps: dict[str, np.ndarray], hist: list[dict]) -> None:
    """Fits the members of ``blocks``, a job per step, into ``maps`` and ``hist``."""
    fits = {m: make(m, *x) for m, x in sorted(_target_stats(blocks).items())}
    active = set(fits)
    classes = {(m, c) for m, c, _, _ in blocks.names}
    wide = {m for m in fits if sum(x[0] == m for x in blocks.names) > sum(x[0] == m for x in classes)}
    since: dict[str, np.ndarray] = {}
    tiles, refreshes = None, 0
    for it in range(max_iter):
        if not active:
            break
        if tiles is None or any(_moved(fits[m].L, since[m]) for m in active & wide):
            if tiles is not None:
                tiles.unpersist()
            since = {m: fits[m].L.copy() for m in active}
            tiles, refreshes = _tiles(blocks, active_pairs(blocks, since)), refreshes + 1
        res = _collect_mats(_step_job(tiles, {m: fits[m].L for m in active}, mu))
        for m in sorted(active):
            if fits[m].update(it, *res.get(m, (0.0, np.zeros_like(fits[m].Ct))), refreshes):
                active.discard(m)
    if tiles is not None:
        tiles.unpersist()
    for m, own in fits.items():
        maps[m] = own.map()
        hist += own.history


def loss_terms(df: DataFrame, L: np.ndarray | None = None, k: int = 3, mu: float = 0.5,
               block_rows: int = 2048) -> tuple[float, float, float]:
    """G5 at a fixed L (identity by default): (pull, push, loss) in sum form."""
    blocks = prepare(df, k, None, block_rows)
    npairs, Ct = _target_stats(blocks)["0"]
    L = np.eye(len(Ct)) if L is None else L
    tiles = _tiles(blocks, active_pairs(blocks, {"0": L}, room=1.0))
    res = _collect_mats(_step_job(tiles, {"0": L}, mu))
    tiles.unpersist()
    release(blocks.table)
    pull = float(np.trace(L @ Ct @ L.T))
    hinge = res.get("0", (0.0, None))[0]
    return pull, hinge, (1 - mu) * pull + mu * hinge


def impostor_counts(df: DataFrame, L: np.ndarray | None = None, k: int = 3,
                    block_rows: int = 2048) -> DataFrame:
    """G4 per row: impostors (other-class rows inside the furthest target's
    margin) and active triplets ``1 + d_ij - d_il > 0``. Rows of blocks that meet
    no other one have none."""
    blocks = prepare(df, k, None, block_rows)
    L = np.eye(len(df.select("features").first()[0])) if L is None else L
    tiles = _tiles(blocks, active_pairs(blocks, {"0": L}, room=1.0))

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, ids, Xi, Xt, tm, Xl in _cells(b):
                _, _, _, ra, ri = cell_terms(Xi, Xt, tm, Xl, L, 0.5)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ri), pa.array(ra)], names=["id", "n_impostors", "n_active"])

    ddl = "id long, n_impostors long, n_active long"
    none = df.select(F.col("id").cast("long").alias("id"), F.lit(0).cast("long").alias("n_impostors"), F.lit(0).cast("long").alias("n_active"))
    return tiles.map(fn, ddl).unionByName(none).groupBy("id").agg(
        F.sum("n_impostors").alias("n_impostors"), F.sum("n_active").alias("n_active"))


def apply_map(df: DataFrame, maps: dict[str, np.ndarray] | np.ndarray, feat_col: str = "features",
              out: str = "z", member_col: str | None = None) -> DataFrame:
    """G7 / B11 for any width: ``z = L x`` in Arrow batches with L broadcast;
    per-member maps pick L by ``member_col``."""
    spark = df.sparkSession
    if isinstance(maps, np.ndarray):
        maps = {"0": maps}
    bc = spark.sparkContext.broadcast({m: np.asarray(v, dtype=np.float64) for m, v in maps.items()})
    cols = df.columns
    d = df.withColumn("_mk", F.col(member_col).cast("string") if member_col else F.lit("0"))
    schema = T.StructType(list(d.schema.fields) + [T.StructField(out, T.ArrayType(T.DoubleType()))])

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Ls = bc.value
        for b in batches:
            t = pa.Table.from_batches([b])
            if t.num_rows == 0:
                continue
            X = matrix(t, feat_col)
            Z = np.empty((X.shape[0], next(iter(Ls.values())).shape[0]))
            for m, sel in voronoi.by_key(t, "_mk"):
                Z[sel] = X[sel] @ Ls[m].T
            arr = pa.FixedSizeListArray.from_arrays(pa.array(Z.ravel()), Z.shape[1]).cast(
                pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(list(b.columns) + [arr],
                                             names=list(b.schema.names) + [out])

    return d.mapInArrow(fn, schema).select(*cols, out)
