"""N-gram Jaccard join with signature trees.

Two texts link when their sets of word 5-grams have a Jaccard similarity of at
least 0.75; results are the links' connected components. The join is exact:

1. *Order.* A pass over all texts counts frequent shingles (per task, then
   summed); the ``HEAVY`` most frequent get a rank. The order of shingles is
   (rank of frequency, hash), so shared boilerplate comes last. Any order gives
   the same links; this one makes few candidates.
2. *Sets.* A text becomes its set's size, a 64-bit hash of the set (equal sets
   are one node from here on), a bitmap of its shingles and the set's prefix in
   that order: two sets that link share a shingle in their first
   ``n - ceil(0.75 n) + 1``, and it is early enough in one of them.
3. *Groups.* Nodes are dealt by prefix shingle. A group that a frequent shingle
   would make large is cut into blocks that meet in cells, each of bounded size.
4. *Pivots.* Each group's pairs with one of its nodes are verified against the
   whole sets and their components taken. The pivot is the node in which the
   group's shingle comes earliest: it has the fewest rare shingles, so of a text
   and its edited copies it is the text. This collapses a group of near copies with
   a number of checks that grows with its rows, not with their square.
5. *Trees.* In each cell a tree is built over its nodes, with OR-combined
   bitmaps and ranges of sizes at every level. A dual traversal walks pairs of
   tree nodes and leaves out those whose sizes, or whose largest possible overlap,
   cannot reach the threshold, or that lie in one component already. Pairs that
   are left are verified; the links' components are the result.

Before whole sets are compared, pairs are tried on the sets' own bitmaps, whose
size goes with the set's: bits that only one side has bound the overlap.

Sizes: texts are read where they lie; what is shuffled is a quarter of the
shingles (as 64-bit hashes), bitmaps of nodes in groups of three and more and of
candidate pairs, and the whole sets of the pairs that their bitmaps leave.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, release, shared_dir
from .common import broadcast_within, fresh, row_key, spread_join
from .components import components
from .words import chunks, mix, window_hash

SHINGLE = 5
NUM, DEN = 75, 100                # similarity NUM / DEN
HEAVY = 1 << 18                   # shingles with a rank of their own (a broadcast of 4 MB at most)
TASK_HEAVY = 1 << 16              # candidates for that from one task
BITS = 512                        # of a tree node's bitmap
SKETCH_BITS = 4                   # of a set's own bitmap, for each shingle at least
BLOCK = 4096                      # nodes of one group that a block holds
FANOUT = 8
BROADCAST_DOCS = 150_000
NO_ID = (1 << 63) - 1             # a null id comes after all others

NODE_SCHEMA = "doc_id long, n long, sid long, prefix array<long>, sketch binary"


def _shingles(w) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of all of a chunk's shingles, repeats included."""
    win, fits = w.windows(SHINGLE)
    doc = np.repeat(np.arange(w.n_docs), np.diff(w.at))
    docs, hashes = [doc[fits]], [win[fits]]
    n = np.diff(w.at)
    for k in range(1, SHINGLE):                       # fewer words: the whole text is one shingle
        few = np.flatnonzero(n == k)
        if len(few):
            docs.append(few)
            hashes.append(window_hash(w.hash, k)[w.at[few]])
    return np.concatenate(docs), np.concatenate(hashes)


def _sets(w) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, hash), sorted, and set sizes."""
    doc, h = _shingles(w)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    doc, h = doc[new], h[new]
    return doc, h, np.bincount(doc, minlength=w.n_docs)


def _set_ids(doc: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A hash of each document's set; 0 for an empty one."""
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(h ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)))
        at = np.concatenate(([0], np.cumsum(n)))
        return np.where(n > 0, mix(total[at[1:]] - total[at[:-1]] + n.astype(np.uint64)), np.uint64(0))


def _sketches(doc: np.ndarray, h: np.ndarray, n: np.ndarray) -> pa.Array:
    """A bitmap of each set: a power of two of bits, at least ``SKETCH_BITS`` per
    shingle and ``BITS``; a shingle's bit is given by its hash's low bits."""
    size = np.maximum(BITS, 1 << np.ceil(np.log2(np.maximum(1, SKETCH_BITS * n))).astype(np.int64))
    at = np.concatenate(([0], np.cumsum(size)))
    bits = np.zeros(int(at[-1]), dtype=bool)
    bits[at[doc] + (h & (size[doc] - 1).astype(np.uint64)).astype(np.int64)] = True
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(n), [None, pa.py_buffer((at // 8).tobytes()), pa.py_buffer(
            np.packbits(bits, bitorder="little").tobytes())]).cast(pa.binary())


def _fold(sketch: bytes, size: int) -> np.ndarray:
    """The sketch on ``size`` bytes: its parts, one on the other."""
    return np.bitwise_or.reduce(np.frombuffer(sketch, np.uint64).reshape(-1, size // 8), axis=0)


def _folded(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([
            _fold(x, BITS // 8).tobytes() for x in b.column(1).to_pylist()], pa.binary())], names=["sid", "bits"])


def _bounded(batches):
    """Pairs (a, b, na, nb, and sketches) whose bitmaps leave a link possible."""
    for batch in batches:
        na, nb, keep = batch.column(2).to_pylist(), batch.column(3).to_pylist(), []
        for i, (x, y) in enumerate(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())):
            size = min(len(x), len(y))
            x, y = _fold(x, size), _fold(y, size)
            most = min(na[i] - int(np.bitwise_count(x & ~y).sum()), nb[i] - int(np.bitwise_count(y & ~x).sum()))
            keep.append(bool(_enough(most, na[i], nb[i])))
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])


def _sum_counts(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u, inv = np.unique(h, return_inverse=True)
    return u, np.bincount(inv, weights=n, minlength=len(u)).astype(np.int64)


def _count_heavy(batches):
    """A task's most frequent shingles; rare ones are forgotten on the way."""
    held_h, held_n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hs, size = [], 0

    def merge():
        nonlocal held_h, held_n, hs, size
        u, n = np.unique(np.concatenate(hs), return_counts=True) if hs else (held_h[:0], held_n[:0])
        hs, size = [], 0
        h, n = _sum_counts(np.concatenate((held_h, u)), np.concatenate((held_n, n)))
        many = n > 1
        h, n = h[many], n[many]
        if len(h) > 2 * TASK_HEAVY:
            top = np.argpartition(-n, 2 * TASK_HEAVY)[:2 * TASK_HEAVY]
            h, n = h[top], n[top]
        held_h, held_n = h, n

    for b in batches:
        for w in chunks(b.column(0), lower=True):
            hs.append(_shingles(w)[1])
            size += len(hs[-1])
            if size > 1 << 20:
                merge()
    merge()
    top = np.argsort(-held_n, kind="stable")[:TASK_HEAVY]
    yield pa.RecordBatch.from_arrays([pa.array(held_h[top].view(np.int64)), pa.array(held_n[top])], names=["h", "n"])


def heavy_shingles(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and counts of at most ``HEAVY`` frequent shingles."""
    rows = (texts.mapInArrow(_count_heavy, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
            .where("n > 2").orderBy(F.desc("n"), "h").limit(HEAVY).collect())
    h = np.array([r.h for r in rows], np.int64).view(np.uint64)
    n = np.array([r.n for r in rows], np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def _prefix_len(n: np.ndarray) -> np.ndarray:
    return np.where(n > 0, n + (-NUM * n // DEN) + 1, 0)


def _survey(heavy):
    def run(batches):
        heavy_h, heavy_n = heavy.value
        for b in batches:
            for w in chunks(b.column(1), lower=True):
                doc, h, n = _sets(w)
                sid = _set_ids(doc, h, n)
                sketches = _sketches(doc, h, n)
                df = np.zeros(len(h), np.int64)
                if len(heavy_h):
                    at = np.minimum(np.searchsorted(heavy_h, h), len(heavy_h) - 1)
                    df = np.where(heavy_h[at] == h, heavy_n[at], 0)
                order = np.lexsort((h, df, doc))
                doc, h = doc[order], h[order]
                start = np.concatenate(([0], np.cumsum(n)))
                p = _prefix_len(n)
                keep = np.arange(len(h)) - start[doc] < p[doc]
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(w.first, w.n_docs), pa.array(n.astype(np.int64)), pa.array(sid.view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(p))).astype(np.int32)),
                                             pa.array(h[keep].view(np.int64))),
                    sketches, *[c.slice(w.first, w.n_docs) for c in b.columns[2:]]],
                    names=["doc_id", "n", "sid", "prefix", "sketch", *b.schema.names[2:]])
    return run


def _batch_sets(batches):
    for b in batches:
        for w in chunks(b.column(1), lower=True):
            doc, h, n = _sets(w)
            yield pa.RecordBatch.from_arrays([
                pa.array(_set_ids(doc, h, n).view(np.int64)),
                pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)),
                                         pa.array(h.view(np.int64)))], names=["sid", "shingles"])


def _deal(heavy, block: int):
    """(cell, h, sid, n, i) of each node's prefix. ``cell`` is 0 but for groups of frequent
    shingles, whose k blocks meet in k (k + 1) / 2 cells."""
    def run(batches):
        heavy_h, heavy_n = heavy.value
        many = heavy_n > block
        big_h, big_k = heavy_h[many], -(-heavy_n[many] // block)
        for b in batches:
            lists = b.column(2)
            h = lists.flatten().to_numpy().view(np.uint64)
            size = np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(len(size)), size)
            i = np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size)
            sid, n = b.column(0).to_numpy()[row], b.column(1).to_numpy()[row]
            cell = np.zeros(len(h), np.int64)
            if len(big_h):
                at = np.minimum(np.searchsorted(big_h, h), len(big_h) - 1)
                k = np.where(big_h[at] == h, big_k[at], 1)
                own = (mix(sid.view(np.uint64)) % k.astype(np.uint64)).astype(np.int64)
                take = np.repeat(np.arange(len(h)), k)
                other = np.arange(len(take)) - np.repeat(np.cumsum(k) - k, k)
                own = own[take]
                cell = np.maximum(own, other) * (np.maximum(own, other) + 1) // 2 + np.minimum(own, other)
                h, sid, n, i = h[take], sid[take], n[take], i[take]
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(h.view(np.int64)), pa.array(sid), pa.array(n),
                                              pa.array(i.astype(np.int32))], names=["cell", "h", "sid", "n", "i"])
    return run


def _sizes_fit(na, nb):
    return DEN * np.minimum(na, nb) >= NUM * np.maximum(na, nb)


def _enough(overlap, na, nb):
    """Whether an overlap can make two sets of these sizes link."""
    return (DEN + NUM) * overlap >= NUM * (na + nb)


def _whole_groups(batches, most_rows: int = 50_000):
    """Tables of whole (cell, h) groups from sorted batches."""
    held, rows = [], 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows < most_rows:
            continue
        t = pa.Table.from_batches(held)
        cell, h = t["cell"].to_numpy(), t["h"].to_numpy()
        cut = int(np.flatnonzero((cell != cell[-1]) | (h != h[-1]))[-1:].sum() + 1) \
            if (cell[0], h[0]) != (cell[-1], h[-1]) else 0
        if cut:
            yield t.slice(0, cut)
            held, rows = t.slice(cut).combine_chunks().to_batches(), t.num_rows - cut
    if rows:
        yield pa.Table.from_batches(held)


def _group_starts(cell, h) -> np.ndarray:
    new = np.ones(len(h), dtype=bool)
    new[1:] = (cell[1:] != cell[:-1]) | (h[1:] != h[:-1])
    return np.flatnonzero(new)


def _pivots(batches):
    """Rows (cell, h, sid, n, i, other): pairs of a group's nodes with its first node,
    and, with ``other`` null, the nodes of groups of three and more."""
    for t in _whole_groups(batches):
        cell, h, sid, n, i = (t[c].to_numpy() for c in ("cell", "h", "sid", "n", "i"))
        start = _group_starts(cell, h)
        size = np.diff(np.append(start, len(h)))
        early = np.add.reduceat(((DEN + NUM) * (n - i) >= 2 * NUM * n).astype(np.int64), start) > 0
        group = np.repeat(np.arange(len(start)), size)
        ok = (early & (size > 1))[group]
        p = start[group]
        pair = ok & (sid != sid[p]) & _sizes_fit(n, n[p]) & _enough(1 + np.minimum(n - i, n[p] - i[p]) - 1, n, n[p])
        more = ok & (size > 2)[group]
        at = np.concatenate((np.flatnonzero(pair), np.flatnonzero(more)))
        k = int(pair.sum())
        other = pa.array(np.concatenate((sid[p[pair]], np.zeros(len(at) - k, np.int64))),
                         mask=np.arange(len(at)) >= k)
        yield pa.RecordBatch.from_arrays([pa.array(x[at]) for x in (cell, h, sid, n, i)] + [other],
                                         names=["cell", "h", "sid", "n", "i", "other"])


def _levels(start, n, label, bits):
    """Trees over the rows of each group, all groups at once: per level arrays
    (first child, end, least and largest size, fewest bits, label or -1 for
    several, OR of the bitmaps); the last level has one root a group."""
    pop = np.bitwise_count(bits).sum(axis=1).astype(np.int64)
    levels = [(None, None, n, n, pop, label, bits)]
    size = np.diff(np.append(start, len(n)))
    while True:
        per = -(-size // FANOUT)
        group = np.repeat(np.arange(len(size)), per)
        k = np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per)
        first = (np.cumsum(size) - size)[group] + k * FANOUT
        end = np.minimum(first + FANOUT, np.cumsum(size)[group])
        _, _, lo, hi, pop, label, bits = levels[-1]
        one = np.minimum.reduceat(label, first)
        levels.append((first, end, np.minimum.reduceat(lo, first), np.maximum.reduceat(hi, first),
                       np.minimum.reduceat(pop, first), np.where(one == np.maximum.reduceat(label, first), one, -1),
                       np.bitwise_or.reduceat(bits, first, axis=0)))
        if (per == 1).all():
            return levels
        size = per


def _may_link(level, a, b):
    """Pairs of tree nodes below which a link between components is possible."""
    _, _, lo, hi, pop, label, bits = level
    keep = ((label[a] != label[b]) | (label[a] < 0)) & (DEN * hi[a] >= NUM * lo[b]) & (DEN * hi[b] >= NUM * lo[a])
    a, b = a[keep], b[keep]
    common = np.bitwise_count(bits[a] & bits[b]).sum(axis=1).astype(np.int64)
    # bits that only one side has are shingles that only that side has
    most = np.minimum(hi[a] - np.maximum(0, pop[a] - common), hi[b] - np.maximum(0, pop[b] - common))
    keep = _enough(most, lo[a], lo[b])
    return a[keep], b[keep]


def _join_trees(start, sid, n, i, label, bits, step: int = 1 << 16):
    """Candidate pairs (positions) by dual traversal, depth first in steps."""
    levels = _levels(start, n, label, bits)
    roots = np.arange(len(levels[-1][0]))
    stack = [(len(levels) - 1, roots[k:k + step], roots[k:k + step]) for k in range(0, len(roots), step)]
    while stack:
        depth, a, b = stack.pop()
        a, b = _may_link(levels[depth], a, b)
        if depth == 0:
            keep = (a != b) & (sid[a] != sid[b]) & _enough(np.minimum(n[a] - i[a], n[b] - i[b]), n[a], n[b])
            yield a[keep], b[keep]
            continue
        first, end = levels[depth][:2]
        for k in range(0, len(a), step // (FANOUT * FANOUT)):
            x, y = a[k:k + step // (FANOUT * FANOUT)], b[k:k + step // (FANOUT * FANOUT)]
            nx, ny = end[x] - first[x], end[y] - first[y]
            pair = np.repeat(np.arange(len(x)), nx * ny)
            at = np.arange(len(pair)) - np.repeat(np.cumsum(nx * ny) - nx * ny, nx * ny)
            ca, cb = first[x][pair] + at // ny[pair], first[y][pair] + at % ny[pair]
            keep = (x != y)[pair] | (ca <= cb)
            if keep.any():
                stack.append((depth - 1, ca[keep], cb[keep]))


def _trees(batches):
    for t in _whole_groups(batches, 20_000):
        cell, h, sid, n, i, label = (t[c].to_numpy() for c in ("cell", "h", "sid", "n", "i", "label"))
        bits = np.frombuffer(b"".join(t["bits"].to_pylist()), np.uint64).reshape(len(h), BITS // 64)
        order = np.lexsort((*bits.T, n, h, cell))         # near sizes and bitmaps side by side
        cell, h, sid, n, i, label, bits = (x[order] for x in (cell, h, sid, n, i, label, bits))
        # labels as small numbers, so that -1 is free
        label = np.unique(label, return_inverse=True)[1].astype(np.int64)
        found = [np.stack((np.minimum(sid[a], sid[b]), np.maximum(sid[a], sid[b])))
                 for a, b in _join_trees(_group_starts(cell, h), sid, n, i, label, bits)]
        pairs = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.zeros((2, 0), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])


def _verified(pairs: DataFrame, texts: DataFrame, nodes: DataFrame, sketches: DataFrame) -> DataFrame:
    """Those of the pairs (``a, b``) whose whole sets are similar enough."""
    side = lambda c: sketches.select(*[F.col(x).alias(y) for x, y in (("sid", c), ("n", f"n{c}"), ("sketch", f"s{c}"))])
    pairs = materialize(pairs.distinct().join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "sa", "sb")
                        .mapInArrow(_bounded, "a long, b long"), "pairs")
    need = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    need = materialize(nodes.groupBy("sid").agg(F.min("doc_id").alias("doc_id")).join(need, "sid")
                       .select("doc_id").distinct(), "pair-docs")
    sets = (texts.join(broadcast_within(need, need.count(), BROADCAST_DOCS), "doc_id")
            .select("doc_id", "text").mapInArrow(_batch_sets, "sid long, shingles array<long>"))
    sets = materialize(sets.dropDuplicates(["sid"]), "pair-sets")
    side = lambda c: sets.select(F.col("sid").alias(c), F.col("shingles").alias(f"s{c}"))
    both = F.size(F.array_intersect("sa", "sb"))
    links = materialize(pairs.join(side("a"), "a").join(side("b"), "b").where(
        F.lit(DEN) * both >= F.lit(NUM) * (F.size("sa") + F.size("sb") - both)).select("a", "b"), "links")
    release(pairs, need, sets)
    return links


def similar_documents(docs: DataFrame, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs``.

    ``component_id`` is the smallest id that links reach. A null text, or one
    without words, has no shingles and links with nothing. Rows that repeat an id
    keep their rows, each with the links of its own text; null ids are ignored
    by the minimum, and a component of such rows only has a null id. An empty
    table gives no rows; other columns are ignored."""
    out = _linked(docs, block, id_col, text_col)
    return out.select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "n_shingles",
                      F.nullif("component_id", F.lit(NO_ID)).alias("component_id"))


def _linked(docs: DataFrame, block: int, id_col: str, text_col: str, keyed: bool = False) -> DataFrame:
    """``doc_id, n_shingles, component_id`` with ``NO_ID`` for null; ``keyed``
    rows also have their ``row_key`` and ``label``, which names their component
    (null without shingles)."""
    spark = docs.sparkSession
    shared_dir(spark)
    key, label = (["row_key"], ["label"]) if keyed else ([], [])
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"),
                        F.col(text_col).alias("text"), *[row_key(id_col, text_col).alias(k) for k in key])
    heavy = spark.sparkContext.broadcast(heavy_shingles(texts.select("text")))
    seen = materialize(texts.mapInArrow(_survey(heavy), NODE_SCHEMA + ", row_key string" * keyed), "shingle-survey")
    nodes = seen.where("n > 0").select("doc_id", "sid")
    sketches = seen.where("n > 0").select("sid", "n", "sketch").dropDuplicates(["sid"])
    one = nodes.groupBy("sid").agg(F.min("doc_id").alias("doc_id"))
    wide = (seen.where("n > 0").select("doc_id", "sid", "n", "prefix").join(one, ["doc_id", "sid"], "left_semi")
            .select("sid", "n", "prefix"))
    met = materialize(
        wide.mapInArrow(_deal(heavy, block), "cell long, h long, sid long, n long, i int")
        .repartition("cell", "h").sortWithinPartitions("cell", "h", "i", "n", "sid")
        .mapInArrow(_pivots, "cell long, h long, sid long, n long, i int, other long"), "shingle-groups")
    pairs = met.where("other is not null").select(
        F.least("sid", "other").alias("a"), F.greatest("sid", "other").alias("b"))
    links = _verified(pairs, texts, nodes, sketches)
    labels = components(links)
    bits = sketches.select("sid", "sketch").mapInArrow(_folded, "sid long, bits binary")
    members = (met.where("other is null").select("cell", "h", "sid", "n", "i")
               .join(labels.withColumnRenamed("node", "sid"), "sid", "left")
               .withColumn("label", F.coalesce("label", "sid")).join(bits, "sid"))
    more = (members.select("cell", "h", "sid", "n", "i", "label", "bits").repartition("cell", "h")
            .sortWithinPartitions("cell", "h").mapInArrow(_trees, "a long, b long"))
    links = links.unionByName(_verified(more, texts, nodes, sketches))
    roots = components(links)
    named = one.join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    named = materialize(named.select("sid", "label", "doc_id"), "named-sets")
    least = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    of = materialize(spread_join(named.select("sid", "label"), least, ["label"], ["sid"]).select("sid", "component_id", *label), "components")
    out = (seen.select("doc_id", F.col("n").alias("n_shingles"), *key, F.when(F.col("n") > 0, F.col("sid")).alias("_s"))
           .withColumn("_k", F.coalesce(F.concat(F.lit("k"), F.col("_s")), F.concat(F.lit("n"), F.col("doc_id")))))
    out = spread_join(out, of.select(F.concat(F.lit("k"), F.col("sid")).alias("_k"), "component_id", *label), ["_k"], ["doc_id", *key], "left")
    release(met, named)
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), *key, *label)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id, and of
    rows that share it that of the smallest ``row_key``. Rows that repeat an id are
    judged each by its own text; rows without an id come after all others, so of a
    component without ids one stays too. Of rows that repeat an id and a text one
    stays; rows with neither an id nor a word all stay."""
    gone, twice = fresh(docs, "_out"), fresh(docs, "_key")
    found = materialize(_linked(docs, BLOCK, id_col, text_col, keyed=True), "linked-rows")
    tied = materialize(found.where("n_shingles > 0 and doc_id = component_id").groupBy("label")
                       .agg(F.min("row_key").alias("first"), F.max("row_key").alias("last"))
                       .where("first <> last").select("label", "first"), "tied-rows")
    later = found.where("doc_id = component_id").join(broadcast_within(tied, tied.count(), BROADCAST_DOCS), "label").where("row_key <> first")
    out = materialize(found.where("component_id <> doc_id").select(F.col("row_key").alias(gone))
                      .unionByName(later.select(F.col("row_key").alias(gone))).distinct(), "near-copies")
    mine = row_key(id_col, text_col)
    kept = docs.join(broadcast_within(out, out.count(), BROADCAST_DOCS), mine == F.col(gone), "left_anti")
    again = materialize(found.where((F.col("n_shingles") > 0) | (F.col("doc_id") != NO_ID)).groupBy(F.col("row_key").alias(twice)).count()
                        .where("count > 1").select(twice).join(out, F.col(twice) == F.col(gone), "left_anti"), "repeated-rows")
    n = again.count()
    if not n:
        return kept
    same = mine == F.col(twice)
    again = broadcast_within(again, n, BROADCAST_DOCS)
    return kept.join(again, same, "left_anti").unionByName(
        kept.join(again, same, "left_semi").dropDuplicates([id_col, text_col]))
