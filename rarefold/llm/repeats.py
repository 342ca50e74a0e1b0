"""Repeated passages: prefix-partitioned suffix trees.

A passage repeats if a window of ``WINDOW`` words is found again, so of every
suffix of a text the tree needs its first ``WINDOW`` words. Suffixes are dealt
into subtrees by a prefix of variable length:

* The first split takes ``PREFIX`` words. Each window is filed under the
  smallest-hashed ``PREFIX`` words in it, at their offset: equal windows have
  equal words there, so all suffixes that can meet below depth ``WINDOW`` come
  into one subtree, and one row (prefix, document, place) carries all
  neighbouring windows that chose it. Only prefixes that two different texts
  have are kept, found by a count that is combined before its shuffle.
* A subtree of more than ``GROUP_ROWS`` rows gets the longest prefix there is,
  the whole window. What is left of it is one node with its leaves, of which
  only the earliest is asked for: a minimum, combined before its shuffle.

In a subtree the suffixes are sorted (a suffix array); a run that agrees on
``WINDOW`` words is an internal node at that depth with its leaves in text
order, and every leaf but the first is a repeat. Runs of repeats that overlap
are one span: the maximal repeat.

Texts whose words are all alike are found first, by their digest; of them only
the first goes into the trees. Repeats inside one document are found where the
document is read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, release, shared_dir
from .common import broadcast_within, fresh, spread_join
from .words import chunks, mix

WINDOW = 20
PREFIX = 8
GROUP_ROWS = 1 << 15
BROADCAST_DOCS = 150_000          # rows, and eight times as many numbers in all, that a join may broadcast
NO_ID = -(1 << 63)                # a null id comes before all others
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def _chosen(w, window: int, prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of each whole window, place of the prefix it is filed under, all
    prefixes' hashes). Of equal hashes the leftmost is chosen."""
    g = w.windows(prefix)[0]
    at = np.flatnonzero(w.fits(window))
    best, value = at.copy(), g[at]
    for k in range(1, window - prefix + 1):
        v = g[at + k]
        less = v < value
        best[less], value[less] = at[less] + k, v[less]
    return at, best, g


def _docs_of(w) -> np.ndarray:
    return np.repeat(np.arange(w.n_docs), np.diff(w.at))


def _again_in_doc(w, window: int) -> np.ndarray:
    """Whether the window at each word starts earlier in its own document."""
    h, fits = w.windows(window)
    at = np.flatnonzero(fits)
    with np.errstate(over="ignore"):
        key = mix(h[at] + _docs_of(w)[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    first = np.unique(key, return_index=True)[1]
    out = np.zeros(len(h), dtype=bool)
    out[at] = True
    out[at[first]] = False
    return out


def _words_of(w, i: int) -> list[bytes]:
    a, b = w.doc_start[i], w.doc_start[i + 1]
    return w.data[a:b].tobytes().split()


def _sha(words: list[bytes]):
    return hashlib.sha256(b" ".join(words))


def _key(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def _prefixes_by_doc(w, window: int, prefix: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the prefixes in use, document by document, and
    the n_docs + 1 positions of the documents in them."""
    _, best, g = _chosen(w, window, prefix)
    best = np.unique(best)
    doc, h = _docs_of(w)[best], g[best]
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    doc, h = doc[new], h[new]
    return h, np.searchsorted(doc, np.arange(w.n_docs + 1))


def _lists(values: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values))


def _survey(window: int, prefix: int):
    def run(batches):
        for b in batches:
            for w in chunks(b.column(1)):
                h, at = _prefixes_by_doc(w, window, prefix)
                own = np.bincount(_docs_of(w)[_again_in_doc(w, window)], minlength=w.n_docs) > 0
                digests = [_sha(_words_of(w, i)).digest() for i in range(w.n_docs)]
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(w.first, w.n_docs), pa.array(np.diff(w.at)), pa.array([d.hex() for d in digests]),
                    pa.array([_key(d) for d in digests], pa.int64()), pa.array(own),
                    _lists(h.view(np.int64), at)], names=["doc_id", "n_words", "sha", "key", "own", "prefixes"])
    return run


def _suffixes(window: int, prefix: int):
    """Rows ``h, doc_id, key, at, off, windows``: for each place of a shared prefix,
    the windows filed under it; ``at`` is the first one's start."""
    def run(batches):
        for b in batches:
            key, shared = b.column(2).to_numpy(zero_copy_only=False), b.column(3).fill_null([])
            for w in chunks(b.column(1)):
                at, best, g = _chosen(w, window, prefix)
                again = _again_in_doc(w, window)
                win = w.windows(window)[0]
                hashes, upto = _prefixes_by_doc(w, window, prefix)
                keep = np.zeros(len(hashes), dtype=bool)
                for i in range(w.n_docs):
                    own = shared[w.first + i].values
                    if len(own) and key[w.first + i] == _key(_sha(_words_of(w, i)).digest()):
                        keep[upto[i] + np.asarray(own)] = True
                # windows that chose the same place lie side by side
                doc = _docs_of(w)
                order = np.lexsort((hashes, np.repeat(np.arange(w.n_docs), np.diff(upto))))  # is the identity
                with np.errstate(over="ignore"):
                    tag = lambda d, h: mix(h + d.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                    kept = np.sort(tag(np.repeat(np.arange(w.n_docs), np.diff(upto))[order][keep], hashes[keep]))
                    mine = tag(doc[best], g[best])
                if len(kept):
                    pos = np.minimum(np.searchsorted(kept, mine), len(kept) - 1)
                    use = (kept[pos] == mine)
                else:
                    use = np.zeros(len(at), dtype=bool)
                run_start = np.ones(len(at), dtype=bool)
                run_start[1:] = (best[1:] != best[:-1]) | (at[1:] != at[:-1] + 1)
                run_id = np.cumsum(run_start) - 1
                fresh = np.bincount(run_id, weights=~again[at], minlength=run_id[-1] + 1 if len(run_id) else 0) > 0
                use &= fresh[run_id] if len(run_id) else use
                at, best, run_id = at[use], best[use], run_id[use]
                lead = np.flatnonzero(np.diff(run_id, prepend=-1))
                ends = np.append(lead, len(at))
                yield pa.RecordBatch.from_arrays([
                    pa.array(g[best[lead]].view(np.int64)), b.column(0).take(pa.array(w.first + doc[at[lead]])),
                    b.column(2).take(pa.array(w.first + doc[at[lead]])), pa.array(at[lead] - w.at[doc[at[lead]]]), pa.array((best[lead] - at[lead]).astype(np.int32)),
                    _lists(win[at].view(np.int64), ends)], names=["h", "doc_id", "key", "at", "off", "windows"])
    return run


def _nodes(t: pa.Table) -> pa.RecordBatch:
    """Leaves that are not the first of their node: ``doc_id, key, at, again`` where
    bit i of ``again`` says so of the window that starts at ``at + i``."""
    wins = t["windows"].combine_chunks()
    n = np.diff(wins.offsets.to_numpy())
    row = np.repeat(np.arange(len(n)), n)
    step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    value, h = wins.flatten().to_numpy(), t["h"].to_numpy()[row]
    off = t["off"].to_numpy()[row] - step
    doc, at = t["doc_id"].to_numpy()[row], t["at"].to_numpy()[row] + step
    order = np.lexsort((at, doc, value, off, h))
    h, off, value, doc, at = h[order], off[order], value[order], doc[order], at[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (off[1:] != off[:-1]) | (value[1:] != value[:-1])
    first = np.flatnonzero(new)[np.cumsum(new) - 1] if len(new) else np.zeros(0, np.int64)
    later = (doc != doc[first]) | (at != at[first])
    bits = np.zeros(len(n), dtype=np.int64)
    np.bitwise_or.at(bits, row[order][later], np.int64(1) << step[order][later])
    hit = np.flatnonzero(bits)
    return pa.RecordBatch.from_arrays([
        pa.array(t["doc_id"].to_numpy()[hit]), pa.array(t["key"].to_numpy()[hit]),
        pa.array(t["at"].to_numpy()[hit]), pa.array(bits[hit])], names=["doc_id", "key", "at", "again"])


def _subtrees(batches):
    """Rows come sorted by prefix; subtrees are built for whole prefixes, many at a time."""
    held, rows = [], 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        h = b.column(0).to_numpy()
        if rows < 20_000 or not len(h):
            continue
        cut = int(np.searchsorted(h, h[-1]))          # the last prefix may go on
        if cut == 0 and rows == b.num_rows:
            continue
        t = pa.Table.from_batches(held)
        done = rows - b.num_rows + cut
        if cut == 0:
            done = int(np.searchsorted(t["h"].to_numpy(), h[-1]))
        if done:
            yield _nodes(t.slice(0, done))
        held, rows = t.slice(done).combine_chunks().to_batches(), t.num_rows - done
    if rows:
        yield _nodes(pa.Table.from_batches(held))


def _left(w, i: int, gone: np.ndarray) -> str:
    """Document i without the words flagged and the white space behind them."""
    a, z = w.at[i], w.at[i + 1]
    edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0])))).reshape(-1, 2)
    left, at = [], w.doc_start[i]
    for x, y in edge:
        left.append(w.raw[at:w.start[a + x]].tobytes())
        at = w.start[a + y] if a + y < z else w.doc_start[i + 1]
    left.append(w.raw[at:w.doc_start[i + 1]].tobytes())
    return b"".join(left).decode("utf-8", "replace")


def _gone(w, window: int, found) -> np.ndarray:
    """Words of the chunk to remove. ``found(i)``: an Arrow array of (at, again)
    for document i, or None if it has no repeats at all."""
    starts, doc = _again_in_doc(w, window), _docs_of(w)
    for i in range(w.n_docs):
        s = found(i)
        if s is None:
            starts[w.at[i]:w.at[i + 1]] = False
        elif len(s):
            at, bits = s.field("at").to_numpy(), s.field("again").to_numpy()
            for k in range(window):
                starts[w.at[i] + at[bits >> k & 1 == 1] + k] = True
    cover = np.zeros(len(starts) + window + 1, dtype=np.int32)
    np.add.at(cover, np.flatnonzero(starts), 1)
    np.add.at(cover, np.flatnonzero(starts) + window, -1)
    return np.cumsum(cover)[:len(starts)] > 0


def _cut(window: int):
    """Counts, digests and spans of what is left of texts that have repeats."""
    def run(batches):
        none = pa.array([], pa.struct([("at", pa.int64()), ("again", pa.int64())]))
        for b in batches:
            key, found = b.column(2).to_numpy(zero_copy_only=False), b.column(3)
            for w in chunks(b.column(1)):
                words = [_words_of(w, i) for i in range(w.n_docs)]
                keys = [_key(_sha(x).digest()) for x in words]
                own = lambda i: (found[w.first + i].values if found[w.first + i].is_valid
                                 and keys[i] == key[w.first + i] else none)
                gone = _gone(w, window, own)
                removed, shas, spans = [], [], []
                for i in range(w.n_docs):
                    g = gone[w.at[i]:w.at[i + 1]]
                    removed.append(int(g.sum()))
                    shas.append(_sha([x for x, out in zip(words[i], g) if not out]).hexdigest())
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], g.astype(np.int8), [0]))))
                    spans.append([{"start": int(x), "end": int(y)} for x, y in edge.reshape(-1, 2)])
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(w.first, w.n_docs), pa.array(keys, pa.int64()), pa.array(removed, pa.int64()),
                    pa.array(shas, pa.string()),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                    names=["doc_id", "key", "n_removed", "kept_sha256", "spans"])
    return run


def _rewrite(window: int, text_at: int, chars_at: int | None, names: list[str]):
    """Whole rows with their texts cut; the last column tells what to cut."""
    def run(batches):
        for b in batches:
            plans = b.column(b.num_columns - 1)
            for w in chunks(b.column(text_at)):
                texts, sizes = [], []
                keys: dict[int, int] = {}

                def plan(i):
                    p = plans[w.first + i].as_py()
                    if not p:
                        return None
                    keys[i] = _key(_sha(_words_of(w, i)).digest())
                    return next((x for x in p if x["key"] == keys[i]), None)

                todo = [plan(i) for i in range(w.n_docs)]
                kind = pa.struct([("at", pa.int64()), ("again", pa.int64())])
                gone = _gone(w, window, lambda i: None if todo[i] is None else pa.array(todo[i]["found"] or [], kind))
                for i in range(w.n_docs):
                    if todo[i] is not None:
                        cut = "" if todo[i]["copy"] else _left(w, i, gone[w.at[i]:w.at[i + 1]])
                        texts.append(cut)
                        sizes.append(len(cut))
                    else:
                        texts.append(b.column(text_at)[w.first + i].as_py())
                        sizes.append(b.column(chars_at)[w.first + i].as_py() if chars_at is not None else None)
                cols = [c.slice(w.first, w.n_docs) for c in b.columns[:-1]]
                cols[text_at] = pa.array(texts, pa.string())
                if chars_at is not None:
                    cols[chars_at] = pa.array(sizes, b.column(chars_at).type)
                yield pa.RecordBatch.from_arrays(cols, names=names)
    return run


def _find(d: DataFrame, window: int, prefix: int, group_rows: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """For ``d`` (``doc_id, text``): the survey of all rows; the first id of each
    word sequence (``sha, first_id``); and ``doc_id, key, found`` of the documents
    that have repeats, in themselves or, as listed in ``found``, of earlier ones."""
    spark = d.sparkSession
    shared_dir(spark)
    seen = materialize(d.mapInArrow(_survey(window, prefix), "doc_id long, n_words long, sha string, key long, "
                                    "own boolean, prefixes array<long>"), "repeats-survey")
    first = seen.groupBy("sha").agg(F.min("doc_id").alias("doc_id"), F.first("key").alias("key"))
    own = seen.where("own").select("doc_id", "key", F.lit(True).alias("own")).distinct()
    # prefixes that two different texts have
    shared = (seen.select("key", F.explode("prefixes").alias("h")).groupBy("h")
              .agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a < b").select("h"))
    at = (spread_join(seen.select("doc_id", "key", F.posexplode("prefixes").alias("i", "h")), shared, ["h"], ["doc_id", "key", "i"])
          .groupBy("doc_id", "key").agg(F.collect_set("i").alias("shared")))
    picked = materialize(first.select("doc_id", "key").join(at, ["doc_id", "key"], "left").join(own, ["doc_id", "key"], "left")
                         .where("own or shared is not null").select("doc_id", "key", "shared"), "repeats-picked")
    suffixes = materialize(
        d.join(_few(picked, "shared", 40), "doc_id").select("doc_id", "text", "key", "shared")
        .mapInArrow(_suffixes(window, prefix), "h long, doc_id long, key long, at long, off int, windows array<long>"),
        "repeats-suffixes")
    # prefixes with too many places for one subtree
    big = suffixes.groupBy("h").count().where(F.col("count") > group_rows).select("h")
    n_big = big.count()
    usual = suffixes
    if n_big:
        usual = suffixes.join(broadcast_within(big, n_big, BROADCAST_DOCS), "h", "left_anti")
    again = (usual.repartition("h").sortWithinPartitions("h")
             .mapInArrow(_subtrees, "doc_id long, key long, at long, again long"))
    if n_big:
        each = (suffixes.join(broadcast_within(big, n_big, BROADCAST_DOCS), "h")
                .select("h", "doc_id", "key", "at", "off", F.posexplode("windows").alias("i", "w"))
                .select("h", "w", (F.col("off") - F.col("i")).alias("off"), "doc_id", "key",
                        (F.col("at") + F.col("i")).alias("at")))
        least = each.groupBy("h", "off", "w").agg(F.min(F.struct("doc_id", "at")).alias("least"))
        again = again.unionByName(spread_join(each, least, ["h", "off", "w"], ["doc_id", "at"]).where("struct(doc_id, at) > least")
                                  .select("doc_id", "key", "at", F.lit(1).cast("long").alias("again")))
    found = again.groupBy("doc_id", "key").agg(F.collect_list(F.struct("at", "again")).alias("found"))
    touched = materialize(picked.select("doc_id", "key").join(found, ["doc_id", "key"], "left")
                          .join(own, ["doc_id", "key"], "left")
                          .where("own or found is not null").select("doc_id", "key", "found"), "repeats-found")
    release(suffixes, picked)
    return seen, first.select("sha", F.col("doc_id").alias("first_id")), touched


def _few(plans: DataFrame, column: str, per_row: int) -> DataFrame:
    """``plans`` to be broadcast, if its rows and the entries of its array column
    are within their bounds."""
    n, entries = plans.agg(F.count("*"), F.coalesce(F.sum(F.size(F.coalesce(column, F.array()))), F.lit(0))).first()
    return broadcast_within(plans, n, BROADCAST_DOCS if entries <= per_row * BROADCAST_DOCS else 0)


def _with_id(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col(text_col).alias("text"))


def _is_copy(window: int):
    return (F.col("n_words") >= window) & (F.col("doc_id") > F.col("first_id"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, group_rows: int = GROUP_ROWS,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, spans`` of every row: words
    removed because they are in a window of ``window`` words that starts earlier in
    the input, at a smaller id or in the same document. ``spans`` are the removed
    word ranges (null for a text removed whole as a copy).

    A null text has no words. Rows that repeat an id are the same document, so a
    row that comes twice keeps its text twice; a null id comes before all
    others; texts of fewer words than a window lose nothing; an empty table
    gives no rows; other columns are ignored."""
    d = _with_id(docs, id_col, text_col)
    seen, first, touched = _find(d, window, prefix, group_rows)
    spans = "array<struct<start: long, end: long>>"
    cut = materialize(
        d.join(_few(touched, "found", 20), "doc_id").select("doc_id", "text", "key", "found")
        .mapInArrow(_cut(window), f"doc_id long, key long, n_removed long, kept_sha256 string, spans {spans}").distinct(),
        "repeats-cut")
    release(touched)
    out = (seen.select("doc_id", "n_words", "sha", "key").join(first, "sha").withColumn("copy", _is_copy(window))
           .join(cut, ["doc_id", "key"], "left"))
    is_copy = F.col("copy")
    return out.select(
        F.nullif(F.col("doc_id"), F.lit(NO_ID)).alias("doc_id"), "n_words",
        F.when(is_copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(is_copy, F.lit(EMPTY_SHA)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(~is_copy, F.coalesce("spans", F.expr(f"cast(array() as {spans})"))).alias("spans"))


def cut_repeats(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, group_rows: int = GROUP_ROWS,
                id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """``docs`` with the words that ``remove_repeats`` removes cut out of their
    texts. White space before a removed span stays and that behind its words
    goes; texts without repeats, and null texts, stay as they are. ``chars_col``, if
    there is such a column, gets the new length of a text that was cut; all other
    columns stay."""
    d = _with_id(docs, id_col, text_col)
    seen, first, touched = _find(d, window, prefix, group_rows)
    copies = (seen.select("doc_id", "n_words", "sha", "key").join(first, "sha").where(_is_copy(window))
              .select("doc_id", "key", F.lit(True).alias("copy")).distinct())
    kind = "array<struct<at: long, again: long>>"
    plans = touched.select("doc_id", "key", F.lit(False).alias("copy"), "found").unionByName(
        copies.withColumn("found", F.lit(None).cast(kind)))
    plan_id, plan = fresh(docs, "_plan_id"), fresh(docs, "_plan")
    plans = materialize(plans.groupBy(F.col("doc_id").alias(plan_id)).agg(
        F.collect_list(F.struct("key", "copy", "found")).alias(plan),
        F.flatten(F.collect_list(F.coalesce("found", F.expr(f"cast(array() as {kind})")))).alias("_entries")), "repeats-plans")
    few = _few(plans, "_entries", 20).select(plan_id, plan)
    names = docs.columns
    full = docs.join(few, F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)) == F.col(plan_id), "left").drop(plan_id)
    return full.mapInArrow(_rewrite(window, names.index(text_col), names.index(chars_col) if chars_col in names else None,
                                    names), docs.schema)
