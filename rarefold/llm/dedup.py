"""Exact deduplication of whole texts by Grace hashing.

Texts are compared as complete content, never by a hash alone: a row belongs to
an entry of a ``ContentTable`` (open addressing, linear probing) only where all
bytes are equal.

1. ``_collapse``: each scan task puts its rows in a table of bounded bytes and,
   whenever it is full, writes what it has and starts anew. Of the equal rows of
   a fill only one, the lead, keeps its text; the others are (id, entry). So a
   group that holds a third of all rows is one text a fill before anything moves.
2. A content that still stands in more than ``FAN_IN`` fills (counted exactly)
   is first merged over salted parts of its fills, so no task reads it from all
   of them.
3. Leads are dealt by content hash into as many buckets as their bytes ask for.
   A bucket's task fills one table; contents that find no room are written to
   spill files, which are dealt again by another hash, level by level, until
   nothing is spilled. A content is in the table or spilled as a whole, and a
   bucket takes at least one, so the levels end.
4. Results go back from entries to rows by a join of narrow rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, shared_dir

#: Bytes of distinct texts in a task's table; a bucket is meant to have half.
TABLE_BYTES = 16 << 20
#: Rows of one fill of a scan task.
FILL_ROWS = 1 << 14
#: Leads of one content that one task may read.
FAN_IN = 1024
_ROW_BYTES = 64                      # what an entry takes besides its text
_OUT_BYTES = 2 << 20
_SLICE = 256                         # rows of a batch that become Python values at a time


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, _SLICE):
            yield b.slice(i, _SLICE)


class ContentTable:
    """Distinct contents of bounded total size, by open addressing."""

    def __init__(self, most_bytes: int):
        self.most, self.used = most_bytes, 0
        self.slots, self.hashes, self.texts = [-1] * 1024, [], []

    def __len__(self) -> int:
        return len(self.texts)

    def _grow(self) -> None:
        mask = 2 * len(self.slots) - 1
        self.slots = [-1] * (mask + 1)
        for e, h in enumerate(self.hashes):
            p = h & mask
            while self.slots[p] >= 0:
                p = (p + 1) & mask
            self.slots[p] = e

    def place(self, h: int, text: bytes) -> int:
        """The entry of ``text``, made if there is room, else -1. The first
        content always has room."""
        mask = len(self.slots) - 1
        p = h & mask
        while (e := self.slots[p]) >= 0:
            if self.hashes[e] == h and self.texts[e] == text:
                return e
            p = (p + 1) & mask
        size = len(text) + _ROW_BYTES
        if self.texts and self.used + size > self.most:
            return -1
        self.used += size
        self.slots[p] = len(self.texts)
        self.hashes.append(h)
        self.texts.append(text)
        if 2 * len(self.texts) > len(self.slots):
            self._grow()
        return len(self.texts) - 1


def _better(new: int | None, old: int | None) -> bool:
    return old is None and new is not None or None not in (new, old) and new > old


_ROW = pa.schema([("member", pa.int64()), ("entry", pa.int64()), ("lead", pa.bool_()), ("top", pa.int64()),
                  ("n", pa.int64()), ("h", pa.int64()), ("n_bytes", pa.int64()), ("sha", pa.binary()), ("text", pa.binary())])
_ROW_DDL = "member long, entry long, lead boolean, top long, n long, h long, n_bytes long, sha binary, text binary"


class _Fill:
    """The rows of one fill and the entries that they share."""

    def __init__(self, most_bytes: int):
        self.table = ContentTable(most_bytes)
        self.members: list[int | None] = []
        self.entry: list[int] = []
        self.top: list[int | None] = []
        self.lead: list[int] = []
        self.n: list[int] = []
        self.sha: list[bytes | None] = []

    def add(self, member: int | None, top: int | None, n: int, text: bytes, sha: bytes | None) -> bool:
        e = self.table.place(xxhash.xxh3_64_intdigest(text), text)
        if e < 0:
            return False
        row = len(self.members)
        if e == len(self.lead):
            self.top.append(top)
            self.lead.append(row)
            self.n.append(0)
            self.sha.append(sha)
        elif _better(top, self.top[e]):
            self.top[e], self.lead[e] = top, row
        self.n[e] += n
        self.members.append(member)
        self.entry.append(e)
        return True

    def rows(self, first: int) -> Iterator[pa.RecordBatch]:
        """One row per member; entries are numbered from ``first``."""
        cols: list[list] = [[] for _ in _ROW]
        size = 0
        for row, (member, e) in enumerate(zip(self.members, self.entry)):
            own = (member, first + e, False, None, None, None, None, None, None)
            if self.lead[e] == row:
                text, h = self.table.texts[e], self.table.hashes[e]
                own = (member, first + e, True, self.top[e], self.n[e], h - (1 << 64) if h >> 63 else h, len(text),
                       self.sha[e] or hashlib.sha256(text).digest(), text)
                size += len(text)
            for c, v in zip(cols, own):
                c.append(v)
            if size > _OUT_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ROW)], schema=_ROW)
                cols, size = [[] for _ in _ROW], 0
        if cols[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ROW)], schema=_ROW)


def _collapse(most_bytes: int, fill_rows: int, normalise: bool):
    """Rows (member, top, n, text, sha) to one row per member, where the lead of
    each entry of a fill has the text."""
    def run(batches):
        first = TaskContext.get().partitionId() << 34
        fill = _Fill(most_bytes)
        for b in _slices(batches):
            for member, top, n, text, sha in zip(*(c.to_pylist() for c in b.columns)):
                text = (text or b"").lower() if normalise else text      # of bytes: A-Z only
                if len(fill.members) >= fill_rows or not fill.add(member, top, n, text, sha):
                    yield from fill.rows(first)
                    first += len(fill.table)
                    fill = _Fill(most_bytes)
                    fill.add(member, top, n, text, sha)
        yield from fill.rows(first)
    return run


_OUT = pa.schema([("entry", pa.int64()), ("keep_id", pa.int64()), ("keeper", pa.int64()), ("group_size", pa.int64()),
                  ("sha", pa.binary()), ("h", pa.int64()), ("n_bytes", pa.int64()), ("top", pa.int64()), ("n", pa.int64()),
                  ("text", pa.binary())])
_OUT_DDL = ("entry long, keep_id long, keeper long, group_size long, sha binary, h long, n_bytes long, top long, n long, "
            "text binary")


def _bucket(most_bytes: int):
    """One bucket (entry, top, n, h, n_bytes, sha, text) through one table. Rows
    with ``text`` are those spilled; the others are results."""
    def run(batches):
        table = ContentTable(most_bytes)
        entry, place, top, keeper, n, sha = [], [], [], [], [], []
        for b in _slices(batches):
            full = []
            cols = [c.to_pylist() for c in b.columns]
            for i, (e, t, k, h, _, s, text) in enumerate(zip(*cols)):
                p = table.place(h & ((1 << 64) - 1), text)
                if p < 0:
                    full.append(i)
                    continue
                if p == len(top):
                    top.append(t)
                    keeper.append(e)
                    n.append(0)
                    sha.append(s)
                elif _better(t, top[p]) or t == top[p] and e < keeper[p]:
                    top[p], keeper[p] = t, e
                n[p] += k
                entry.append(e)
                place.append(p)
            if full:
                own = b.take(pa.array(full, pa.int32()))
                none = {f.name: pa.nulls(len(full), f.type) for f in _OUT}
                none |= {name: own[name] for name in ("entry", "sha", "h", "n_bytes", "top", "n", "text")}
                yield pa.RecordBatch.from_arrays([none[f.name] for f in _OUT], schema=_OUT)
        for i in range(0, len(entry), 1 << 16):
            at = place[i:i + (1 << 16)]
            own = [entry[i:i + (1 << 16)], *([c[p] for p in at] for c in (top, keeper, n, sha)), *[[None] * len(at)] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(own, _OUT)], schema=_OUT)
    return run


def _parts(leads: DataFrame, table_bytes: int) -> int:
    """Buckets whose distinct contents take half a table on average."""
    total = leads.agg(F.sum(F.col("n_bytes") + _ROW_BYTES)).first()[0] or 0
    return max(1, -(-2 * total // table_bytes))


def _merged(leads: DataFrame, table_bytes: int, fan_in: int, maps: list[DataFrame]) -> DataFrame:
    """``leads`` in which no content stands more than ``fan_in`` times, as far as
    salted merging gets; ``maps`` gets the (member, entry) rows of each round."""
    before = None
    while True:
        most = leads.groupBy("h").count().agg(F.max("count")).first()[0] or 0
        if most <= fan_in or before is not None and most >= before:
            return leads
        before = most
        salts = -(-most // fan_in)
        salted = leads.repartition(max(_parts(leads, table_bytes), salts), "h", F.pmod(F.xxhash64("entry"), F.lit(salts)))
        rows = materialize(salted.select("entry", "top", "n", "text", "sha").mapInArrow(
            _collapse(table_bytes, 1 << 31, False), _ROW_DDL), "dedup-merged")
        maps.append(rows)
        leads = rows.where("lead")


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES,
               fill_rows: int = FILL_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` of every row of ``docs``.

    Texts are equal when identical after lower-casing A-Z. Of equal texts the
    row with the largest id stays, and ``keep_id`` is that id. Defined cases: a
    null text is an empty one, and empty texts are equal; of repeated rows (same
    id and text) exactly one stays; a row without an id stays only if no equal
    row has one, then one of them does and ``keep_id`` is null; an empty table
    gives no rows; other columns, whatever their names, are ignored. A text
    longer than ``table_bytes`` takes a table of its own."""
    shared_dir(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("member"), F.col(id_col).cast("long").alias("top"),
                       F.lit(1).cast("long").alias("n"), F.col(text_col).cast("binary").alias("text"),
                       F.lit(None).cast("binary").alias("sha"))
    rows = materialize(rows.mapInArrow(_collapse(table_bytes, fill_rows, True), _ROW_DDL), "dedup-fills")
    maps = [rows]
    spilled, level, results = _merged(rows.where("lead"), table_bytes, fan_in, maps), 0, None
    while True:
        dealt = spilled.repartition(_parts(spilled, table_bytes), F.xxhash64("h", F.lit(level)))
        out = materialize(dealt.select("entry", "top", "n", "h", "n_bytes", "sha", "text").mapInArrow(
            _bucket(table_bytes), _OUT_DDL), f"dedup-level-{level}")
        own = out.where("text IS NULL").select("entry", "keep_id", "keeper", "group_size", "sha")
        results = own if results is None else results.unionByName(own)
        spilled, level = out.where("text IS NOT NULL"), level + 1
        if not spilled.limit(1).count():
            break
    for m in reversed(maps[1:]):
        step = m.select(F.col("member").alias("from"), "entry", "lead")
        results = step.join(results, "entry").select(
            F.col("from").alias("entry"), "keep_id", "group_size", "sha",
            # the result's keeper is one of this round's entries; in the round before, it is that entry's lead
            F.when((F.col("entry") == F.col("keeper")) & F.col("lead"), F.col("from")).otherwise(F.lit(-1)).alias("keeper"))
    return rows.select("member", "entry", "lead").join(results, "entry").select(
        F.col("member").alias("doc_id"), "keep_id", "group_size",
        (F.col("lead") & (F.col("entry") == F.col("keeper"))).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
