"""Best-fit packing of tokenised documents into sequences of fixed capacity.

``pieces`` tokenises whole texts. The tokenizer drops white space and never
joins what white space parts, so a text's ids are its words' ids in a row; each
distinct word is encoded once and the ids of a chunk's texts are then gathered
with NumPy.

``pack`` is best-two-fit. Pieces are dealt by hash into groups of about
``GROUP_PIECES`` (as many groups as the data asks for, so a task's memory does
not grow; a group wastes at most its last sequences). In a group only lengths
matter: a sequence is filled greedily with the longest piece that still fits;
if a gap is left, its smallest piece is exchanged for two unpacked pieces that
fill the expanded gap more tightly. Lengths in stock are bits of one integer,
so "longest that fits" and "two that sum to t" are a few operations each.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, shared_dir
from .words import chunks

CAPACITY = 4096
END_ID = 1
GROUP_PIECES = 1 << 16
CACHE_WORDS = 500_000
_SIGN = np.zeros(256, dtype=bool)
_SIGN[[ord(c) for c in ".,;:!?#*$%&|<>"]] = True
_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


class WordIds:
    """Ids of a chunk's texts from ids of their distinct words.

    The tokenizer lower-cases, drops white space and splits a word into runs of
    letters, single digits and runs of other signs, so a word's ids are those of
    its stem and of the signs that trail it; both are encoded once and kept, up to
    ``CACHE_WORDS``, then forgotten. A stem of a-z is one run and goes to the
    tokenizer's model at once; anything else goes through the whole tokenizer."""

    def __init__(self, tokenizer_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"   # Spark's tasks are the parallelism
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(tokenizer_path)
        self._clear()

    def _clear(self) -> None:
        self.at: dict[int, int] = {}
        self.start, self.len = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.ids, self.used = np.zeros(4096, np.uint32), 0

    def _encode_words(self, texts: list[bytes]) -> list[list[int]]:
        model, out, rest = self.tok.model, [], []
        for i, t in enumerate(texts):
            if t.isalpha():                    # of bytes: a-z only, as texts are lower case
                out.append([x.id for x in model.tokenize(t.decode("ascii"))])
            else:
                rest.append(i)
                out.append([])
        if rest:
            found = self.tok.encode_batch_fast([texts[i].decode("utf-8", "replace") for i in rest],
                                               add_special_tokens=False)
            for i, e in zip(rest, found):
                out[i] = e.ids
        return out

    def _add(self, hashes: list[int], texts: list[bytes]) -> None:
        found = self._encode_words(texts)
        lens = np.fromiter(map(len, found), np.int64, len(found))
        k, flat = len(self.at), np.fromiter(chain.from_iterable(found), np.uint32, int(lens.sum()))
        while len(self.start) < k + len(lens):
            self.start, self.len = (np.concatenate((x, np.zeros_like(x))) for x in (self.start, self.len))
        while len(self.ids) < self.used + len(flat):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        self.len[k:k + len(lens)] = lens
        self.start[k:k + len(lens)] = self.used + np.cumsum(lens) - lens
        self.ids[self.used:self.used + len(flat)] = flat
        self.used += len(flat)
        self.at.update(zip(hashes, range(k, k + len(lens))))

    def encode(self, w) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the (lower-cased) chunk's words in a row, and n_docs + 1
        positions in them."""
        if len(self.at) > CACHE_WORDS:
            self._clear()
        d = w.data
        # where each word's trailing signs begin, if they follow an ASCII letter or digit
        last_other = np.maximum.accumulate(np.where(_SIGN[d], -1, np.arange(len(d)))) if len(d) else d
        stem = last_other[w.end - 1] + 1
        split = (stem > w.start) & (stem < w.end) & _ALNUM[d[stem - 1]]
        marks = w.start[np.searchsorted(w.start, np.flatnonzero(
            (d[:-1] == ord("<")) & (d[1:] == ord("|"))), side="right") - 1] if len(d) > 1 else []
        marked = np.flatnonzero(np.isin(w.start, marks))     # may hold a special token: taken whole, as it came
        split[marked] = False
        n = 1 + split.astype(np.int64)
        first = np.cumsum(n) - n
        start, end = np.empty(int(n.sum()), np.int64), np.empty(int(n.sum()), np.int64)
        start[first], end[first] = w.start, np.where(split, stem, w.end)
        start[first[split] + 1], end[first[split] + 1] = stem[split], w.end[split]
        key, raw = w.span_hash(start, end), w.data.tobytes()
        own: dict[int, bytes] = {}
        for i in marked.tolist():
            text = w.raw[w.start[i]:w.end[i]].tobytes()
            key[first[i]] = int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little")
            own[int(key[first[i]])] = text
        u, at, inv = np.unique(key, return_index=True, return_inverse=True)
        keys = u.tolist()
        new = [i for i, h in enumerate(keys) if h not in self.at]
        if new:
            f = at[new]
            self._add([keys[i] for i in new], [own.get(keys[i]) or raw[a:b] for i, a, b in zip(
                new, start[f].tolist(), end[f].tolist())])
        idx = np.fromiter((self.at[h] for h in keys), np.int64, len(keys))[inv]
        lens = self.len[idx]
        upto = np.concatenate(([0], np.cumsum(lens)))
        ids = self.ids[np.repeat(self.start[idx] - upto[:-1], lens) + np.arange(upto[-1])]
        atoms_at = np.concatenate((first, [len(start)]))[w.at]
        return ids, upto[atoms_at]


def _piece_batches(tokenizer_path: str, capacity: int, with_ids: bool):
    def run(batches):
        enc = WordIds(tokenizer_path)
        for b in batches:
            for w in chunks(b.column(1), lower=True):
                ids, at = enc.encode(w)
                row, piece, start, length, crc, arrays = [], [], [], [], [], []
                for i in range(w.n_docs):
                    own = np.append(ids[at[i]:at[i + 1]], np.uint32(END_ID)).astype("<u4")
                    for k, s in enumerate(range(0, len(own), capacity)):
                        part = own[s:s + capacity]
                        row.append(w.first + i)
                        piece.append(k)
                        start.append(s)
                        length.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
                        if with_ids:
                            arrays.append(part.astype(np.int32))
                cols = [b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                        pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:
                    cols.append(pa.array(arrays, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "piece", "start", "length", "ids_crc32",
                                                              "ids"][:len(cols)])
    return run


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = False,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids``) of every row:
    its ids and then ``END_ID``, cut into ``capacity``-token pieces only if
    there are more. A null or empty text is the single id ``END_ID``."""
    shared_dir(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        _piece_batches(tokenizer_path, capacity, with_ids),
        "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else ""))


def best_two_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of lengths (each at most ``capacity``)."""
    stock = [0] * (capacity + 1)
    for n in lengths:
        stock[n] += 1
    have = sum(1 << n for n in range(capacity + 1) if stock[n])            # bit n: length n is in stock
    mirror = sum(1 << (capacity - n) for n in range(capacity + 1) if stock[n])

    def take(n: int) -> None:
        nonlocal have, mirror
        stock[n] -= 1
        if not stock[n]:
            have ^= 1 << n
            mirror ^= 1 << (capacity - n)

    def two(most: int, least: int) -> tuple[int, int] | None:
        """Lengths in stock with the largest sum in ``least .. most``."""
        for t in range(most, least - 1, -1):
            # bit n of the mirror, moved, says that t - n is in stock
            both = have & (mirror >> (capacity - t) if t <= capacity else mirror << (t - capacity))
            if not t % 2 and both >> (t // 2) & 1 and stock[t // 2] < 2:
                both ^= 1 << (t // 2)
            if both:
                a = both.bit_length() - 1
                return a, t - a
        return None

    bins = []
    while have:
        own, gap = [], capacity
        while gap and (fit := (have & ((1 << (gap + 1)) - 1)).bit_length() - 1) > 0:
            take(fit)
            own.append(fit)
            gap -= fit
        if gap and len(own) > 1 and (pair := two(gap + own[-1], own[-1] + 1)):
            small = own.pop()              # pieces were taken longest first
            for n in pair:
                take(n)
                own.append(n)
            if not stock[small]:
                have |= 1 << small
                mirror |= 1 << (capacity - small)
            stock[small] += 1
        bins.append(own)
    return bins


def _pack_group(capacity: int):
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("start", "ascending")])
        lengths = t["length"].to_pylist()
        rows: dict[int, list[int]] = {}
        for i in range(len(lengths) - 1, -1, -1):
            rows.setdefault(lengths[i], []).append(i)
        seq, off = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for k, own in enumerate(best_two_fit(lengths, capacity)):
            at = 0
            for n in own:
                i = rows[n].pop()
                seq[i], off[i] = k, at
                at += n
        group = t["_group"].to_numpy()
        return t.drop_columns(["_group"]).append_column("sequence_id", pa.array((group << 32) + seq)).append_column(
            "offset", pa.array(off))
    return run


def pack(rows: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``rows`` (``doc_id, piece, start, length, ids_crc32``) with
    ``sequence_id`` and ``offset``: gapless from 0 in each sequence, which holds
    at most ``capacity`` tokens. Every row is packed once, repeated rows too."""
    shared_dir(rows.sparkSession)
    rows = materialize(rows, "pieces")
    groups = max(1, -(-rows.count() // group_pieces))
    dealt = rows.withColumn("_group", F.pmod(
        # the place in the written table parts alike rows too
        F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("_group").applyInArrow(
        _pack_group(capacity),
        "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise, cut and pack every row of ``docs``.

    Null and empty texts are one ``END_ID`` token; repeated rows are packed as
    often as they come; null ids are kept; an empty table gives no rows; other
    columns are ignored."""
    return pack(pieces(docs, tokenizer_path, capacity, id_col=id_col, text_col=text_col), capacity)


def sequences(docs: DataFrame, packed: DataFrame, tokenizer_path: str, capacity: int = CAPACITY,
              id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``sequence_id, ids``: the packed token ids themselves, at most
    ``capacity`` per row. Needs unique document ids."""
    own = pieces(docs, tokenizer_path, capacity, True, id_col, text_col).select("doc_id", "piece", "ids")
    return (packed.select("doc_id", "piece", "sequence_id", "offset").join(own, ["doc_id", "piece"])
            .groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
            .select("sequence_id", F.flatten("p.ids").alias("ids")))
