"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

A task gathers whole texts into chunks of about ``CHUNK_BYTES``, encodes each
distinct text of a chunk with both tokenizers, and has for each a sorted list of
the byte offsets at which its tokens end. The shorter list of a text drives
galloping searches (exponential, then binary, from where the last one stopped)
into the longer one. The common ends cut both token rows into groups, and the
differences of their ranks are the groups' sizes, from which all links of a group
follow; within a text equal links are one pair with a count.

The corpus part never moves a text's links. A chunk has each id pair once, with
the number of its documents that link it, so a pair that every document has is
one row a chunk. Those rows are added up per pair, the highest count of each A id
is found, and both go back to the chunks, where the texts' pairs wait as numbers
into the chunk's own sorted list of pairs.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, shared_dir

CHUNK_BYTES, CHUNK_ROWS = 8 << 20, 1 << 16
#: Bytes of texts aligned at once, and links of one pass over them.
PART_BYTES, PART_LINKS = 1 << 19, 1 << 20
#: Drivers in a row of galloping searches; the first of a row starts by binary search.
RUN = 64
MEMO_WORDS, MEMO_CHARS = 400_000, 1 << 24
#: New words encoded in one row.
RUN_WORDS = 4096
_SPACE_SIGN = "▁"
#: First signs of a word that may be parted from what stands before its space:
#: printable ASCII and Latin letters, which no tokenizer takes for white space.
_PARTS = re.compile("[!-~\u00c0-\u024f]")


class Tokenizers:
    """Both tokenizers, with the bytes and the decimal id of every entry."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"   # Spark's tasks are the parallelism
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        # byte-level entries: printable bytes stand for themselves, the others for the code points from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        back = {chr(c): c for c in shown} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in shown)}
        self.a_bytes = [bytes(back.get(c, 63) for c in self.a.id_to_token(i) or "") for i in range(self.a.get_vocab_size())]
        n_b = self.b.get_piece_size()
        self.b_bytes = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i)
                        else self.b.id_to_piece(i).replace(_SPACE_SIGN, " ").encode() for i in range(n_b)]
        self.a_len, self.b_len = (np.array([len(x) for x in own], np.int64) for own in (self.a_bytes, self.b_bytes))
        self.n_b = n_b

        # no piece goes on past a space, so B's ids of a text are those of its words in a row
        self.b_parts = not any(_SPACE_SIGN in self.b.id_to_piece(i).lstrip(_SPACE_SIGN) for i in range(n_b))
        self.memo = Memo(self)
        # decimal ids, left-aligned, with room for a sign
        most = max(len(self.a_bytes), n_b)
        width = len(str(most - 1)) + 1
        self.digits = np.frombuffer(b"".join(str(i).encode().ljust(width, b"\0") for i in range(most)), np.uint8).reshape(most, width)

    def ids(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        return ([e.ids for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)],
                self.b.encode(texts, num_threads=1))

    def given_back(self, text: str, a: list[int], b: list[int]) -> bool:
        own = b" " + text.encode()
        return b"".join([self.a_bytes[x] for x in a]) == own == b"".join([self.b_bytes[x] for x in b])

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """By A and by B: the texts' ids in a row, and how many each has; none
        unless both tokenizers give back a space and the text.

        A space before a printable sign begins a new run of A and a new piece of
        B, so a text in which every space does is encoded word by word, from the
        memo; any other text is encoded as a whole."""
        parts = [t.split(" ") for t in texts]
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        at = np.concatenate(([0], np.cumsum(size)))
        places = self.memo.find(list(chain.from_iterable(parts)))
        whole = np.full(len(texts), not self.b_parts)
        whole[np.searchsorted(at, np.flatnonzero(places < 0), side="right") - 1] = True
        places = places[np.repeat(~whole, size)]
        odd = np.flatnonzero(whole).tolist()
        raw = list(zip(*self.ids([texts[i] for i in odd])))
        raw = [x if texts[i] and self.given_back(texts[i], *x) else ([], []) for i, x in zip(odd, raw)]
        out = []
        for k in range(2):
            ids, lens = self.memo.gather(k, places)
            n = np.zeros(len(texts), np.int64)
            np.add.at(n, np.repeat(np.flatnonzero(~whole), size[~whole]), lens)
            if odd:
                n[odd] = [len(r[k]) for r in raw]
                upto, mixed, done = np.cumsum(n) - n, np.empty(int(n.sum()), np.int64), np.zeros(int(n.sum()), bool)
                for i, r in zip(odd, raw):
                    mixed[upto[i]:upto[i] + len(r[k])] = r[k]
                    done[upto[i]:upto[i] + len(r[k])] = True
                mixed[~done] = ids
                ids = mixed
            out.append((ids, n))
        return out


class Memo:
    """Ids of words, each after a space, kept from text to text up to
    ``MEMO_WORDS`` words and ``MEMO_CHARS`` characters, then forgotten. Words
    that a tokenizer does not give back byte for byte, or that may not be
    parted from the text before them, are not kept."""

    def __init__(self, tok: Tokenizers):
        self.tok = tok
        self._clear()

    def _clear(self) -> None:
        self.at: dict[str, int] = {}
        self.start, self.len, self.ids = ([np.zeros(0, np.int64)] * 2 for _ in range(3))
        self.chars = 0

    def find(self, words: list[str]) -> np.ndarray:
        """Places of the words, -1 for those not kept."""
        if len(self.at) > MEMO_WORDS or self.chars > MEMO_CHARS:
            self._clear()
        out = np.fromiter(map(self.at.get, words, repeat(-1)), np.int64, len(words))
        lost = np.flatnonzero(out < 0)
        missing = [words[i] for i in lost.tolist()]
        new = [w for w in set(missing) if w and _PARTS.match(w)]
        for i in range(0, len(new), RUN_WORDS):
            self._add(new[i:i + RUN_WORDS])
        if new:
            out[lost] = np.fromiter(map(self.at.get, missing, repeat(-1)), np.int64, len(missing))
        return out

    def _add(self, new: list[str]) -> None:
        """Words encoded in one row; their ids are parted at the words' ends."""
        tok, row = self.tok, " ".join(new)
        ids = [np.array(x[0], np.int64) for x in tok.ids([row])]
        ends = np.cumsum([1 + len(w.encode()) for w in new])
        upto = [np.searchsorted(np.cumsum(n[x]), ends) + 1 for n, x in zip((tok.a_len, tok.b_len), ids)]
        if not tok.given_back(row, *(x.tolist() for x in ids)):
            if len(new) > 1:
                for half in (new[:len(new) // 2], new[len(new) // 2:]):
                    self._add(half)
            return
        self.at.update(zip(new, range(len(self.at), len(self.at) + len(new))))
        for k in range(2):
            n = np.diff(upto[k], prepend=0)
            self.start[k] = np.concatenate((self.start[k], len(self.ids[k]) + upto[k] - n))
            self.len[k] = np.concatenate((self.len[k], n))
            self.ids[k] = np.concatenate((self.ids[k], ids[k]))
        self.chars += len(row)

    def gather(self, k: int, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids (by A: 0, by B: 1) of the words at ``places`` in a row, and how many each has."""
        lens = self.len[k][places]
        first = np.cumsum(lens) - lens
        return self.ids[k][np.repeat(self.start[k][places] - first, lens) + np.arange(int(lens.sum()))], lens


@lru_cache(maxsize=1)
def _tokenizers(a_path: str, b_path: str) -> Tokenizers:
    return Tokenizers(a_path, b_path)


def gallop(short: np.ndarray, long: np.ndarray, run: int = RUN) -> np.ndarray:
    """Index in ``long`` of each of ``short`` (both rising), or -1. Rows of
    ``run`` drivers search side by side, each from where its last one stopped."""
    n, m = len(short), len(long)
    out = np.full(n, -1, np.int64)
    ext = np.append(long, np.iinfo(np.int64).max)
    heads = np.arange(0, n, run)
    pos = np.searchsorted(long, short[heads])
    for j in range(min(run, n)):
        i = heads[heads + j < n] + j
        v, lo, hi = short[i], pos[:len(i)].copy(), pos[:len(i)].copy()
        start, step = lo.copy(), 1
        live = np.flatnonzero(ext[hi] < v)
        while live.size:                                   # exponential: 1, 2, 4, ... beyond the start
            lo[live] = hi[live]
            hi[live] = np.minimum(start[live] + step, m)
            step *= 2
            live = live[ext[hi[live]] < v[live]]
        live = np.flatnonzero(hi - lo > 1)
        while live.size:                                   # binary: ext[lo] < v <= ext[hi]
            mid = (lo[live] + hi[live]) >> 1
            below = ext[mid] < v[live]
            lo[live] = np.where(below, mid, lo[live])
            hi[live] = np.where(below, hi[live], mid)
            live = live[hi[live] - lo[live] > 1]
        hit = ext[hi] == v
        out[i[hit]] = hi[hit]
        pos = hi
    return out


def common_ends(end_a: np.ndarray, at_a: np.ndarray, end_b: np.ndarray, at_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices in A and B of the ends they share. Texts lie in a row (``at_*``:
    their first tokens), so ends rise across them; in each text the shorter list drives."""
    n_a, n_b = np.diff(at_a), np.diff(at_b)
    found = []
    for a_drives in (True, False):
        own = (n_a <= n_b) == a_drives
        a, b = np.flatnonzero(np.repeat(own, n_a)), np.flatnonzero(np.repeat(own, n_b))
        short, long = (a, b) if a_drives else (b, a)
        at = gallop((end_a if a_drives else end_b)[short], (end_b if a_drives else end_a)[long])
        pair = short[at >= 0], long[at[at >= 0]]
        found.append(pair if a_drives else pair[::-1])
    ia, ib = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(ia, kind="stable")
    return ia[order], ib[order]


def _written(ids: np.ndarray, after: np.ndarray, digits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the ids in decimal, each with its sign ``after`` (0: none), and
    the n + 1 places at which they begin."""
    rows = digits[ids]
    size = (rows > 0).sum(axis=1)
    rows[np.arange(len(ids)), size] = after
    size += after > 0
    return rows[np.arange(rows.shape[1]) < size[:, None]], np.concatenate(([0], np.cumsum(size)))


def _links(ids_a, ids_b, first_a, n_a, first_b, n_b, text, n_ids_b) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, pair, how often) of all links of groups; a large group goes by its distinct ids."""
    links = n_a * n_b
    for g in np.flatnonzero(links > PART_LINKS).tolist():
        (ua, ca), (ub, cb) = (np.unique(ids[f:f + n], return_counts=True) for ids, f, n in (
            (ids_a, first_a[g], n_a[g]), (ids_b, first_b[g], n_b[g])))
        rows = max(1, PART_LINKS // len(ub))
        for i in range(0, len(ua), rows):
            pair = (ua[i:i + rows, None] * n_ids_b + ub).ravel()
            yield np.full(len(pair), text[g]), pair, np.outer(ca[i:i + rows], cb).ravel()
    small = np.flatnonzero(links <= PART_LINKS)
    upto = np.cumsum(links[small])
    i = 0
    while i < len(small):
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + PART_LINKS, side="right")))
        own = small[i:j]
        g = np.repeat(own, links[own])
        k = np.arange(len(g)) - np.repeat(np.cumsum(links[own]) - links[own], links[own])
        yield text[g], ids_a[first_a[g] + k // n_b[g]] * n_ids_b + ids_b[first_b[g] + k % n_b[g]], np.ones(len(g), np.int64)
        i = j


def _added(text: np.ndarray, pair: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One row per (text, pair), in that order, with its number of links."""
    order = np.lexsort((pair, text))
    text, pair, times = text[order], pair[order], times[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (pair[1:] != pair[:-1])
    at = np.flatnonzero(new)
    return text[at], pair[at], np.add.reduceat(times, at) if len(at) else times


def align(tok: Tokenizers, texts: list[str]):
    """Per text (n_a, n_b, n_groups, n_links, groups_sha256), and (text, pair,
    links) of their distinct id pairs (pair: A id * B's vocabulary size + B id)."""
    (ids_a, n_a), (ids_b, n_b) = tok.encode(texts)
    at_a, at_b = (np.concatenate(([0], np.cumsum(n))) for n in (n_a, n_b))
    # both tokenizers' bytes of a text are the same, so running sums over all texts agree at text ends
    ia, ib = common_ends(np.cumsum(tok.a_len[ids_a]), at_a, np.cumsum(tok.b_len[ids_b]), at_b)
    size_a, size_b = np.diff(ia, prepend=-1), np.diff(ib, prepend=-1)       # rank differences: the groups' sizes
    first_a, first_b = ia + 1 - size_a, ib + 1 - size_b
    text = np.searchsorted(at_a, ia, side="right") - 1
    n_groups = np.bincount(text, minlength=len(texts))
    n_links = np.zeros(len(texts), np.int64)
    np.add.at(n_links, text, size_a * size_b)
    parts = [_added(*p) for p in _links(ids_a, ids_b, first_a, size_a, first_b, size_b, text, tok.n_b)]
    pairs = _added(*(np.concatenate(x) for x in zip(*parts))) if parts else (np.zeros(0, np.int64),) * 3
    # the groups in decimal: A's ids of a group, then B's, each with the sign that follows it
    n_all = size_a + size_b
    upto = np.cumsum(n_all)
    g = np.repeat(np.arange(len(n_all)), n_all)
    k = np.arange(len(g)) - (upto - n_all)[g]
    of_a = k < size_a[g]
    ids = np.empty(len(g), np.int64)
    ids[of_a], ids[~of_a] = ids_a, ids_b
    after = np.full(len(g), ord(","), np.uint8)
    after[k == size_a[g] - 1] = ord("|")
    after[upto - 1] = ord(";")
    last = np.concatenate(([0], upto))[np.cumsum(n_groups)[n_groups > 0]] - 1
    after[last] = 0
    data, at = _written(ids, after, tok.digits)
    ends = at[last + 1].tolist()
    raw, digest, begin, e = data.tobytes(), [], 0, 0
    for n in n_groups.tolist():
        if n:
            digest.append(hashlib.sha256(raw[begin:ends[e]]).hexdigest())
            begin, e = ends[e], e + 1
        else:
            digest.append("")
    return (n_a, n_b, n_groups, n_links, digest), pairs


_CHUNK = pa.schema([("chunk", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("text_no", pa.list_(pa.int32())),
                    *((c, pa.list_(pa.int64())) for c in ("n_a", "n_b", "n_groups", "n_links")), ("digest", pa.list_(pa.string())),
                    ("starts", pa.binary()), ("at", pa.binary()), ("times", pa.binary()),
                    ("pairs", pa.list_(pa.int64())), ("n_docs", pa.list_(pa.int64()))])
_CHUNK_DDL = ("chunk long, doc_id array<long>, text_no array<int>, n_a array<long>, n_b array<long>, n_groups array<long>, "
              "n_links array<long>, digest array<string>, starts binary, at binary, times binary, pairs array<long>, n_docs array<long>")


class _Chunk:
    """Rows of a chunk; equal texts are aligned once."""

    def __init__(self):
        self.doc_id: list = []
        self.text_no: list[int] = []
        self.no: dict[str, int] = {}
        self.bytes = 0

    def add(self, doc_id, text: str | None) -> None:
        self.doc_id.append(doc_id)
        no = self.no.setdefault(text or "", len(self.no))
        self.text_no.append(no)
        if no == len(self.no) - 1:
            self.bytes += len(text or "") + 16

    def row(self, tok: Tokenizers, number: int) -> pa.RecordBatch:
        texts, stats, pairs, i = list(self.no), [], [], 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) <= PART_BYTES):
                size += len(texts[j])
                j += 1
            own, (text, pair, times) = align(tok, [t for t in texts[i:j]])
            stats.append(own)
            pairs.append((text + i, pair, times))
            i = j
        text, pair, times = (np.concatenate(x) for x in zip(*pairs))
        found, at = np.unique(pair, return_inverse=True)
        rows = np.bincount(self.text_no, minlength=len(texts))
        n_docs = np.zeros(len(found), np.int64)
        np.add.at(n_docs, at, rows[text])
        starts = np.searchsorted(text, np.arange(len(texts) + 1))
        pack = zstandard.ZstdCompressor(level=1).compress
        # a text's pairs rise, so their differences are small numbers; a text's first is counted from the one before
        cols = [[number], [self.doc_id], [np.array(self.text_no, np.int32)],
                *([np.concatenate([s[k] for s in stats])] for k in range(4)), [list(chain.from_iterable(s[4] for s in stats))],
                [pack(starts.astype("<i8").tobytes())], [pack(np.diff(at, prepend=0).astype("<i4").tobytes())],
                [pack(times.astype("<i8").tobytes())], [found], [n_docs]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _CHUNK)], schema=_CHUNK)


def _chunks(a_path: str, b_path: str, chunk_bytes: int, chunk_rows: int):
    def run(batches):
        tok, number, chunk = _tokenizers(a_path, b_path), TaskContext.get().partitionId() << 32, _Chunk()
        for b in batches:
            for doc_id, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist()):
                chunk.add(doc_id, text)
                if chunk.bytes >= chunk_bytes or len(chunk.doc_id) >= chunk_rows:
                    yield chunk.row(tok, number)
                    number, chunk = number + 1, _Chunk()
        if chunk.doc_id:
            yield chunk.row(tok, number)
    return run


def _digest(chunk: pa.Table, counts: pa.Table) -> pa.Table:
    """A chunk's documents with the sums over their links; ``counts``: the
    corpus-wide count of each of the chunk's pairs, and whether it is its A id's highest."""
    order = np.argsort(counts["pair"].to_numpy())
    count, best = counts["count"].to_numpy()[order], counts["best"].to_numpy()[order].astype(np.int64)
    own = chunk.to_pylist()[0]
    unpack = zstandard.ZstdDecompressor().decompress
    starts = np.frombuffer(unpack(own["starts"]), "<i8")
    at = np.cumsum(np.frombuffer(unpack(own["at"]), "<i4"), dtype=np.int64)
    times = np.frombuffer(unpack(own["times"]), "<i8")
    no = np.array(own["text_no"], np.int64)
    cols = {"doc_id": pa.array(own["doc_id"], pa.int64())}
    cols |= {c: np.array(own[c], np.int64)[no] for c in ("n_a", "n_b", "n_groups", "n_links")}
    for c, values in (("n_best", times * best[at]), ("count_sum", times * count[at])):
        upto = np.concatenate(([0], np.cumsum(values)))
        cols[c] = (upto[starts[1:]] - upto[starts[:-1]])[no]
    cols["groups_sha256"] = pa.array([own["digest"][i] for i in no.tolist()], pa.string())
    return pa.table(cols)


def token_links(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text",
                chunk_bytes: int = CHUNK_BYTES, chunk_rows: int = CHUNK_ROWS) -> tuple[DataFrame, DataFrame]:
    """``chunks`` (written: the documents of each chunk, their groups' figures and
    packed pairs) and ``counts``: ``pair, a_id, b_id, count, best`` of all linked id
    pairs, ``count`` the documents that link them."""
    spark = docs.sparkSession
    shared_dir(spark)
    n_b = Tokenizers(a_path, b_path).n_b
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    chunks = materialize(rows.mapInArrow(_chunks(a_path, b_path, chunk_bytes, chunk_rows), _CHUNK_DDL), "aligned-chunks")
    counts = materialize(_pairs(chunks).groupBy("pair").agg(F.sum("n_docs").alias("count")), "pair-counts")
    counts = counts.withColumn("a_id", F.floor(F.col("pair") / n_b).cast("long"))
    # one row per entry of A's vocabulary at most
    top = F.broadcast(counts.groupBy("a_id").agg(F.max("count").alias("most")))
    return chunks, counts.join(top, "a_id").select(
        "pair", "a_id", (F.col("pair") % n_b).alias("b_id"), "count", (F.col("count") == F.col("most")).alias("best"))


def _pairs(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk", F.explode(F.arrays_zip("pairs", "n_docs")).alias("p")).select(
        "chunk", F.col("p.pairs").alias("pair"), F.col("p.n_docs").alias("n_docs"))


def alignments(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text",
               chunk_bytes: int = CHUNK_BYTES, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row.

    Defined cases: a null or empty text, or one whose bytes a tokenizer does not
    give back, has no tokens: zeros and ''; repeated rows and equal texts count as
    documents of their own; a null id is kept; an empty table gives no rows; other
    columns are ignored. A text longer than ``chunk_bytes`` is a chunk of its own
    with those before it."""
    chunks, counts = token_links(docs, a_path, b_path, id_col, text_col, chunk_bytes, chunk_rows)
    # a pair is one row a chunk, so no key of this join has more rows than there are chunks
    known = _pairs(chunks).select(F.col("chunk").alias("of"), "pair").join(counts.select("pair", "count", "best"), "pair")
    return chunks.drop("pairs", "n_docs").groupBy("chunk").cogroup(known.groupBy("of")).applyInArrow(
        _digest, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
