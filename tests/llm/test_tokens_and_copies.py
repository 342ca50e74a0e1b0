"""Grace deduplication, the filter interaction audit and token alignment against brute force."""

import collections
import hashlib
import itertools
import os
import random

import duckdb
import numpy as np
import pytest

import brute
from rarefold.llm import alignment, dedup, interaction, queries

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "A b", "a B", "a b", "É b", "é b", "x" * 5000, "X" * 5000, "\n", "<|endoftext|> a <s>", "▁ sign", "naïve\tcafé 12345",
       "日本語 text", "a  b   c    d", "😀😀 ok", "<0x41> &#$", "\x00 nul", "é combining"]


def _sorted(rows):
    return sorted((tuple(r) for r in rows), key=str)


# Grace deduplication

def _copies(rows):
    groups = collections.defaultdict(list)
    for i, (d, t) in enumerate(rows):
        groups[brute.lower(t)].append((d, i))
    out = []
    for t, own in groups.items():
        ids = [d for d, _ in own if d is not None]
        keep, left = max(ids, default=None), 1
        for d, _ in own:
            stays = d == keep and left
            left -= stays
            out.append((d, keep, len(own), bool(stays), hashlib.sha256(t.encode()).hexdigest()))
    return _sorted(out)


@pytest.mark.parametrize("table_bytes, fill_rows, fan_in", [(dedup.TABLE_BYTES, dedup.FILL_ROWS, dedup.FAN_IN), (600, 7, 2), (600, 2, 1000)])
def test_duplicates(spark, table_bytes, fill_rows, fan_in):
    rnd = random.Random(1)
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100 + i, rnd.choice(ODD + ["hot"] * 20)) for i in range(150)] \
        + [(None, "a b"), (None, "only null"), (None, "ONLY null"), (3, "A b"), (3, "A b"), (169, "hot"), (169, "hot")]
    rnd.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as entry", "2 as n", "'x' as member").repartition(5)
    got = dedup.duplicates(docs, table_bytes=table_bytes, fill_rows=fill_rows, fan_in=fan_in)
    assert _sorted(got.collect()) == _copies(rows)
    assert dedup.duplicates(docs.limit(0)).count() == 0


def test_equal_hashes_do_not_merge(spark, monkeypatch):
    table = dedup.ContentTable(1 << 20)
    assert [table.place(7, t) for t in (b"a", b"b", b"a", b"c", b"b")] == [0, 1, 0, 2, 1]
    small = dedup.ContentTable(10)
    assert [small.place(h, t) for h, t in ((1, b"long text" * 9), (2, b"b"), (1, b"long text" * 9))] == [0, -1, 0]
    many = dedup.ContentTable(1 << 30)
    keys = [str(i).encode() for i in range(5000)]
    assert [many.place(i % 17, t) for i, t in enumerate(keys)] == list(range(5000))
    assert [many.place(i % 17, t) for i, t in enumerate(keys)] == list(range(5000))


# the audit

def _audit(rows, labels):
    """(doc_id, text, part) and (doc_id, quality, toxic) rows to the audit's rows, one order at a time."""
    texts = [t or "" for _, t, _ in rows]
    fails = []
    for (d, _, _), t in zip(rows, texts):
        w = brute.SPACE_WORDS.findall(t)
        fails.append({"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w),
                      "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), "D": any(c in "#$%&*|" for c in t),
                      "E": d is not None and any(e is not None and e < d and u == t for (e, _, _), u in zip(rows, texts))})
    good, toxic = ({d for d, *v in labels if d is not None and v[k] == 1} for k in (0, 1))
    out = []
    for part in {p or "" for _, _, p in rows}:
        own = [(d, f) for (d, _, p), f in zip(rows, fails) if (p or "") == part]
        steps, total = [], collections.Counter()
        for order in itertools.permutations("ABCDE"):
            alive = own
            for step, f in enumerate(order, 1):
                gone = [d for d, x in alive if x[f]]
                before = len(alive)
                alive = [(d, x) for d, x in alive if not x[f]]
                total[f] += len(gone)
                steps.append([part, "".join(order), step, len(alive), before - len(alive), sum(x[f] for _, x in own) - len(gone),
                              sum(d in good for d in gone), sum(d in toxic for d in gone),
                              sum(x[f] and sum(x.values()) == 1 for _, x in own), f])
        out += [tuple(s[:-1] + [total[s[-1]]]) for s in steps]
    return _sorted(out)


def test_audit(spark):
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    texts = [None, "", " \n", "AB", "a # b", " ".join(words), " ".join(words) + " $", " ".join(words[:20] * 10), "X" * 40 + " " + " ".join(words),
             "café " * 120, " ".join(words[:99]), " ".join(words[:100]), "ABCDEFGHIJ" + "k" * 90, "ABCDEFGHIJL" + "k" * 89]
    rows = [(i, rnd.choice(texts), rnd.choice(["en", "de", None, ""])) for i in range(120)] \
        + [(None, texts[5], "en"), (None, texts[5], "en"), (3, texts[5], "de"), (3, texts[5], "de"), (500, "a", "zz"), (-4, texts[6], "en")]
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1])) for i in range(0, 130, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'c' as code", "0 as part", "5 as n")
    own = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "1 as text")
    assert _sorted(interaction.audit(docs.repartition(3), own).collect()) == _audit(rows, labels)
    assert interaction.audit(docs.limit(0), own).count() == 0
    assert len(interaction.audit(docs, own.limit(0)).collect()) == 600 * 4


def test_packed_counters_do_not_overflow():
    codes = [0, 31, 31 | interaction.GOOD, 5 | interaction.TOXIC, 16]
    n = [2 ** 62, 3, 2 ** 40, 7, 1]
    total = sum(k * interaction.packed(c) for c, k in zip(codes, n))
    want = sum(k * interaction.unpack(interaction.packed(c)) for c, k in zip(codes, n))
    assert (interaction.unpack(total) == want).all() and interaction.unpack(interaction.packed(0))[:, :, 0].all()
    assert {interaction.unpack(interaction.packed(c))[:, :, :3].sum() for c in range(32)} >= {600}


# token alignment

def _encoded(a, b, text):
    own = (" " + text).encode()
    ia = a.encode(" " + text, add_special_tokens=False).ids
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(c): c for c in shown} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in shown)}
    ba = [bytes(back[c] for c in a.id_to_token(i)) for i in ia]
    ib = b.encode(text)
    bb = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ib for p in [b.id_to_piece(i)]]
    return (ia, ba, ib, bb) if text and b"".join(ba) == own == b"".join(bb) else ([], [], [], [])


def _aligned(rows):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    docs, count = [], collections.Counter()
    for d, t in rows:
        ia, ba, ib, bb = _encoded(a, b, t or "")
        ea, eb = (list(itertools.accumulate(map(len, x))) for x in (ba, bb))
        ends = sorted(set(ea) & set(eb))
        groups = [([i for i, e in zip(ia, ea) if lo < e <= hi], [i for i, e in zip(ib, eb) if lo < e <= hi])
                  for lo, hi in zip([0] + ends, ends)]
        links = [(x, y) for g, h in groups for x in g for y in h]
        count.update(set(links))
        docs.append((d, len(ia), len(ib), groups, links))
    best = {}
    for (x, _), n in count.items():
        best[x] = max(best.get(x, 0), n)
    return _sorted((d, n_a, n_b, len(groups), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links),
                    hashlib.sha256(";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups).encode()).hexdigest()
                    if groups else "") for d, n_a, n_b, groups, links in docs)


@pytest.mark.parametrize("chunk_bytes, chunk_rows", [(alignment.CHUNK_BYTES, alignment.CHUNK_ROWS), (300, 5)])
def test_alignments(spark, monkeypatch, chunk_bytes, chunk_rows):
    import public_tokenizers as p
    rows = list(enumerate(ODD)) + [(30 + i, t) for i, t in enumerate(ODD)] + [(None, "a b"), (3, "A b"), (3, "A b"), (90, "the cat the cat " * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as chunk", "2 as pair").repartition(3)
    got = alignment.alignments(docs, p.path("byte_bpe_50k.json"), p.path("piece_bpe_32k.model"), chunk_bytes=chunk_bytes, chunk_rows=chunk_rows)
    assert _sorted(got.collect()) == _aligned(rows)
    assert alignment.alignments(docs.limit(0), p.path("byte_bpe_50k.json"), p.path("piece_bpe_32k.model")).count() == 0


def test_large_groups_by_distinct_ids(monkeypatch):
    rnd = np.random.default_rng(3)
    ids_a, ids_b = rnd.integers(0, 9, 60), rnd.integers(0, 7, 50)
    first = (np.array([0, 20, 21]), np.array([20, 1, 39]), np.array([0, 3, 4]), np.array([3, 1, 46]))
    want = collections.Counter((g, int(x) * 7 + int(y)) for g in range(3) for x in ids_a[first[0][g]:][:first[1][g]]
                               for y in ids_b[first[2][g]:][:first[3][g]])
    for most in (1 << 20, 50, 5):
        monkeypatch.setattr(alignment, "PART_LINKS", most)
        parts = list(alignment._links(ids_a, ids_b, *first, np.arange(3), 7))
        text, pair, times = alignment._added(*(np.concatenate(x) for x in zip(*parts)))
        assert dict(zip(zip(text.tolist(), pair.tolist()), times.tolist())) == want


def test_gallop():
    rnd = np.random.default_rng(4)
    for n, m, top in [(0, 5, 9), (5, 0, 9), (1, 1, 1), (40, 900, 2000), (300, 301, 500), (700, 5000, 5001)]:
        top = max(top, n, m)
        a, b = (np.sort(rnd.choice(top, k, replace=False)).astype(np.int64) for k in (n, m))
        where = {int(x): i for i, x in enumerate(b)}
        for run in (1, 3, 64):
            assert alignment.gallop(a, b, run).tolist() == [where.get(int(x), -1) for x in a]


# the queries on a given table

@pytest.mark.parametrize("name", ["op11_exact_dedup", "op12_filter_interaction"])
def test_query_equals_sql(spark, name):
    fn, sql = queries.QUERIES[name]
    con = duckdb.connect()
    for t in ("documents", "labels"):
        p = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*' if os.path.isdir(p) else p}')")
    df = fn(spark, SF)
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    assert sorted(names) == sorted(df.columns)
    assert _sorted([r[c] for c in sorted(df.columns)] for r in df.collect()) == _sorted(
        [r[names.index(c)] for c in sorted(df.columns)] for r in res.fetchall())


def test_alignment_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert _sorted(queries.QUERIES["op13_token_alignment"][0](spark, SF).collect()) == _aligned(rows)
