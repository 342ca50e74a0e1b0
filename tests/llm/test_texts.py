"""License scan, rules, packing, repeats and near duplicates against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

import brute
from rarefold.llm import jaccard, licenses, packing, repeats, rules, words

ODD = [None, "", " ", "\n\n", "a\nb\na\n\na", " x ", "é é é é é é é é é é", "a b c d e a b c d e", "a b c d e b c d e b c d e",
       "x\n x\nx", "\x0b\x1f a", "  a", "# * $ |x| <b> & %", "w " * 3000, "MIT License mit   license",
       "mit license\x00MIT license", "xmit license", "Licensed undr the Apache License, Version 2.O",
       "the general public licenses General\nPublic. License"]


def docs(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.selectExpr("doc_id", "text", "1 as n_words", "'m' as matches", "2 as h", "3L as key", "'s' as sid") if extra else df


def tokenizer():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_word_hashes_do_not_depend_on_the_chunk():
    a = next(words.chunks(pa.array(["x y z", "x"])))
    b = next(words.chunks(pa.array(["q", None, "z x"])))
    assert a.hash[0] == a.hash[3] == b.hash[2] and a.hash[2] == b.hash[1]
    assert words.window_hash(a.hash[:3], 3)[0] != words.window_hash(a.hash[:3], 2)[0]


def test_licenses(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "MIT license"), (3, "MIT license"), (3, "MIT license")]
    got = licenses.scan(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    text = {i: t for i, t in rows[:len(ODD)]}
    for r in got:
        if r.doc_id in text and r.doc_id != 3:
            assert (r.n_words, sorted((m.first_word, m.label) for m in r.matches if m.base)) == brute.license_places(text[r.doc_id])
    one = licenses.digest(licenses.scan(docs(spark, [(1, ODD[17]), (2, None)]))).orderBy("doc_id").collect()
    assert one[0].n_base == 1 and one[0].first_word == 3 and one[0].labels == "apache" and one[0].score == 1.0
    assert one[1][1:] == (0, 0, None, None, "", "", 0.0)
    assert licenses.scan(docs(spark, [])).count() == 0


def test_fuzzy_notices_are_found_within_their_errors():
    rnd = random.Random(1)
    for text, label, errors in licenses.NOTICES:
        t = list(text)
        for _ in range(errors):
            t[rnd.randrange(len(t))] = rnd.choice("qxz")
        _, found = licenses.find("some words " + "".join(t) + " and more", (), ((text, label, errors),))
        assert [m["label"] for m in found] == [label] and found[0]["errors"] <= errors
    assert licenses.find("nothing at all", (), tuple(licenses.NOTICES))[1] == []


def test_a_notice_has_only_its_own_label():
    notices = tuple(licenses.named())
    labels = lambda t: {m["label"] for m in licenses.find(t, tuple(licenses.BASE), notices)[1]}
    for text, label, *_ in notices:
        assert labels(f"see: {text}, and more") == {label} | {la for t, la in licenses.BASE if t in text}
    assert labels("released under the bsd license") == set() == labels("released under the gpl license")
    assert labels("Licensed under CC BY-SA 4.0.") == {"cc-by-sa"} and labels("licensed under CC-BY-NC 4.0") == {"cc-by-nc"}
    assert labels("licensd under cc by nc 4.0") == {"cc-by-nc"}
    assert labels("relesed undr the MIT licence") == {"mit"} and labels("licensed under the gnu lesser general public license version 3") == {"lgpl", "gpl"}


def test_rules(spark):
    got = rules.ledger(docs(spark, list(enumerate(ODD)))).collect()
    for r in got:
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_lines] == brute.rule_counts(ODD[r.doc_id])
        assert bool(r.fail_bits & 1) == (r.n_words < 10)
    led = rules.ledger(docs(spark, list(enumerate(ODD))))
    ab = {r.rule: (r.n_failed, r.n_only) for r in rules.ablation(led, "clean-1").collect()}
    bits = [r.fail_bits & rules.mask(rules.POLICIES["clean-1"]) for r in got]
    for i, (name, _) in enumerate(rules.RULES):
        assert ab[name] == (sum(b >> i & 1 for b in bits), sum(b == 1 << i for b in bits))
    assert rules.ledger(docs(spark, [])).count() == 0


def test_word_ids_equal_the_tokenizer():
    enc = packing.WordIds(tokenizer())
    texts = ODD + ["A<|ENDOFTEXT|>. x<|endoftext|>.", "<|", "x.<|", "don.'s foo.,!? it's I'LL 12.5. é. éa. e.́ a≠. «a». a—. c.d.e ..."]
    for w in words.chunks(pa.array(texts), lower=True):
        ids, at = enc.encode(w)
        for i in range(w.n_docs):
            assert ids[at[i]:at[i + 1]].tolist() == enc.tok.encode(texts[w.first + i] or "", add_special_tokens=False).ids


def test_packing(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (5, "again"), (5, "again"), (99, "long text " * 90)]
    df = docs(spark, rows, extra=False)
    got = packing.pack(packing.pieces(df, tokenizer(), 64), 64, group_pieces=6).collect()
    enc = packing.WordIds(tokenizer())
    want = []
    for d, t in rows:
        ids = enc.tok.encode(t or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 64):
            p = np.array(ids[k:k + 64], "<u4")
            want.append((d, k // 64, k, len(p), zlib.crc32(p.tobytes())))
    assert sorted(map(str, want)) == sorted(str(tuple(r)[:5]) for r in got)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in by.values():
        s.sort()
        assert [o for o, _ in s] == [sum(n for _, n in s[:i]) for i in range(len(s))] and sum(n for _, n in s) <= 64
    own = df.where("doc_id is not null and doc_id <> 5")
    packed = packing.pack_documents(own, tokenizer(), 64)
    seqs = packing.sequences(own, packed, tokenizer(), 64).collect()
    assert sorted(i for s in seqs for i in s.ids) == sorted(
        i for d, t in rows if d not in (None, 5) for i in enc.tok.encode(t or "", add_special_tokens=False).ids + [1])
    assert packing.pack_documents(docs(spark, []), tokenizer()).count() == 0


def test_best_two_fit_is_tight():
    rnd = random.Random(2)
    lengths = [min(4096, max(1, int(rnd.lognormvariate(6, 1.2)))) for _ in range(4000)]
    bins = packing.best_two_fit(lengths, 4096)
    assert sorted(x for b in bins for x in b) == sorted(lengths) and max(map(sum, bins)) <= 4096
    assert len(bins) <= -(-sum(lengths) // 4096) * 1.01 + 1
    # the smallest of 6 + 3 gives way to 2 + 2
    assert sorted(map(sorted, packing.best_two_fit([6, 3, 2, 2], 10))) == [[2, 2, 6], [3]]


def _repeat_rows():
    rnd = random.Random(5)
    passages = [" ".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(15, 70))) for _ in range(12)]
    rows = []
    for i in range(90):
        t = [rnd.choice(passages) if rnd.random() < .6 else " ".join("x%d" % rnd.randrange(30) for _ in range(rnd.randint(1, 40)))
             for _ in range(rnd.randint(0, 5))]
        rows.append((i, rnd.choice([" ", "\n", "  "]).join(t)))
    return rows + [(200, rows[3][1]), (201, rows[3][1]), (None, rows[3][1]), (202, None), (203, ""), (3, rows[3][1]),
                   (4, rows[9][1] + " z"), (204, "w " * 500), (205, "w " * 600)]


@pytest.mark.parametrize("group_rows", [1 << 15, 3])
def test_repeats(spark, group_rows):
    rows = _repeat_rows()
    got = repeats.remove_repeats(docs(spark, rows), group_rows=group_rows).collect()
    assert sorted((brute.NO_ID if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) \
        == brute.repeats(rows)
    assert all(r.spans is None or sum(s.end - s.start for s in r.spans) == r.n_removed for r in got)


def test_cut_repeats_keeps_all_columns(spark):
    rows = _repeat_rows()
    df = docs(spark, rows).selectExpr("*", "length(text) as n_chars")
    got = repeats.cut_repeats(df, group_rows=3)
    assert got.columns == df.columns
    out = got.collect()
    have = sorted((brute.NO_ID if r.doc_id is None else r.doc_id, hashlib.sha256(
        " ".join(brute.SPACE_WORDS.findall(r.text or "")).encode()).hexdigest()) for r in out)
    assert have == sorted((d, s) for d, _, _, s in brute.repeats(rows))
    assert all(r.n_chars == len(r.text) for r in out if r.text is not None)
    assert repeats.remove_repeats(docs(spark, [])).count() == 0


def _near_rows():
    rnd = random.Random(7)
    vocab = ["v%d" % i for i in range(400)]

    def edit(b, k):
        b = list(b)
        for _ in range(k):
            b[rnd.randrange(len(b))] = rnd.choice(vocab)
        return " ".join(b)

    texts = []
    for _ in range(15):
        base = [rnd.choice(vocab) for _ in range(rnd.randint(3, 120))]
        texts += [edit(base, rnd.randint(0, 4)) for _ in range(rnd.randint(1, 8))]
    base, passage = [rnd.choice(vocab) for _ in range(100)], [rnd.choice(vocab) for _ in range(30)]
    texts += [edit(base, rnd.randint(1, 4)) for _ in range(70)]
    texts += [" ".join([rnd.choice(vocab) for _ in range(rnd.randint(5, 60))] + passage) for _ in range(40)]
    texts += [" ".join(passage[:rnd.randint(15, 30)]) for _ in range(20)]
    rows = list(enumerate(texts))
    return rows + [(1000, None), (1001, ""), (1002, "  "), (1003, "A b"), (1004, "a B"), (None, "a b"), (None, "zz yy xx"),
                   (0, rows[0][1]), (3, "totally other text with many words in it"), (2000, rows[5][1].upper())]


@pytest.mark.parametrize("block", [4096, 16])
def test_jaccard(spark, block, monkeypatch):
    if block == 16:
        monkeypatch.setattr(jaccard, "HEAVY", 300)
    rows = _near_rows()
    got = jaccard.similar_documents(docs(spark, rows), block=block).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute.components(rows)


def test_keep_one(spark):
    rows = _near_rows()
    df = docs(spark, rows)
    got = jaccard.keep_one(df)
    assert got.columns == df.columns
    comp = {}
    for d, _, c in brute.components(rows):
        comp.setdefault(d, set()).add(c)
    kept = [(r.doc_id, r.text) for r in got.collect()]
    assert len(kept) == len(set(kept))
    for d, t in kept:
        assert d is None or d in comp[d] or len(comp[d]) > 1
    assert {d for d, _, c in brute.components(rows) if d is not None and d == c and len(comp[d]) == 1} <= {d for d, _ in kept}
    assert jaccard.similar_documents(docs(spark, [])).count() == 0


def test_keep_one_judges_each_row_of_a_repeated_id(spark):
    rnd = random.Random(17)
    words = lambda: ["q%d" % rnd.randrange(10 ** 6) for _ in range(60)]
    near = lambda t: " ".join(t[:30] + ["other"] + t[31:])
    a, b, c, e, f = (words() for _ in range(5))
    rows = [(1, " ".join(a)), (5, near(a)), (5, "unique " * 3 + "text here and there"),       # 5's other text stays
            (7, " ".join(c)), (9, near(c)), (7, near(b)), (2, " ".join(b)),                   # 7 is kept for c, dropped for b
            (None, " ".join(e)), (None, near(e)), (None, " ".join(e)),                        # one without ids
            (11, " ".join(f)), (11, near(f)), (11, " ".join(f)), (None, near(f)),             # one of a tied id
            (None, None), (None, ""), (None, None), (12, ""), (12, "")]
    got = [(r.doc_id, r.text) for r in jaccard.keep_one(docs(spark, rows)).collect()]
    assert sum(i == 11 for i, _ in got) == 1
    one = [t for i, t in got if i is None and t]
    assert len(one) == 1 and one[0] in (" ".join(e), near(e))
    rest = [r for r in got if r[0] != 11 and not (r[0] is None and r[1])]
    assert sorted(rest, key=str) == sorted([rows[0], rows[2], rows[3], rows[6], (None, None), (None, ""), (None, None), (12, "")], key=str)


def test_trees_find_every_pair_of_one_group():
    rnd = np.random.default_rng(3)
    base = rnd.choice(1 << 40, 300, replace=False).astype(np.uint64)
    sets = [np.unique(np.concatenate((rnd.choice(base, 100 + k % 40, replace=False), rnd.choice(1 << 40, 20).astype(np.uint64))))
            for k in range(60)]
    sets += [np.unique(np.concatenate((s[:-8], rnd.choice(1 << 40, 8).astype(np.uint64)))) for s in sets[:20]]
    n = np.array([len(s) for s in sets])
    bits = np.zeros((len(sets), jaccard.BITS), bool)
    for k, s in enumerate(sets):
        bits[k, (s % np.uint64(jaccard.BITS)).astype(int)] = True
    bits = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
    zero = np.zeros(len(sets), np.int64)
    got = {(int(a), int(b)) for x, y in jaccard._join_trees(np.array([0]), np.arange(len(sets)), n, zero, np.arange(len(sets)), bits)
           for a, b in zip(x, y)}
    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= 75 * (n[a] + n[b] - both):
                assert (a, b) in got or (b, a) in got


@pytest.mark.parametrize("texts", [[None, ""], [""], [" ", "\n"], [" ", None, "x"]])
def test_chunks_without_words(texts):
    """Helpers on chunks that have no bytes, no words or one word."""
    from rarefold.llm import quality, toxicity
    batch = lambda *cols: [pa.RecordBatch.from_arrays(list(cols), names=[f"c{i}" for i in range(len(cols))])]
    ids, col, n = pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string()), len(texts)
    rows = lambda out: sum(b.num_rows for b in out)
    key = pa.array([0] * n, pa.int64())
    assert rows(rules._measure(batch(ids, col))) == rows(quality._measure(batch(ids, col))) == n
    assert rows(repeats._survey(20, 8)(batch(ids, col))) == n
    assert rows(repeats._suffixes(20, 8)(batch(ids, col, key, pa.array([[]] * n, pa.list_(pa.int32()))))) == 0
    kind = pa.list_(pa.struct([("at", pa.int64()), ("again", pa.int64())]))
    assert rows(repeats._cut(20)(batch(ids, col, key, pa.array([None] * n, kind)))) == n
    assert rows(jaccard._batch_sets(batch(ids, col))) == n
    heavy = type("B", (), {"value": (np.zeros(0, np.uint64), np.zeros(0, np.int64))})
    assert rows(jaccard._survey(heavy)(batch(ids, col))) == n and rows(jaccard._count_heavy(batch(col))) == 0
    lexicon = type("B", (), {"value": toxicity.Lexicon(np.ones(1, np.uint64), np.ones(1), -0.1, 1.0)})
    assert rows(toxicity._scan(lexicon)(batch(ids, col))) == n
    assert list(toxicity._count_labelled(batch(col, pa.array([1] * n, pa.int32()))))
    assert list(toxicity._count_corpus(type("B", (), {"value": np.ones(1, np.uint64)}))(batch(col)))
    enc = packing.WordIds(tokenizer())
    assert [len(enc.encode(w)[0]) for w in words.chunks(col, lower=True)] == [1 if "x" in texts else 0]


CLASH = ["_out", "_out_", "_key", "_plan_id", "_plan", "_leak", "_rejected", "_x", "label", "first", "row_key", "k", "doc", "found", "sha"]


def test_stages_take_columns_of_any_name(spark):
    """Every stage keeps extra columns whose names it uses itself."""
    from rarefold.llm import decontam, quality
    rows = [(i, " ".join(f"w{(i // 2 * 7 + j) % 97}" for j in range(60)), i) for i in range(24)] + [(None, None, 1), (3, "", 2), (3, "", 2)]
    d = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").selectExpr("*", *[f"doc_id as {c}" for c in CLASH])
    items = spark.createDataFrame([(1, rows[4][1]), (2, "not in there at all")], "item_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(24)], "doc_id long, good int")
    for out in (jaccard.keep_one(d), repeats.cut_repeats(d), decontam.decontaminate(d, items), quality.keep_good(d, labels)):
        assert out.columns == d.columns
        got = out.collect()
        assert got and all(r[c] == r.doc_id for r in got for c in CLASH)
    assert decontam.decontaminate(d, items).where("doc_id in (4, 5)").count() == 0


def test_copies_of_one_row_are_dealt_to_several_groups(spark):
    rows = spark.range(300).selectExpr("cast(null as long) as doc_id", "0 as piece", "0L as start", "1L as length", "7L as ids_crc32")
    got = packing.pack(rows, capacity=8, group_pieces=50).collect()
    assert len(got) == 300 and len({r.sequence_id >> 32 for r in got}) > 2


def test_rows_that_repeat_an_id_are_scored_once_each(spark):
    from rarefold.llm import quality
    rows = [(i // 5, f"word {'good ' * (i % 3)} {'#' * (i % 4)} text {i}") for i in range(60)]
    labels = spark.createDataFrame([(i, g) for i in range(12) for g in {i % 2, i % 3 % 2}], "doc_id long, good int")
    out, model = quality.classify(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    assert out.count() == 60 and any(any(w) for w in model.weights)
