"""URL filters, WARC, classifiers, decontamination, and the queries."""

import base64
import hashlib
import random
import re

import duckdb
import numpy as np
import pytest

import brute
from pyspark.sql import functions as F
from rarefold.llm import decontam, quality, queries, toxicity, urlfilter, warc
from rarefold.llm.components import components
from rarefold.session import materialize, scratch_path

SF01 = "/root/testdata/sf0.01"
TABLES = ["documents", "pages", "labels", "benchmark"]


def test_components(spark):
    rnd = random.Random(4)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(120)] + [(500 + i, 501 + i) for i in range(40)] \
        + [(600, 600)] + [(700, 701 + i) for i in range(50)]
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: top(x) for a, b in edges for x in (a, b) if a != b}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# URL filters

URLS = ["http://a.example.com/en/1", "https://www.Example.COM/en/x?y#z", "http://x.net/es/1", "http://net/fr/2", "ftp://q.org", "nothing",
        None, "", "http://BAD.org/p/?utm_source=a&b=1#f", "https://www.bad.org/p?b=1", "http://bad.org/p?b=1&ref=x", "http://bad.org/q",
        "http://bad.org", "x://h\n/p\nq", "http://a?b://c/d", "http://m.bad.org/P"]


def _verdicts(rows, listed):
    out = []
    for i, u in rows:
        m = re.search(r"(?s)^.*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (brute.lower(m[1]), m[2]) if m else ("", "")
        fit = max((r for r in urlfilter.RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])),
                  key=lambda r: len(r[1] + r[2]), default=None)
        hit = fit is None and _canonical(u) is not None and _canonical(u) in {_canonical(x) for x in listed}
        out.append((i, host, path, fit and fit[1] + fit[2], fit[0] if fit else "block" if hit else "allow", hit))
    return sorted(out, key=str)


def _canonical(u):
    if not u or "://" not in u:
        return None
    m = re.search(r"(?s)^.*?://([^/?#]*)([^?#]*)", u)
    q = re.search(r"(?s)^[^?#]*\?([^#]*)", u)
    q = re.sub(r"&(utm_[a-z]+|ref)=[^&]*", "", "&" + (q[1] if q else ""))
    return re.sub(r"^(www|m)\.", "", brute.lower(m[1])) + re.sub(r"/+$", "", m[2]) + re.sub(r"[?&]+$", "", re.sub("^&+", "?", q))


@pytest.mark.parametrize("bound", [1 << 18, 0])
def test_url_filter(spark, bound, monkeypatch):
    monkeypatch.setattr(urlfilter, "BROADCAST_BLOCKS", bound)
    rows = list(enumerate(URLS)) + [(None, "http://bad.org/q"), (11, "http://bad.org/q"), (11, "http://bad.org/q")]
    listed = ["http://bad.org/p?b=1", "https://m.bad.org/q/", None, "broken", "http://bad.org/q", "http://x.net/es/1"]
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'h' as host", "'v' as verdict", "1 as block")
    got = urlfilter.filter_urls(pages, spark.createDataFrame([(u,) for u in listed], "url string")).collect()
    assert sorted((tuple(r) for r in got), key=str) == _verdicts(rows, listed)
    none = urlfilter.filter_urls(pages, spark.createDataFrame([], "url string")).collect()
    assert sorted((tuple(r) for r in none), key=str) == _verdicts(rows, [])
    assert urlfilter.filter_urls(pages.limit(0), spark.createDataFrame([(u,) for u in listed], "url string")).count() == 0


def test_bloom_filter_has_no_false_negatives_and_few_false_positives(spark):
    keys = spark.range(3000).selectExpr("concat('k', id) as canonical")
    n = urlfilter.blocks_for(3000)
    filt = urlfilter.bloom(keys, n)
    probe = spark.range(20000).selectExpr("concat('k', id) as canonical", "id")
    bits = urlfilter._bits(F.col("canonical"))
    passes = F.lit(True)
    for i, b in enumerate(bits):
        passes = passes & (F.col(f"w{i}").bitwiseAND(b) == b)
    got = probe.withColumn("block", urlfilter._block(F.col("canonical"), n)).join(filt, "block").where(passes)
    r = got.agg(F.count(F.when(F.col("id") < 3000, 1)), F.count(F.when(F.col("id") >= 3000, 1))).first()
    assert r[0] == 3000 and r[1] < 17000 * 0.02


# WARC

@pytest.mark.parametrize("bound", [200_000, 0])
def test_warc_round_trip(spark, bound, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_REVISITS", bound)
    rows = [(5, "http://a/x", "same"), (3, "http://a/y", "same"), (9, None, "same"), (1, "u\r\nWARC/1.1\r\n\r\n", ""), (2, "http://a", None),
            (7, "http://b", "WARC/1.1\r\n\r\nWARC-Type: response\r\n\r\nContent-Length: 3\r\n\r\n"), (8, "http://é", "é\x00\n" * 3000),
            (None, "http://n", "same"), (None, "http://n", "alone"), (4, "http://d", "twice"), (4, "http://d", "twice")]
    path = scratch_path(spark, "warc-test")
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as digest", "0 as type", "0 as n")
    archive = warc.write_archive(pages, path)
    got = warc.assemble(warc.read_archive(spark, path, archive)).collect()
    assert len(got) == len(rows)
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = []
    for i, _, h in rows:
        h = h or ""
        digest = base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
        f = first.get(h)
        revisit = f is not None and f != i
        want.append((i, len(h.encode()), digest, "revisit" if revisit else "response", f if revisit else None,
                     None if revisit else h))
    have = [(r.metadata.page_id, r.metadata.payload_bytes, r.response.digest, r.response.type, r.response.refers_to, r.response.payload)
            for r in got]
    assert sorted(have, key=str) == sorted(want, key=str)
    assert all(r.response.read_digest in (None, r.response.digest) and r.request.block.startswith("GET ") for r in got)
    other = warc.assemble(warc.read_archive(spark, path, archive).where("type <> 'metadata'"))
    assert other.where("metadata is null").count() == len(rows)
    empty = scratch_path(spark, "warc-empty")
    archive = warc.write_archive(pages.limit(0), empty)
    assert warc.assemble(warc.read_archive(spark, empty, archive)).count() == 0


# classifiers

def _corpus(spark):
    return (spark.read.parquet(f"{SF01}/documents.parquet"), spark.read.parquet(f"{SF01}/labels.parquet"))


def test_quality_on_held_out_rows(spark):
    docs, labels = _corpus(spark)
    odd = spark.createDataFrame([(-1, None, "x", "y", 0), (-2, "", "x", "y", 0), (None, "w " * 5000, "x", "y", 0), (-1, None, "x", "y", 0)], docs.schema)
    both = docs.unionByName(odd).withColumn("score", F.lit(1)).withColumn("raw", F.lit(1)).withColumn("good", F.lit(1))
    labels = labels.selectExpr("doc_id", "quality as good")
    out, model = quality.classify(both, labels.unionByName(spark.createDataFrame([(10 ** 9, 1), (None, 0), (5, None)], "doc_id long, good int")))
    out = materialize(out, "test-quality")
    assert out.count() == docs.count() + 4
    held = out.where("held_out").join(labels, "doc_id").collect()
    assert sum(r.predicted == r.good for r in held) >= 0.97 * len(held) > 0
    good, bad = [r.score for r in held if r.good], [r.score for r in held if not r.good]
    assert np.mean([g > b for g in good for b in bad]) > 0.98
    r = out.agg(F.min("score"), F.max("score"), F.count(F.when(F.col("predicted") != (F.col("score") >= 0.3).cast("int"), 1))).first()
    assert 0 <= r[0] and r[1] <= 1 and r[2] == 0
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    lab = labels.collect()
    assert np.mean([x.doc_id in ids for x in lab if x.good]) > 0.98 and np.mean([x.doc_id in ids for x in lab if not x.good]) < 0.05


def test_quality_without_pairs(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    one = spark.createDataFrame([(1, 1)], "doc_id long, good int")
    for d, la, n in ((docs, one, 2), (docs, one.limit(0), 2), (docs.limit(0), one, 0)):
        out = quality.classify(d, la)[0].collect()
        assert len(out) == n and all(abs(r.score - quality.THRESHOLD) < 1e-9 and r.predicted == 1 for r in out)


def test_segments_are_all_maximal_ones():
    rnd = random.Random(8)
    for _ in range(200):
        s = [float(rnd.choice([-4, -3, -2, -1, 1, 2, 3, 5])) + rnd.random() / 1000 for _ in range(rnd.randrange(0, 14))]
        assert [(a, b) for a, b, _ in toxicity.segments(np.array(s))] == [(a, b) for a, b, _ in brute.segments(s)]


def test_rate_solves_its_equation():
    w, p = np.array([6.0, 2.0, -0.2]), np.array([0.001, 0.01, 0.989])
    assert abs(p @ np.exp(toxicity._rate(w, p) * w) - 1) < 1e-6
    assert toxicity._rate(np.array([-1.0]), np.array([1.0])) == 0


def test_toxicity(spark):
    rnd = random.Random(9)
    vocab = ["w%s" % "".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    rows, labels = [], []
    for i in range(900):
        t = [rnd.choice(vocab) for _ in range(rnd.randint(5, 80))]
        toxic = i % 6 == 0
        if toxic:
            k = rnd.randrange(len(t))
            t[k:k] = [rnd.choice(["vile", "rotten", "grumblx" + rnd.choice("abc")]) for _ in range(rnd.randint(1, 3))]
        rows.append((i, " ".join(t).upper() if i % 7 == 0 else ", ".join(t)))
        labels.append((i, int(toxic)))
    rows += [(None, "vile rotten"), (5000, None), (5001, ""), (5002, "calm " * 4000), (5002, "calm " * 4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as toxic", "2 as n_words", "3 as segments")
    la = spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, toxic int")
    out, lexicon = toxicity.classify(docs, la)
    out = out.collect()
    assert len(out) == len(rows)
    truth = dict(labels)
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert held and all(r.predicted == truth[r.doc_id] for r in held)
    by = {r.doc_id: r for r in out}
    assert by[5000].score == by[5001].score == by[5002].score == 0 and by[None].predicted == 1
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out)
    spans = {r.doc_id: r.segments for r in toxicity.scan(docs, lexicon).collect()}
    assert spans[None][0].start == 0 and spans[None][0].end == 2
    for d, a in ((docs, la.limit(0)), (docs.limit(0), la)):
        assert all(r.predicted == 0 for r in toxicity.classify(d, a)[0].collect())


def test_toxicity_is_calibrated_on_every_labelled_row(spark, monkeypatch):
    rnd = random.Random(12)
    vocab = ["w%s" % "".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(100)]
    rows, labels = [], []
    for i in range(1200):
        t, toxic = [rnd.choice(vocab) for _ in range(rnd.randint(5, 60))], i % 9 == 0
        if toxic or rnd.random() < .15:      # clean documents hold single toxic words too
            t[0:0] = ["vile"] * (rnd.randint(1, 3) if toxic else 1) + ["rotten"] * (toxic and rnd.random() < .5)
        rows.append((i, " ".join(t)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    la = spark.createDataFrame(labels + [(4, 7), (None, 1), (8, None)], "doc_id long, toxic int")
    whole = toxicity.training_rows
    monkeypatch.setattr(toxicity, "training_rows", lambda x: whole(x, 60))
    lexicon = toxicity.classify(docs, la)[1]
    known = la.where("toxic in (0, 1)").where(~quality.held_out(F.col("doc_id"), 3, 1))
    seen = [(r.toxic, r.n_words, [s.score for s in r.segments]) for r in toxicity.scan(docs, lexicon).join(known, "doc_id").collect()]
    assert len(seen) > 700 and sum(t for t, _, _ in seen) > 60      # more than the sample, in both classes
    clean = [n * np.exp(-lexicon.rate * max(s, default=0.0)) for t, n, s in seen if not t]
    assert abs(lexicon.k - len(clean) / sum(clean)) < 1e-6
    ev = [(t, sum(max(0.0, lexicon.rate * x - np.log(max(n, 1) * lexicon.k)) for x in s)) for t, n, s in seen]
    cost = lambda cut: sum(t != (e >= cut) for t, e in ev)
    assert cost(lexicon.cut) <= min(cost(e + 1e-6) for _, e in ev) + 0.01 * len(ev)


# decontamination

@pytest.mark.parametrize("bound", [500_000, 0])
def test_leaks(spark, bound, monkeypatch):
    monkeypatch.setattr(decontam, "BROADCAST_SHINGLES", bound)
    monkeypatch.setattr(decontam, "BROADCAST_DOCS", min(bound, decontam.BROADCAST_DOCS))
    rnd = random.Random(3)
    vocab = ["w%d" % i for i in range(300)]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.randint(2, 60)))) for i in range(40)]
    items += [(100, items[0][1] + " tail words here"), (0, items[0][1]), (None, "x y z"), (200, None), (201, ""),
              (202, "which of the following " + items[3][1]), (203, "which of the following " + items[4][1])]
    rows = []
    for i in range(200):
        t = [rnd.choice(vocab) for _ in range(rnd.randint(0, 120))]
        if rnd.random() < .6:
            x = (rnd.choice(items)[1] or "").split()
            for _ in range(rnd.randint(0, 2)):
                if x:
                    x[rnd.randrange(len(x))] = rnd.choice(vocab)
            k = rnd.randint(0, len(t))
            t[k:k] = x
        rows.append((i, ", ".join(t).upper() if rnd.random() < .2 else " ".join(t)))
    rows += [(300, None), (301, ""), (1, items[5][1]), (None, items[6][1]), (None, "clean text it is"), (302, items[7][1]),
             (302, items[7][1]), (303, (items[8][1] + " ") * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as m", "2 as fp", "3 as row_key", "'s' as sh")
    its = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as m", "2 as h")
    got = {}
    for r in decontam.leaks(docs, its).collect():
        got[r.doc_id, r.item_id] = max(r.similarity, got.get((r.doc_id, r.item_id), 0))
        assert r.distance <= decontam.RADIUS
    want = brute.leaks(rows, items)
    assert got == want and len(got) > 30
    clean = decontam.decontaminate(docs, its)
    assert clean.columns == docs.columns
    ids = [r.doc_id for r in clean.collect()]
    assert None in ids and not {d for d, _ in want if d not in (None, 1)} & set(ids) and {300, 301} <= set(ids)
    assert decontam.leaks(docs.limit(0), its).count() == 0 and decontam.leaks(docs, its.limit(0)).count() == 0


@pytest.mark.parametrize("bound", [500_000, 0])
def test_near_copies_of_repeated_and_templated_items_leak(spark, bound, monkeypatch):
    monkeypatch.setattr(decontam, "BROADCAST_SHINGLES", bound)
    rnd = random.Random(21)
    words = lambda n: ["w%d" % rnd.randrange(10 ** 6) for _ in range(n)]
    once, twice, four, template = (words(50) for _ in range(4))
    items = [(1, once), (2, twice), (3, twice), *[(k, four) for k in range(4, 8)],
             *[(k, template + words(3)) for k in range(10, 16)]]       # they differ in three words at the end
    its = spark.createDataFrame([(i, " ".join(t) + "!" * (i == 3)) for i, t in items], "item_id long, text string")
    near = lambda t: t[:25] + ["other"] + t[26:]
    rows = [(1, near(once)), (2, near(twice)), (3, near(four)), (4, words(9) + near(items[-1][1]) + words(9)), (5, words(60)), (6, template[:30] + words(23))]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string")
    found = decontam.leaks(docs, its, plain=True).collect()
    assert {(r.doc_id, r.item_id) for r in decontam.leaks(docs, its).collect()} >= {(1, 1), (2, 2), (2, 3), *[(3, k) for k in range(4, 8)]}
    pairs = {(r.doc_id, r.item_id) for r in found}
    assert pairs >= {(1, 1), (2, 2), (2, 3), *[(3, k) for k in range(4, 8)], (4, 15)} and {d for d, _ in pairs} == {1, 2, 3, 4}
    assert {r.similarity for r in found if r.doc_id < 4} == {round(41 / 51, 6)} and all(r.similarity >= 0.75 for r in found)
    assert {r.doc_id for r in decontam.decontaminate(docs, its).collect()} == {5, 6}


def test_hamming_blocks_find_every_pair_within_the_radius(spark):
    rnd = random.Random(6)
    pairs = []
    for _ in range(200):
        a = rnd.getrandbits(60)
        b = a
        for bit in rnd.sample(range(60), rnd.randint(0, 19)):
            b ^= 1 << bit
        pairs.append((a, b))
    df = spark.createDataFrame(pairs, "a long, b long")
    same = F.arrays_overlap(decontam.blocks(F.col("a")), decontam.blocks(F.col("b")))
    assert df.where(same).count() == len(pairs)


def test_simhash_is_the_majority_of_bits(spark):
    rnd = random.Random(10)
    rows = [([rnd.getrandbits(63) for _ in range(n)],) for n in (1, 2, 5, 36, 300)]
    got = [r[0] for r in spark.createDataFrame(rows, "sh array<long>").select(decontam.simhash(F.col("sh"))).collect()]
    assert got == [sum(1 << b for b in range(60) if 2 * sum(h >> b & 1 for h in s) > len(s)) for (s,) in rows]


# the registered queries

def test_native_queries_run_no_python(spark):
    for name in ("op3_url_filter", "op9_decontamination"):
        plan = queries.QUERIES[name][0](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow", plan.replace("ArrowEvalPythonTotal", ""))


@pytest.mark.parametrize("name", [n for n, (_, sql) in queries.QUERIES.items() if sql])
def test_query_equals_sql(spark, name):
    fn, sql = queries.QUERIES[name]
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    df = fn(spark, "/root/testdata/sf0.001")
    cols = sorted(df.columns)
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    want = sorted((tuple(r[names.index(c)] for c in cols) for r in res.fetchall()), key=str)
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str) == want


def test_queries_equal_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    q = {n: fn for n, (fn, _) in queries.QUERIES.items()}
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in q["op4_jaccard_join"](spark, sf).collect()), key=str) \
        == brute.components(rows)
    assert sorted(tuple(r) for r in q["op7_substring_dedup"](spark, sf).collect()) == brute.repeats(rows)
    text = dict(rows)
    for r in q["op1_license_scan"](spark, sf).collect():
        n, places = brute.license_places(text[r.doc_id])
        at = [p for p, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (
            n, len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert {(r.doc_id, r.item_id): r.similarity for r in q["op9_decontamination"](spark, sf).collect()} == brute.leaks(rows, items)


def test_pipeline(spark):
    """Each stage against brute force on its own input; the last against run()."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        out = materialize(stage(spark, docs, sf), "test-stage")
        if name != "best_fit_packing":
            assert out.dtypes == docs.dtypes
            after = {r.doc_id: r.text for r in out.collect()}
        if name == "quality_classifier":
            assert set(after.items()) < set(before)
        elif name == "jaccard_join":
            assert set(after) == {d for d, _, c in brute.components(before) if d == c}
        elif name == "substring_dedup":
            assert {(d, hashlib.sha256(" ".join(brute.SPACE_WORDS.findall(t)).encode()).hexdigest()) for d, t in after.items()} \
                == {(d, s) for d, _, _, s in brute.repeats(before)}
        elif name == "decontamination":
            assert set(after) == set(dict(before)) - {d for d, _ in brute.leaks(before, items)}
        else:
            assert {r.doc_id for r in out.collect()} == set(dict(before))
            last = sorted(tuple(r) for r in out.drop("sequence_id", "offset").collect())
        docs = out
    got = corpus_pipeline.run(spark, sf).drop("sequence_id", "offset").collect()
    assert sorted(tuple(r) for r in got) == last


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("most", [1 << 18, 7])
def test_spread_join_equals_join(spark, how, most, monkeypatch):
    """A key with most rows, null keys, and keys of one side only."""
    from rarefold.llm import common
    from rarefold.llm.common import spread_join
    monkeypatch.setattr(common, "SPREAD_ROWS", most)
    rows = [("hot" if i % 3 else f"k{i % 40}", i) for i in range(600)] + [(None, 1), (None, 2), ("lone", 3)]
    left = spark.createDataFrame(rows, "k string, v long")
    right = spark.createDataFrame([("hot", 10), ("hot", 11), (None, 5), *((f"k{i}", i) for i in range(60))], "k string, x long")
    same = lambda df: sorted((tuple(r) for r in df.select("k", "v", "x").collect()), key=str)
    assert same(spread_join(left, right, ["k"], ["v"], how)) == same(left.join(right, ["k"], how))
    assert spread_join(left.limit(0), right, ["k"], ["v"], how).count() == 0


def test_hot_keys_are_dealt_over_tasks(spark, monkeypatch):
    """No task gets a hot key's rows alone: at most a few times an average partition."""
    from rarefold.llm import common
    from rarefold.llm.common import spread_join
    monkeypatch.setattr(common, "SPREAD_ROWS", 100)
    left = spark.range(8000).selectExpr("if(id % 2 = 0, -1, id) as k", "id as v")
    right = spark.range(-1, 8000).selectExpr("id as k", "id as x")
    bound = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        out = spread_join(left, right, ["k"], ["v"]).withColumn("p", F.spark_partition_id())
        n = [r["count"] for r in out.groupBy("p").count().collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", bound)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(n) == 8000 and max(n) < 3 * 8000 / 8


def test_items_of_one_template_meet_only_their_own_documents(spark):
    """Templated items: pairs grow with the documents that hold an item, not with template x items."""
    template = [f"t{i}" for i in range(10)]
    items = [(k, " ".join(template + [f"own{k}x{j}" for j in range(30)])) for k in range(30)]
    docs = [(i, " ".join(template + [f"free{i}y{j}" for j in range(40)])) for i in range(60)] + [(100 + k, "intro words " + items[k][1]) for k in range(5)]
    d, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for plain in (False, True):
        got = {(r.doc_id, r.item_id) for r in decontam.leaks(d, it, plain=plain).collect()}
        assert got == {(100 + k, k) for k in range(5)}


def test_short_items_end_where_their_words_end(spark):
    d = spark.createDataFrame([(1, "Alpha, beta gamma!"), (2, "alpha beta gamma delta"), (3, " ".join(f"w{i}" for i in range(9)))], "doc_id long, text string")
    items = spark.createDataFrame([(7, "alpha beta gamma"), (8, " ".join(f"w{i}" for i in range(1, 8)))], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.start_word, r.end_word) for r in decontam.leaks(d, items).collect()}
    assert got == {(1, 7): (0, 3), (3, 8): (1, 8)}


def test_long_lists_have_the_same_fingerprint(spark, monkeypatch):
    rnd = random.Random(5)
    rows = spark.createDataFrame([([rnd.getrandbits(63) for _ in range(n)],) for n in (1, 2, 7, 40)], "sh array<long>")
    plain = [r[0] for r in rows.select(decontam.simhash(F.col("sh"))).collect()]
    monkeypatch.setattr(decontam, "LANE_MOST", 1)
    assert [r[0] for r in rows.select(decontam.simhash(F.col("sh"))).collect()] == plain


def test_operators_with_hot_keys_equal_brute_force(spark, monkeypatch):
    """One near copy, passage and payload in most rows, with hot keys from a few rows on."""
    from rarefold.llm import common, jaccard, repeats
    monkeypatch.setattr(common, "SPREAD_ROWS", 3)
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(i, text + f" tail{i % 7}" if i % 5 else f"lone{i} " * 9) for i in range(45)] + [(90 + i, text) for i in range(15)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard.similar_documents(d).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute.components(rows)
    assert sorted(tuple(r) for r in repeats.remove_repeats(d, group_rows=8).drop("spans").collect()) == brute.repeats(rows)
    pages = spark.createDataFrame([(i, "" if i % 3 else f"p{i % 4}") for i in range(40)], "page_id long, payload string").selectExpr(
        "page_id", "cast(payload as binary) as payload", "payload as digest")
    first = {}
    for i in range(40):
        first.setdefault("" if i % 3 else f"p{i % 4}", i)
    assert {(r.page_id, r.refers_to) for r in warc.revisits(pages).collect()} == {
        (i, first["" if i % 3 else f"p{i % 4}"]) for i in range(40)} - {(i, i) for i in range(40)}
    nodes = [(500, 600 + i) for i in range(20)] + [(600 + i, 601 + i) for i in range(20)]
    assert {r.label for r in components(spark.createDataFrame(nodes, "a long, b long")).collect()} == {500}
