"""Leave-one-group-out models from complements, and ordinals of sorted groups."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rarefold.operators import logo, rank, splits


def _rows(spark, n=90, seed=0):
    rng = np.random.default_rng(seed)
    words = ["a", "b", "c", "d", "bad", "worse"]
    rows = []
    for i in range(n):
        y = int(i % 4 == 0)
        rows.append((i, f"g{rng.integers(0, 6)}", " ".join(rng.choice(words[2:] if y else words[:5], rng.integers(0, 9))), y))
    rows += [(n, "only", "a bad bad", 1), (n + 1, "empty", "", 0)]
    return rows, spark.createDataFrame(rows, "id long, grp string, text string, label int")


def _term(w, n):
    import hashlib
    return int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % n


def test_naive_bayes_equals_training_on_all_other_groups(spark):
    rows, df = _rows(spark)
    a = splits.logo_assign(df)
    got = {r.id: (r.fold, r.proba, r.pred) for r in logo.naive_bayes(a, 16).collect()}
    names = sorted({g for _, g, _, _ in rows})
    assert len(got) == len(rows)
    for i, g, text, _ in rows:
        train = [r for r in rows if r[1] != g]
        tf = [{}, {}]
        for _, _, t, y in train:
            for w in t.split():
                tf[y][_term(w, 16)] = tf[y].get(_term(w, 16), 0) + 1
        n = [sum(x.values()) + 16 for x in tf]
        o = math.log(sum(r[3] for r in train) / sum(1 - r[3] for r in train))
        for w in text.split():
            k = _term(w, 16)
            o += math.log((tf[1].get(k, 0) + 1) / n[1]) - math.log((tf[0].get(k, 0) + 1) / n[0])
        assert got[i][0] == names.index(g) and got[i][1] == pytest.approx(1 / (1 + math.exp(-o))) and got[i][2] == int(o > 0)


def test_a_training_side_of_one_class_has_no_odds(spark):
    df = spark.createDataFrame([(1, "x", "a b", 1), (2, "y", "a", 0), (3, "y", "c", 0)], "id long, grp string, text string, label int")
    got = {r.id: (r.proba, r.pred) for r in logo.naive_bayes(splits.logo_assign(df), 8).collect()}
    assert got == {1: (None, None), 2: (None, None), 3: (None, None)}


@pytest.mark.parametrize("bound", [100_000, 0])
def test_groups_are_numbered_in_name_order(spark, bound, monkeypatch):
    monkeypatch.setattr(splits, "BROADCAST_GROUPS", bound)
    names = [f"f{i * 37 % 101}" for i in range(101)]
    df = spark.createDataFrame([(i, names[i % 101]) for i in range(300)], "id long, grp string").repartition(7)
    got = {(r.grp, r.fold) for r in splits.logo_assign(df).collect()}
    assert got == {(g, i) for i, g in enumerate(sorted(names))}
    placed, n = rank.sorted_ordinal(spark.range(1000).select((F.col("id") * 7 % 1009).alias("v")).distinct().repartition(13), "v", "o")
    assert n == 1000 and [r.o for r in placed.orderBy("v").collect()] == list(range(1000))
    assert rank.sorted_ordinal(spark.range(0).select("id"), "id", "o")[1] == 0


@pytest.mark.parametrize("most", [1 << 22, 0])
def test_rows_are_scored_whole_or_joined_alike(spark, most, monkeypatch):
    """Repeated ids count and score together, rows without id have no terms."""
    monkeypatch.setattr(logo, "TASK_WEIGHTS", most)
    rows, _ = _rows(spark, 30)
    df = spark.createDataFrame([*rows, (3, "g1", "bad worse", 1), (4, "g2", "", 0), (None, "g1", "a bad", 1)], "id long, grp string, text string, label int")
    out = logo.naive_bayes(splits.logo_assign(df), 16)
    assert ("Generate" in out._jdf.queryExecution().executedPlan().toString()) == (not most)
    got = sorted((r.id is None, r.id or 0, r.fold, r.label, round(r.proba, 9)) for r in out.collect())
    assert len(got) == 35 and got[-1][0]
    texts, labels, grp = {}, {}, {}
    names = sorted({r.grp for r in df.collect()})
    data = [r for r in df.collect()]
    for r in data:
        if r.id is not None:
            texts.setdefault(r.id, []).extend(r.text.split())
    for r in data:
        s, d, n = 0.0, [0, 0], [16, 16]
        def counts(g):
            tf, d, n = [{}, {}], [0, 0], [16, 16]
            for o in data:
                if o.grp != g:
                    d[o.label] += 1
                    for w in texts.get(o.id, []):
                        k = _term(w, 16)
                        tf[o.label][k] = tf[o.label].get(k, 0) + 1
                        n[o.label] += 1
            return tf, d, n
        _, d, n = counts(r.grp)
        words = 0
        for o in data:
            if r.id is not None and o.id == r.id:
                tf, _, _ = counts(o.grp)
                s += sum(math.log((tf[1].get(_term(w, 16), 0) + 1) / (tf[0].get(_term(w, 16), 0) + 1)) for w in texts[o.id])
                words += len(texts[o.id])
        odds = math.log(d[1] / d[0]) + s + words * math.log(n[0] / n[1])
        want = (r.id is None, r.id or 0, names.index(r.grp), r.label, 1 / (1 + math.exp(-odds)))
        assert any(g[:4] == want[:4] and abs(g[4] - want[4]) < 1e-6 for g in got)
