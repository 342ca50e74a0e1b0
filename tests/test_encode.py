"""Encoders through one call, and the store of vectors by content."""

from dataclasses import dataclass

import numpy as np
import pytest
from pyspark.sql import functions as F

from rarefold.operators import encode, splits, textfeat
from rarefold.session import scratch_path

TEXTS = [(0, "alpha beta beta"), (1, "Alpha  BETA gamma"), (2, None), (3, ""), (4, "alpha beta beta"), (5, "delta. delta, gamma"),
         (6, "é ñ ü"), (7, "..."), (8, "gamma"), (9, "delta x")]


def _lengths(path):
    @dataclass(frozen=True)
    class Lengths(encode.Encoder):
        """Counts what it is given: a vector of (characters, 1)."""
        path: str
        name: str = "lengths"
        dim: int = 2

        def open(self):
            def run(texts):
                with open(self.path, "a") as f:
                    f.writelines(repr(t) + "\n" for t in texts)
                return np.array([[len(t), 1.0] for t in texts]).reshape(-1, 2)
            return run
    return Lengths(path)


def _texts(spark):
    return spark.createDataFrame(TEXTS, "id long, text string")


def test_each_distinct_text_is_encoded_once(spark, tmp_path):
    log, store = tmp_path / "seen", scratch_path(spark, "store")
    enc = _lengths(str(log))
    for _ in range(2):
        got = {r.id: r.features for r in encode.encode(_texts(spark), enc, store).collect()}
        assert got == {i: [float(len(t or "")), 1.0] for i, t in TEXTS}
    more = spark.createDataFrame([(1, "gamma"), (2, "new text"), (2, "new text")], "id long, text string")
    assert sorted(r.features[0] for r in encode.encode(more, enc, store).collect()) == [5.0, 8.0, 8.0]
    seen = log.read_text().splitlines()
    assert sorted(seen) == sorted({repr(t or "") for _, t in TEXTS} | {repr("new text")})     # and never twice
    assert encode.read_store(spark, store, encode.SignedWords(8)).count() == 0
    assert encode.encode(_texts(spark).limit(0), enc).count() == 0


def test_a_worker_opens_an_encoder_once():
    opened = []

    class Own(encode.Encoder):
        name, dim = "own-test", 1

        def open(self):
            opened.append(1)
            return lambda texts: np.zeros((len(texts), 1))

    e = Own()
    assert encode.worker_encoder(e) is encode.worker_encoder(e) and len(opened) == 1


def test_wrong_shapes_stop_the_job(spark):
    class Short(encode.Encoder):
        name, dim = "short", 3

        def open(self):
            return lambda texts: np.zeros((len(texts), 2))

    with pytest.raises(Exception, match="short"):
        encode.encode(_texts(spark), Short()).collect()


@pytest.mark.parametrize("encoder", [encode.Tfidf(32), encode.SignedWords(32)])
def test_one_call_for_every_encoder(spark, encoder):
    rows = spark.createDataFrame([(i, t, int(i % 3 == 0)) for i, t in TEXTS], "id long, text string, label int")
    folds = splits.stratified_holdout(rows.select("id", "label"), repeats=3)
    got = {(r.repeat, r.split, r.id, r.label): np.array(r.features) for r in
           encode.vectorise(rows.select("id", "text"), folds, encoder).collect()}
    assert set(got) == {(r.repeat, r.split, r.id, r.label) for r in folds.collect()}
    if isinstance(encoder, encode.Tfidf):
        for k in range(3):
            own = folds.where(F.col("repeat") == k)
            one = textfeat.to_dense(textfeat.vectorise(own.where("split = 'train'"), rows.where("text is not null"), 32), 32)
            want = {r.id: np.array(r.features) for r in one.collect()}
            for (r, _, i, _), v in got.items():
                if r == k:
                    assert np.allclose(v, want.get(i, np.zeros(32)))
    else:
        enc = encoder.open()
        for (_, _, i, _), v in got.items():
            assert np.allclose(v, enc([dict(TEXTS)[i] or ""])[0])
