"""Registered queries: tokens (B8, L6), TF-IDF (F1, F2), triplets."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import tokens as TK
from ..functions.seeded import seeded_matrix
from ..operators import encode, headfit, splits, textfeat, triplets
from . import fixtures as fx
from .catalog import H, U, register

VOCAB = 32768
MAX_LEN = 512
N_FEATURES = 1024
SPLIT = TK.SPLIT_PATTERN

SQL_TOKENS = f"""tok AS (
  SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(text), '{SPLIT}'), lambda t: t <> '') AS toks
  FROM documents),
ids AS (SELECT id, list_transform(toks, lambda t: ('0x' || substr(md5(t), 1, 8))::BIGINT % {VOCAB} + 1) AS ids
        FROM tok)"""


@register("b8_tokenise_fixed", f"""WITH {SQL_TOKENS}
SELECT id, CAST(len(ids) AS INTEGER) AS n_tokens,
       list_transform(range(1, {MAX_LEN} + 1), lambda i: coalesce(ids[i], 0)) AS input_ids,
       list_transform(range(1, {MAX_LEN} + 1), lambda i: CAST(i <= len(ids) AS INTEGER)) AS attention_mask
FROM ids""")
def b8_tokenise_fixed(spark, sf):
    d = fx.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    d = d.select("id", TK.tokens(F.col("text")).alias("_toks"))
    inp, mask = TK.fixed_length(F.col("_toks"), VOCAB, MAX_LEN)
    return d.select("id", F.size("_toks").alias("n_tokens"), inp.alias("input_ids"),
                    mask.alias("attention_mask"))


@register("l6_arrow_token_map", f"""WITH {SQL_TOKENS}
SELECT id, CAST(len(ids) AS INTEGER) AS n_tokens, ids AS token_ids FROM ids""")
def l6_arrow_token_map(spark, sf):
    """The batched map over a dataset, by Spark's own functions (as B8, without the fixed length)."""
    d = fx.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), TK.tokens(F.col("text")).alias("_toks"))
    return d.select("id", F.size("_toks").alias("n_tokens"), F.transform("_toks", lambda t: TK.token_bucket(t, VOCAB)).alias("token_ids"))


SQL_TFIDF = f"""WITH {fx.SQL_TEXT_BIN},
hs AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY {H("'holdout'", '0', 'id')}, id) AS rk,
              count(*) OVER (PARTITION BY label) AS nc FROM text_bin),
tr AS (SELECT id FROM hs WHERE rk > round(0.2 * nc)),
tok AS (SELECT id, unnest(list_filter(regexp_split_to_array(lower(text), '{SPLIT}'), lambda t: t <> '')) AS t FROM text_bin),
tf0 AS (SELECT id, t, count(*) AS c FROM tok GROUP BY id, t),
tf AS (SELECT id, CAST(('0x' || substr(md5(t), 1, 8))::BIGINT % {N_FEATURES} AS INTEGER) AS term, sum(c) AS tf
       FROM tf0 GROUP BY id, term),
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM tr)) / (1 + count(DISTINCT id))) + 1 AS idf
        FROM tf WHERE id IN (SELECT id FROM tr) GROUP BY term),
w AS (SELECT tf.id, tf.term, tf.tf * idf.idf AS w FROM tf JOIN idf ON tf.term = idf.term)
SELECT id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY id)), 6) AS weight FROM w"""


@register("f1_tfidf_train_idf", SQL_TFIDF)
def f1_tfidf_train_idf(spark, sf):
    t = fx.text_bin(spark, sf)
    folds = splits.stratified_holdout(t, repeats=1)
    train = folds.filter(F.col("split") == "train")
    out = textfeat.vectorise(train, t, N_FEATURES)
    return out.select("id", "term", F.round("weight", 6).alias("weight"))


SQL_TFIDF_FOLDS = f"""WITH {fx.SQL_TEXT_BIN},
rep AS (SELECT t.id, t.label, CAST(g.r AS INTEGER) AS repeat FROM text_bin t, range(0, 10) g(r)),
hs AS (SELECT *, row_number() OVER (PARTITION BY repeat, label ORDER BY {H("'holdout'", 'repeat', 'id')}, id) AS rk,
              count(*) OVER (PARTITION BY repeat, label) AS nc FROM rep),
folds AS (SELECT repeat, id, CASE WHEN rk <= round(0.2 * nc) THEN 'test' ELSE 'train' END AS split FROM hs),
tok AS (SELECT id, unnest(list_filter(regexp_split_to_array(lower(text), '{SPLIT}'), lambda t: t <> '')) AS t FROM text_bin),
tf0 AS (SELECT id, t, count(*) AS c FROM tok GROUP BY id, t),
tf AS (SELECT id, CAST(('0x' || substr(md5(t), 1, 8))::BIGINT % {N_FEATURES} AS INTEGER) AS term, sum(c) AS tf
       FROM tf0 GROUP BY id, term),
ntr AS (SELECT repeat, count(*) AS n FROM folds WHERE split = 'train' GROUP BY repeat),
dfq AS (SELECT f.repeat, tf.term, count(*) AS df FROM tf JOIN folds f ON tf.id = f.id
        WHERE f.split = 'train' GROUP BY f.repeat, tf.term),
idf AS (SELECT d.repeat, d.term, ln((1 + n.n) / (1 + d.df)) + 1 AS idf FROM dfq d JOIN ntr n ON d.repeat = n.repeat),
w AS (SELECT f.repeat, f.split, f.id, tf.term, tf.tf * idf.idf AS w
      FROM folds f JOIN tf ON f.id = tf.id JOIN idf ON idf.repeat = f.repeat AND idf.term = tf.term)
SELECT repeat, split, id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY repeat, id)), 6) AS weight FROM w"""


@register("f2_vectorise_folds", SQL_TFIDF_FOLDS)
def f2_vectorise_folds(spark, sf):
    """Every fold of the 10 hold-out repeats; text counted once per document."""
    t = fx.text_bin(spark, sf)
    folds = splits.stratified_holdout(t.select("id", "label"), repeats=10)
    out = textfeat.vectorise_folds(t, folds, N_FEATURES)
    return out.select("repeat", "split", "id", "term", F.round("weight", 6).alias("weight"))


ENCODER_DIM = 64

SQL_ENCODED = f"""WITH {fx.SQL_TEXT_BIN},
tok AS (SELECT id, unnest(list_filter(regexp_split_to_array(lower(text), '{SPLIT}'), lambda t: t <> '')) AS t FROM text_bin),
p AS (SELECT id, CAST(('0x' || substr(md5(t), 1, 8))::BIGINT % {ENCODER_DIM} AS INTEGER) AS pos,
             sum(CASE WHEN ('0x' || substr(md5(t), 9, 1))::BIGINT < 8 THEN 1 ELSE -1 END) AS v FROM tok GROUP BY id, pos),
nz AS (SELECT id, pos, v / nullif(sqrt(sum(v * v) OVER (PARTITION BY id)), 0) AS v FROM p),
enc AS (SELECT t.id, t.label, list(round(coalesce(nz.v, 0.0), 6) ORDER BY g.pos) AS features
        FROM text_bin t, range(0, {ENCODER_DIM}) g(pos) LEFT JOIN nz ON nz.id = t.id AND nz.pos = g.pos GROUP BY t.id, t.label)"""


@register("f1_second_encoder", SQL_ENCODED + "\nSELECT id, features FROM enc")
def f1_second_encoder(spark, sf):
    """Every labelled text by a frozen encoder (signed hashing of words), each distinct text encoded once."""
    out = encode.encode(fx.text_bin(spark, sf).select("id", "text"), encode.SignedWords(ENCODER_DIM))
    return out.select("id", F.transform("features", lambda x: F.round(x, 6)).alias("features"))


@register("f2_second_encoder_folds", SQL_ENCODED + f""",
rep AS (SELECT t.id, t.label, CAST(g.r AS INTEGER) AS repeat FROM text_bin t, range(0, 10) g(r)),
hs AS (SELECT *, row_number() OVER (PARTITION BY repeat, label ORDER BY {H("'holdout'", 'repeat', 'id')}, id) AS rk,
              count(*) OVER (PARTITION BY repeat, label) AS nc FROM rep)
SELECT repeat, CASE WHEN rk <= round(0.2 * nc) THEN 'test' ELSE 'train' END AS split, hs.id, hs.label, features
FROM hs JOIN enc ON hs.id = enc.id""")
def f2_second_encoder_folds(spark, sf):
    """The 10 hold-out folds by the same call as TF-IDF, with the frozen encoder."""
    t = fx.text_bin(spark, sf)
    folds = splits.stratified_holdout(t.select("id", "label"), repeats=10)
    out = encode.vectorise(t.select("id", "text"), folds, encode.SignedWords(ENCODER_DIM))
    return out.withColumn("features", F.transform("features", lambda x: F.round(x, 6)))


SQL_TRIPLETS = f"""WITH {fx.SQL_VEC_BIN},
b AS (SELECT id, label, features,
             (row_number() OVER (ORDER BY {H("'batch'", '0', 'id')}, id) - 1) // 16 AS batch FROM vec_bin),
pr AS (SELECT a.batch, a.id AS aid, a.label = o.label AS same,
              sqrt(list_sum(list_transform(list_zip(a.features, o.features), lambda x: (x[1] - x[2]) * (x[1] - x[2])))) AS d
       FROM b a JOIN b o ON a.batch = o.batch AND a.id <> o.id),
t AS (SELECT p.batch, greatest(p.d - n.d + 20.0, 0.0) AS l
      FROM pr p JOIN pr n ON p.batch = n.batch AND p.aid = n.aid AND p.same AND NOT n.same),
pb AS (SELECT CAST(batch AS BIGINT) AS batch, count(*) AS n_triplets, count_if(l > 1e-16)::BIGINT AS n_active,
              sum(CASE WHEN l > 1e-16 THEN l ELSE 0.0 END) AS loss_sum FROM t GROUP BY batch)"""


@register("f3_batch_triplets", SQL_TRIPLETS + """
SELECT batch, n_triplets, n_active, round(loss_sum, 6) AS loss_sum FROM pb""")
def f3_batch_triplets(spark, sf):
    b = triplets.batches(fx.vec_bin(spark, sf))
    pb = triplets.triplet_losses(b)
    return pb.select("batch", "n_triplets", "n_active", F.round("loss_sum", 6).alias("loss_sum"))


@register("f4_triplet_loss", SQL_TRIPLETS + """
SELECT round(sum(loss_sum) / sum(n_active), 6) AS loss, sum(n_active)::BIGINT AS n_active,
       sum(n_triplets)::BIGINT AS n_triplets FROM pb""")
def f4_triplet_loss(spark, sf):
    b = triplets.batches(fx.vec_bin(spark, sf))
    out = triplets.triplet_loss(triplets.triplet_losses(b))
    return out.select(F.round("loss", 6).alias("loss"), "n_active", "n_triplets")


HEAD_DIM = 64
HEAD_SCALE = (6.0 / (HEAD_DIM + HEAD_DIM)) ** 0.5 * 2.0  # uniform +-sqrt(6/(in+out))


@register("f5_projection_forward", f"""WITH {fx.SQL_VEC_BIN},
W AS (SELECT r, c, ({U("'head-w'", 'r', 'c')} - 0.5) * {HEAD_SCALE!r} AS w
      FROM range(0, {HEAD_DIM}) a(r), range(0, {HEAD_DIM}) b(c)),
B AS (SELECT r, ({U("'head-b'", 'r', '0')} - 0.5) * {HEAD_SCALE!r} AS b FROM range(0, {HEAD_DIM}) a(r)),
x AS (SELECT id, unnest(features) AS v, unnest(generate_series(0, len(features) - 1)) AS c FROM vec_bin),
z AS (SELECT x.id, W.r, sum(W.w * x.v) AS s FROM x JOIN W ON x.c = W.c GROUP BY x.id, W.r)
SELECT id, list(round(tanh(s + B.b), 6) ORDER BY z.r) AS z FROM z JOIN B ON z.r = B.r GROUP BY id""")
def f5_projection_forward(spark, sf):
    v = fx.vec_bin(spark, sf)
    W = seeded_matrix(fx.SEED, "head-w", HEAD_DIM, HEAD_DIM, HEAD_SCALE)
    b = [row[0] for row in seeded_matrix(fx.SEED, "head-b", HEAD_DIM, 1, HEAD_SCALE)]
    z = triplets.projection_head(F.col("features"), W, b)
    return v.select("id", F.transform(z, lambda t: F.round(t, 6)).alias("z"))


SQL_HEAD_INIT = f"""WITH {fx.SQL_VEC_BIN},
W AS (SELECT r, c, ({U("'head-w'", 'r', 'c')} - 0.5) * {HEAD_SCALE!r} AS w
      FROM range(0, {HEAD_DIM}) a(r), range(0, {HEAD_DIM}) b(c)),
B AS (SELECT r, ({U("'head-b'", 'r', '0')} - 0.5) * {HEAD_SCALE!r} AS b FROM range(0, {HEAD_DIM}) a(r)),
x AS (SELECT id, unnest(features) AS v, unnest(generate_series(0, len(features) - 1)) AS c FROM vec_bin),
s AS (SELECT x.id, W.r, sum(W.w * x.v) AS s FROM x JOIN W ON x.c = W.c GROUP BY x.id, W.r),
zv AS (SELECT s.id, list(tanh(s.s + B.b) ORDER BY s.r) AS z FROM s JOIN B ON s.r = B.r GROUP BY s.id),
bt AS (SELECT v.id, v.label, zv.z,
              (row_number() OVER (ORDER BY {H("'batch'", '0', 'v.id')}, v.id) - 1) // 16 AS batch
       FROM vec_bin v JOIN zv ON v.id = zv.id),
pr AS (SELECT a.batch, a.id AS aid, a.label = o.label AS same,
              sqrt(list_sum(list_transform(list_zip(a.z, o.z), lambda q: (q[1] - q[2]) * (q[1] - q[2])))) AS d
       FROM bt a JOIN bt o ON a.batch = o.batch AND a.id <> o.id),
t AS (SELECT p.batch, p.d - n.d + 20.0 AS l
      FROM pr p JOIN pr n ON p.batch = n.batch AND p.aid = n.aid AND p.same AND NOT n.same),
nb AS (SELECT DISTINCT batch FROM bt)
SELECT CAST(nb.batch AS BIGINT) AS batch, coalesce(count_if(t.l > 1e-16), 0)::BIGINT AS n_active,
       round(sum(CASE WHEN t.l > 1e-16 THEN t.l END) / nullif(count_if(t.l > 1e-16), 0), 6) AS loss
FROM nb LEFT JOIN t ON nb.batch = t.batch GROUP BY nb.batch"""


@register("f5_head_loss_init", SQL_HEAD_INIT)
def f5_head_loss_init(spark, sf):
    """F5 fit, first step: batch-all mean loss of every epoch-0 batch through
    the seeded head (the values the fit starts from)."""
    v = fx.vec_bin(spark, sf)
    W, b = headfit.init_head(HEAD_DIM, HEAD_DIM, fx.SEED)
    g = headfit.grouped_epoch(v, 0, fx.SEED)
    out = headfit.batch_losses(g, W, b)
    return out.select("batch", "n_active", F.round("loss", 6).alias("loss"))


@register("f5_projection_fit", None)
def f5_projection_fit(spark, sf):
    """F5 fit: 5 epochs of batch-all triplet training of the head on the train
    side of fold 0, one step per batch; every row through the trained head."""
    v = fx.vec_bin(spark, sf)
    folds = splits.stratified_holdout(v.select("id", "label"), repeats=1).filter(F.col("split") == "train")
    model = headfit.fit(v.join(folds.select("id"), on="id", how="left_semi"), epochs=5, seed=fx.SEED)
    z = headfit.transform(v, model)
    return z.select("id", "label", F.transform("z", lambda t: F.round(t, 6)).alias("z"))


# ---- L1-L5: text classifier variants, over all folds ------------------------------

from ..operators import textclf  # noqa: E402

EPOCHS = 10


def text_folds(spark, sf, variant: str, folds: list[int] | None = None) -> textclf.TextFolds:
    """The 10 hold-out repeats (or some of them) of the labelled texts as shards."""
    t = fx.text_bin(spark, sf)
    sides = splits.stratified_holdout(t.select("id", "label"), repeats=10)
    if folds is not None:
        sides = sides.where(F.col("repeat").isin(folds))
    return textclf.text_folds(t.select("id", "text"), sides, N_FEATURES, EPOCHS, textclf.VARIANTS[variant][0])


def _histories(spark, folds: textclf.TextFolds, models: list[textclf.TextModel]):
    """Per-epoch evaluation losses: a row per fold and epoch."""
    rows = [(r, h["epoch"], h["eval_loss"]) for r, m in zip(folds.repeats, models) for h in m.history]
    kinds = {"repeat": pa.int32(), "epoch": pa.int32(), "eval_loss": pa.float64()}
    return spark.createDataFrame(pa.table({c: pa.array([r[i] for r in rows], k) for i, (c, k) in enumerate(kinds.items())}))


def _variant(variant):
    def run(spark, sf):
        folds = text_folds(spark, sf, variant)
        models = folds.fit(variant, EPOCHS)
        best = textclf.select_best(_histories(spark, folds, models), ("repeat",))
        out = folds.predict(models).join(F.broadcast(best.select("repeat", "best_epoch")), "repeat")   # a row per fold
        return out.select("repeat", "id", "label", F.round("proba", 6).alias("proba"), "pred", "best_epoch")
    run.__doc__ = f"Text classifier, variant '{variant}': all 10 folds, 10 epochs of batch steps, best epoch kept."
    return run


register("l1_text_plain", None)(_variant("plain"))
register("l2_text_balanced_sampling", None)(_variant("bs"))
register("l3_text_weighted_loss", None)(_variant("wce"))
register("l4_text_balanced_weighted", None)(_variant("bs_wce"))


@register("l5_best_epoch", None)
def l5_best_epoch(spark, sf):
    """Per fold, the epoch that the weighted-loss variant keeps (lowest
    evaluation loss)."""
    folds = text_folds(spark, sf, "wce")
    return textclf.select_best(_histories(spark, folds, folds.fit("wce", EPOCHS)), ("repeat",))


STEP_LR = 0.5

SQL_GRADIENT = SQL_TFIDF_FOLDS.replace("SELECT repeat, split, id, term, round(w", "SELECT repeat, split, id, term, (w") \
    .replace(", 6) AS weight FROM w", ") AS weight FROM w")


@register("l3_gradient_step", f"""WITH v AS ({SQL_GRADIENT}),
{SQL_TFIDF_FOLDS[len("WITH "):SQL_TFIDF_FOLDS.index("tok AS (")]}ranked AS (SELECT repeat, id, label,
  row_number() OVER (PARTITION BY repeat, label ORDER BY {H("'eval'", 'repeat', 'id')}, id) AS rk,
  count(*) OVER (PARTITION BY repeat, label) AS nc FROM (SELECT f.repeat, f.id, h.label FROM folds f
    JOIN (SELECT DISTINCT id, label FROM text_bin) h ON f.id = h.id WHERE f.split = 'train')),
fit AS (SELECT repeat, id, label FROM ranked WHERE rk > round(0.1 * nc)),
cn AS (SELECT repeat, label, 1.0 / count(*) AS iw FROM fit GROUP BY repeat, label),
cw AS (SELECT repeat, label, iw / sum(iw) OVER (PARTITION BY repeat) AS w FROM cn),
g AS (SELECT fit.repeat, fit.id, fit.label, cw.w / sum(cw.w) OVER (PARTITION BY fit.repeat) AS w
      FROM fit JOIN cw ON fit.repeat = cw.repeat AND fit.label = cw.label),
x AS (SELECT g.repeat, v.term, g.label, g.w * v.weight AS wx FROM g JOIN v ON g.repeat = v.repeat AND g.id = v.id
      UNION ALL SELECT repeat, {N_FEATURES} AS term, label, w AS wx FROM g)
SELECT repeat, c.cls, term, round(-{STEP_LR} * sum(wx * (0.5 - CASE WHEN label = c.cls THEN 1 ELSE 0 END)), 9) AS weight
FROM x, (SELECT unnest([0, 1]) AS cls) c GROUP BY repeat, c.cls, term HAVING round(sum(abs(wx)), 12) > 0""")
def l3_gradient_step(spark, sf):
    """The weighted-loss variant's weights after one step from zero over all fit
    rows of each fold (term {N_FEATURES}: the bias)."""
    folds = text_folds(spark, sf, "wce")
    # the model after the step is the one that the only epoch leaves
    models = folds.fit("wce", 1, lr=STEP_LR, batch_size=None)
    rows = [(r, c, t, round(float(m.W[c, t]), 9)) for r, m in zip(folds.repeats, models)
            for c in range(2) for t in m.W[c].nonzero()[0].tolist()]     # the models: folds x classes x terms
    return spark.createDataFrame(rows, "repeat int, cls int, term int, weight double")
