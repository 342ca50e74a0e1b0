"""Registered queries: scans, scalar functions, splits, resampling, class stats."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.seeded import seeded_matrix
from ..operators import resample, splits, weights
from ..sources import files
from . import fixtures as fx
from .catalog import H, U, register

STRIP = S.STRIP_PATTERN
LB = r"\r\n|\r|\n"

# ---- A1 / B1: lines ---------------------------------------------------------

SQL_LINES = f"""WITH s AS (SELECT doc_id, regexp_split_to_array(text, '{LB}') AS parts FROM documents),
u AS (SELECT doc_id, parts, unnest(generate_series(1, len(parts))) AS i FROM s)
SELECT doc_id, CAST(i - 1 AS BIGINT) AS line_no, regexp_replace(parts[i], '{STRIP}', '', 'g') AS line
FROM u WHERE NOT (i = len(parts) AND parts[i] = '')"""


@register("b1_strip_lines", SQL_LINES)
def b1_strip_lines(spark, sf):
    d = fx.table(spark, sf, "documents").select(
        F.col("doc_id").alias("file"), F.col("text").alias("value"))
    return files.lines(d).select(F.col("file").alias("doc_id"), "line_no",
                                 S.strip(F.col("line")).alias("line"))


SQL_PAIRED = f"""WITH {fx.SQL_TEXT_BIN},
s AS (SELECT id, label, regexp_split_to_array(text, '{LB}') AS parts FROM text_bin),
u AS (SELECT id, label, parts, unnest(generate_series(1, len(parts))) AS i FROM s)
SELECT 'doc' || id AS file, CAST(i - 1 AS BIGINT) AS line_no,
       regexp_replace(parts[i], '{STRIP}', '', 'g') AS text, label
FROM u WHERE NOT (i = len(parts) AND parts[i] = '')"""


@register("a1_paired_lines", SQL_PAIRED)
def a1_paired_lines(spark, sf):
    """Sentence texts are the documents; the label text of a document carries
    its toxic flag once per line, padded with blanks that B1/B2 strip."""
    t = fx.text_bin(spark, sf)
    sent = t.select(F.concat(F.lit("doc"), F.col("id").cast("string")).alias("file"),
                    F.col("text").alias("value"))
    n_lines = F.size(F.split(F.col("text"), S.LINE_BREAK, -1))
    lab = t.select(
        F.concat(F.lit("doc"), F.col("id").cast("string")).alias("file"),
        F.array_join(F.array_repeat(F.concat(F.lit(" "), F.col("label").cast("string"), F.lit("\t")),
                                    n_lines), "\n").alias("value"))
    # the sentence side drops an empty last line; so does the label side
    # only when the text ends with a break: align by trimming the label text
    ends = F.col("text").rlike("(\r\n|\r|\n)$")
    lab = lab.join(t.select(F.concat(F.lit("doc"), F.col("id").cast("string")).alias("file"),
                            ends.alias("_e")), on="file").select(
        "file", F.when(F.col("_e"), F.regexp_replace("value", "\n[^\n]*$", "\n"))
        .otherwise(F.col("value")).alias("value"))
    return files.pair_lines(sent, lab)


# ---- B2-B11 -------------------------------------------------------------------

@register("b2_binarise", f"""SELECT vec_id AS id,
  CASE WHEN regexp_replace(' ' || CAST(label AS VARCHAR) || chr(10), '{STRIP}', '', 'g') = '3' THEN 1 ELSE 0 END AS label
FROM embeddings""")
def b2_binarise(spark, sf):
    e = fx.table(spark, sf, "embeddings")
    raw = F.concat(F.lit(" "), F.col("label").cast("string"), F.lit("\n"))
    return e.select(F.col("vec_id").alias("id"), S.binarise(raw, "3").alias("label"))


@register("b3_basename", """SELECT doc_id,
  string_split('/corpus/' || lang || '/' || source || '/' || CAST(doc_id AS VARCHAR) || '.txt', '/')[-1] AS base
FROM documents""")
def b3_basename(spark, sf):
    d = fx.table(spark, sf, "documents")
    path = F.concat(F.lit("/corpus/"), "lang", F.lit("/"), "source", F.lit("/"),
                    F.col("doc_id").cast("string"), F.lit(".txt"))
    return d.select("doc_id", S.basename(path).alias("base"))


SQL_MODELS = """m AS (SELECT DISTINCT CASE WHEN lang = 'en' THEN source || '-base.v1'
                              ELSE lang || '/' || source || '-x.y-z' END AS model FROM documents)"""


@register("b4_run_name", f"""WITH {SQL_MODELS},
s AS (SELECT m.model, sfx.suffix FROM m, (VALUES (''), ('_bs'), ('_wce'), ('_bs_wce')) sfx(suffix))
SELECT model, suffix,
  replace(replace(CASE WHEN strpos(model, '/') > 0 THEN substr(model, strpos(model, '/') + 1) ELSE model END,
          '-', '_'), '.', '') || suffix AS run
FROM s""")
def b4_run_name(spark, sf):
    d = fx.table(spark, sf, "documents")
    model = F.when(F.col("lang") == "en", F.concat("source", F.lit("-base.v1"))).otherwise(
        F.concat("lang", F.lit("/"), "source", F.lit("-x.y-z")))
    m = d.select(model.alias("model")).distinct()
    m = m.withColumn("suffix", F.explode(F.array(*[F.lit(x) for x in S.RUN_SUFFIXES])))
    return m.select("model", "suffix",
                    F.concat(S.run_name(F.col("model")), F.col("suffix")).alias("run"))


@register("b5_cast", f"""WITH {fx.SQL_VEC_BIN}
SELECT id, features, CAST(label AS DOUBLE) AS label FROM vec_bin""")
def b5_cast(spark, sf):
    v = fx.vec_bin(spark, sf)
    return v.select("id", "features", F.col("label").cast("double").alias("label"))


@register("b6_argmax", f"""WITH {fx.SQL_LOGITS}
SELECT id, CAST(list_position(logits, list_max(logits)) - 1 AS INTEGER) AS pred FROM logits""")
def b6_argmax(spark, sf):
    return fx.logits(spark, sf).select("id", S.argmax(F.col("logits")).alias("pred"))


@register("b7_positive_proba", f"""WITH {fx.SQL_SCORED}
SELECT id, [1.0 - proba, proba][2] AS p1 FROM scored""")
def b7_positive_proba(spark, sf):
    s = fx.scored(spark, sf)
    return s.select("id", S.positive_proba(F.array(1.0 - F.col("proba"), F.col("proba"))).alias("p1"))


@register("b9_correct_mask", f"""WITH {fx.SQL_SCORED}
SELECT id, label, pred, label = pred AS correct FROM scored""")
def b9_correct_mask(spark, sf):
    s = fx.scored(spark, sf)
    return s.select("id", "label", "pred", (F.col("label") == F.col("pred")).alias("correct"))


@register("b10_hstack", f"""WITH {fx.SQL_LOGITS}
SELECT id, list_concat(features, logits) AS stacked FROM logits""")
def b10_hstack(spark, sf):
    lg = fx.logits(spark, sf)
    return lg.select("id", S.hstack(F.col("features"), F.col("logits")).alias("stacked"))


MAP_ROWS, MAP_DIM = 8, 64


@register("b11_linear_map", f"""WITH {fx.SQL_VEC_BIN},
L AS (SELECT r, c, {U("'map'", 'r', 'c')} - 0.5 AS w FROM range(0, {MAP_ROWS}) a(r), range(0, {MAP_DIM}) b(c)),
x AS (SELECT id, unnest(features) AS v, unnest(generate_series(0, len(features) - 1)) AS c FROM vec_bin),
z AS (SELECT x.id, L.r, sum(L.w * x.v) AS s FROM x JOIN L ON x.c = L.c GROUP BY x.id, L.r)
SELECT id, list(round(s, 6) ORDER BY r) AS z FROM z GROUP BY id""")
def b11_linear_map(spark, sf):
    v = fx.vec_bin(spark, sf)
    L = seeded_matrix(fx.SEED, "map", MAP_ROWS, MAP_DIM)
    z = S.linear_map(L, F.col("features"))
    return v.select("id", F.transform(z, lambda t: F.round(t, 6)).alias("z"))


# ---- C1-C5 --------------------------------------------------------------------

@register("c1_logo_fold_stats", f"""WITH {fx.SQL_TEXT_BIN},
g AS (SELECT grp, CAST(row_number() OVER (ORDER BY grp) - 1 AS INTEGER) AS fold FROM (SELECT DISTINCT grp FROM text_bin)),
x AS (SELECT g.fold, g.grp, t.label, t.grp = g.grp AS is_test FROM text_bin t, g)
SELECT fold, grp, count_if(NOT is_test)::BIGINT AS n_train, count_if(is_test)::BIGINT AS n_test,
       sum(CASE WHEN NOT is_test THEN label ELSE 0 END)::BIGINT AS pos_train,
       sum(CASE WHEN is_test THEN label ELSE 0 END)::BIGINT AS pos_test
FROM x GROUP BY fold, grp""")
def c1_logo_fold_stats(spark, sf):
    t = fx.text_bin(spark, sf).drop("text")
    return splits.logo_fold_stats(splits.logo_assign(t))


@register("c1_logo_fold_rows", f"""WITH {fx.SQL_TEXT_BIN},
g AS (SELECT grp, row_number() OVER (ORDER BY grp) - 1 AS fold FROM (SELECT DISTINCT grp FROM text_bin))
SELECT id, t.grp, label, CASE WHEN fold = 3 THEN 'test' ELSE 'train' END AS split FROM text_bin t JOIN g ON t.grp = g.grp""")
def c1_logo_fold_rows(spark, sf):
    """Every row of fold 3 with its side."""
    t = fx.text_bin(spark, sf).drop("text")
    return splits.logo_fold(splits.logo_assign(t), 3).select("id", "grp", "label", "split")


@register("c2_stratified_holdout", f"""WITH {fx.SQL_TEXT_BIN},
rep AS (SELECT t.id, t.label, CAST(g.r AS INTEGER) AS repeat FROM text_bin t, range(0, 10) g(r)),
hs AS (SELECT *, row_number() OVER (PARTITION BY repeat, label ORDER BY {H("'holdout'", 'repeat', 'id')}, id) AS rk,
              count(*) OVER (PARTITION BY repeat, label) AS nc FROM rep)
SELECT repeat, id, label, CASE WHEN rk <= round(0.2 * nc) THEN 'test' ELSE 'train' END AS split FROM hs""")
def c2_stratified_holdout(spark, sf):
    t = fx.text_bin(spark, sf).select("id", "label")
    return splits.stratified_holdout(t, repeats=10).select("repeat", "id", "label", "split")


@register("c3_class_halves", f"""WITH {fx.SQL_VEC_BIN},
k AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY {H("'halves'", 'id')}, id) AS rk,
             count(*) OVER (PARTITION BY label) AS nc FROM vec_bin),
c AS (SELECT label, count(*) AS c FROM vec_bin GROUP BY label),
r AS (SELECT label, CASE WHEN row_number() OVER (ORDER BY c DESC, label) = 1 THEN 'majority'
                         WHEN row_number() OVER (ORDER BY c, label) = 1 THEN 'minority' ELSE 'other' END AS role FROM c)
SELECT k.id, k.label, CASE WHEN rk <= ceil(nc / 2) THEN 'test' ELSE 'train' END AS split, r.role
FROM k JOIN r ON k.label = r.label""")
def c3_class_halves(spark, sf):
    v = fx.vec_bin(spark, sf).select("id", "label")
    return splits.class_halves(v).select("id", "label", "split", "role")


@register("c4_random_halves", f"""WITH {fx.SQL_VEC_BIN},
k AS (SELECT id, label, row_number() OVER (ORDER BY {H("'c4'", 'id')}, id) AS rk, count(*) OVER () AS n FROM vec_bin)
SELECT id, label, CASE WHEN rk <= floor(n / 2) THEN 'train' ELSE 'valid' END AS split FROM k""")
def c4_random_halves(spark, sf):
    v = fx.vec_bin(spark, sf).select("id", "label")
    return splits.random_halves(v).select("id", "label", "split")


@register("c5_oof_folds", f"""WITH {fx.SQL_VEC_BIN},
k AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY {H("'oof'", 'id')}, id) AS rk FROM vec_bin)
SELECT id, label, CAST((rk - 1) % 5 AS INTEGER) AS oof FROM k""")
def c5_oof_folds(spark, sf):
    v = fx.vec_bin(spark, sf).select("id", "label")
    return splits.oof_folds(v).select("id", "label", "oof")


# ---- R1-R8 --------------------------------------------------------------------

@register("r1_undersample", f"""WITH {fx.SQL_VEC_BIN},
k AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY {H("'rus'", 'id')}, id) AS rk,
             count(*) OVER (PARTITION BY label) AS nc FROM vec_bin),
m AS (SELECT *, min(nc) OVER () AS nmin FROM k)
SELECT id, label FROM m WHERE rk <= nmin""")
def r1_undersample(spark, sf):
    v = fx.vec_bin(spark, sf).select("id", "label")
    return resample.undersample(v).select("id", "label")


@register("r2_balanced_bootstrap", f"""WITH {fx.SQL_VEC_BIN},
idx AS (SELECT id, label, row_number() OVER (ORDER BY {H("'boot-idx'", 'id')}, id) - 1 AS idx, count(*) OVER () AS n FROM vec_bin),
slots AS (SELECT CAST(b.bag AS INTEGER) AS bag, i.id AS slot,
                 CAST(floor({U("'boot'", 'b.bag', 'i.id')} * i.n) AS BIGINT) AS idx FROM idx i, range(0, 10) b(bag)),
boot AS (SELECT s.bag, s.slot, i.id, i.label FROM slots s JOIN idx i ON s.idx = i.idx),
cnt AS (SELECT bag, label, count(*) AS c FROM boot GROUP BY bag, label),
cr AS (SELECT *, row_number() OVER (PARTITION BY bag ORDER BY c, label) = 1 AS is_min FROM cnt),
keep AS (SELECT b.bag, 'keep' AS src, b.slot, b.id, b.label FROM boot b JOIN cr ON b.bag = cr.bag AND b.label = cr.label WHERE cr.is_min),
maj AS (SELECT b.*, row_number() OVER (PARTITION BY b.bag, b.label ORDER BY {H("'boot-maj'", 'b.bag', 'b.slot')}, b.slot) - 1 AS idx
        FROM boot b JOIN cr ON b.bag = cr.bag AND b.label = cr.label WHERE NOT cr.is_min),
draws AS (SELECT k.bag, o.label, k.slot AS drv,
                 CAST(floor({U("'boot-draw'", 'k.bag', 'o.label', 'k.slot')} * o.c) AS BIGINT) AS idx
          FROM keep k JOIN cr o ON k.bag = o.bag AND NOT o.is_min)
SELECT bag, src, slot, id, label FROM keep
UNION ALL
SELECT d.bag, 'draw:' || CAST(d.label AS VARCHAR) AS src, d.drv AS slot, m.id, m.label
FROM draws d JOIN maj m ON d.bag = m.bag AND d.label = m.label AND d.idx = m.idx""")
def r2_balanced_bootstrap(spark, sf):
    v = fx.vec_bin(spark, sf).select("id", "label")
    return resample.balanced_bootstrap(v, 10).select("bag", "src", "slot", "id", "label")


@register("r3_easy_bags", f"""WITH {fx.SQL_VEC_BIN},
r AS (SELECT v.id, v.label, CAST(b.bag AS INTEGER) AS bag FROM vec_bin v, range(0, 10) b(bag)),
k AS (SELECT *, row_number() OVER (PARTITION BY bag, label ORDER BY {H("'bag'", 'bag', 'id')}, id) AS rk,
             count(*) OVER (PARTITION BY bag, label) AS nc FROM r),
m AS (SELECT *, min(nc) OVER (PARTITION BY bag) AS nmin FROM k)
SELECT bag, id, label FROM m WHERE rk <= nmin""")
def r3_easy_bags(spark, sf):
    v = fx.vec_bin(spark, sf).select("id", "label")
    return resample.easy_bags(v, 10).select("bag", "id", "label")


@register("r4_rus_rounds", f"""WITH {fx.SQL_VEC_BIN},
r AS (SELECT v.id, v.label, CAST(b.rnd AS INTEGER) AS round FROM vec_bin v, range(0, 50) b(rnd)),
k AS (SELECT *, row_number() OVER (PARTITION BY round, label ORDER BY {H("'rusboost'", 'round', 'id')}, id) AS rk,
             count(*) OVER (PARTITION BY round, label) AS nc FROM r),
m AS (SELECT *, min(nc) OVER (PARTITION BY round) AS nmin FROM k)
SELECT round, id, label FROM m WHERE rk <= nmin""")
def r4_rus_rounds(spark, sf):
    v = fx.vec_bin(spark, sf).select("id", "label")
    return resample.rus_rounds(v, 50).select("round", "id", "label")


@register("r5_weighted_draw", f"""WITH {fx.SQL_TEXT_BIN},
d AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY {H("'wd-idx'", 'id')}, id) - 1 AS idx,
             count(*) OVER (PARTITION BY label) AS nc FROM text_bin),
cl AS (SELECT label, nc, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS ord FROM (SELECT DISTINCT label, nc FROM d)),
k AS (SELECT count(*) AS k FROM cl),
own AS (SELECT d.id AS draw, CAST(floor({U("'wd-class'", '0', 'd.id')} * k.k) AS INTEGER) AS ord,
               {U("'wd-row'", '0', 'd.id')} AS u2 FROM d, k),
o2 AS (SELECT own.draw, cl.label, CAST(floor(own.u2 * cl.nc) AS BIGINT) AS idx FROM own JOIN cl ON own.ord = cl.ord)
SELECT o2.draw, d.id, d.label FROM o2 JOIN d ON o2.label = d.label AND o2.idx = d.idx""")
def r5_weighted_draw(spark, sf):
    t = fx.text_bin(spark, sf).select("id", "label")
    return resample.weighted_draw(t, epoch=0).select("draw", "id", "label")


@register("r6_r7_sample_complement", f"""WITH {fx.SQL_VEC_BIN},
k AS (SELECT id, label, row_number() OVER (ORDER BY {H("'r6'", 'id')}, id) AS rk, count(*) OVER () AS n FROM vec_bin)
SELECT id, label, rk <= floor(n / 4) AS in_sample FROM k""")
def r6_r7_sample_complement(spark, sf):
    v = fx.vec_bin(spark, sf).select("id", "label")
    k = v.select(F.floor(F.count(F.lit(1)) / 4)).scalar()
    return resample.sample_k(v, k).select("id", "label", "in_sample")


@register("r8_union_all", f"""WITH {fx.SQL_VEC_BIN},
k AS (SELECT id, label, row_number() OVER (ORDER BY {H("'c4'", 'id')}, id) AS rk, count(*) OVER () AS n FROM vec_bin)
SELECT id, label, 'positive' AS part FROM vec_bin WHERE label = 1
UNION ALL
SELECT id, label, 'train_half' AS part FROM k WHERE rk <= floor(n / 2)""")
def r8_union_all(spark, sf):
    v = fx.vec_bin(spark, sf).select("id", "label")
    pos = v.filter(F.col("label") == 1).withColumn("part", F.lit("positive"))
    half = (splits.random_halves(v).filter(F.col("split") == "train").drop("split")
            .withColumn("part", F.lit("train_half")))
    return pos.unionByName(half)


# ---- E1-E5 --------------------------------------------------------------------

@register("e1_top2_classes", f"""WITH {fx.SQL_TEXT_BIN}
SELECT label, count(*)::BIGINT AS n FROM text_bin GROUP BY label ORDER BY n DESC, label LIMIT 2""")
def e1_top2_classes(spark, sf):
    return weights.top_classes(fx.text_bin(spark, sf).select("label"), k=2)


@register("e2_e3_class_weights", f"""WITH {fx.SQL_TEXT_BIN},
c AS (SELECT label, count(*)::BIGINT AS n, 1.0 / count(*) AS weight FROM text_bin GROUP BY label)
SELECT label, n, weight, round(weight / sum(weight) OVER (), 9) AS weight_norm FROM c""")
def e2_e3_class_weights(spark, sf):
    w = weights.class_weights(fx.text_bin(spark, sf).select("label"))
    return w.withColumn("weight_norm", F.round("weight_norm", 9))


@register("e4_weighted_ce", f"""WITH {fx.SQL_LOGITS},
cw AS (SELECT label, 1.0 / count(*) AS w FROM vec_bin GROUP BY label),
cwn AS (SELECT label, w / sum(w) OVER () AS wn FROM cw),
r AS (SELECT l.label, c.wn, list_max(l.logits) AS m, l.logits FROM logits l JOIN cwn c ON l.label = c.label),
r2 AS (SELECT wn, -(logits[label + 1] - (m + ln(list_sum(list_transform(logits, lambda v: exp(v - m)))))) AS nll FROM r)
SELECT round(sum(wn * nll) / sum(wn), 6) AS loss, round(avg(nll), 6) AS loss_unweighted FROM r2""")
def e4_weighted_ce(spark, sf):
    lg = fx.logits(spark, sf)
    w = weights.class_weights(lg.select("label"))
    out = weights.weighted_ce(lg, w)
    return out.select(F.round("loss", 6).alias("loss"),
                      F.round("loss_unweighted", 6).alias("loss_unweighted"))


@register("e5_profile", f"""WITH {fx.SQL_TEXT_BIN}, {fx.SQL_VEC_BIN},
u AS (SELECT 'text' AS dataset, label FROM text_bin UNION ALL SELECT 'vectors' AS dataset, label FROM vec_bin)
SELECT dataset, count_if(label = 1)::BIGINT AS n_pos, count_if(label <> 1)::BIGINT AS n_neg,
       round(CASE WHEN count_if(label = 1) > 0 THEN count_if(label <> 1) / count_if(label = 1) END, 6) AS ratio
FROM u GROUP BY dataset""")
def e5_profile(spark, sf):
    t = weights.profile(fx.text_bin(spark, sf).select("label")).withColumn("dataset", F.lit("text"))
    v = weights.profile(fx.vec_bin(spark, sf).select("label")).withColumn("dataset", F.lit("vectors"))
    return t.unionByName(v).select("dataset", "n_pos", "n_neg", F.round("ratio", 6).alias("ratio"))


# ---- A2, A5-A8: scans and sinks (written under the shared folder) -------------

from ..session import materialize, release, row_join, scratch_path  # noqa: E402


@register("a2_labelled_table", """SELECT d.doc_id AS id, d.text, CAST(l.toxic AS INTEGER) AS label
FROM documents d JOIN labels l ON d.doc_id = l.doc_id""")
def a2_labelled_table(spark, sf):
    return fx.text_bin(spark, sf).select("id", "text", "label")


SQL_TEXT_FOLDS = f"""WITH {fx.SQL_TEXT_BIN},
rep AS (SELECT t.id, t.label, CAST(g.r AS INTEGER) AS fold FROM text_bin t, range(0, 10) g(r)),
hs AS (SELECT *, row_number() OVER (PARTITION BY fold, label ORDER BY {H("'holdout'", 'fold', 'id')}, id) AS rk,
              count(*) OVER (PARTITION BY fold, label) AS nc FROM rep),
folds AS (SELECT fold, id, label, CASE WHEN rk <= round(0.2 * nc) THEN 'test' ELSE 'train' END AS split FROM hs)"""


def _text_folds(spark, sf):
    t = fx.text_bin(spark, sf).select("id", "label")
    return splits.stratified_holdout(t, repeats=10).withColumnRenamed("repeat", "fold")


@register("a5_fold_loader", SQL_TEXT_FOLDS + "\nSELECT fold, split, id, label FROM folds WHERE fold = 3")
def a5_fold_loader(spark, sf):
    """Write all folds partitioned by (fold, split), load fold 3 (pruned)."""
    path = scratch_path(spark, "text-folds")
    files.write_folds(_text_folds(spark, sf), path)
    train, test = files.load_fold(spark, path, 3)
    return train.unionByName(test).select("fold", "split", "id", "label")


@register("a7_fold_sink_json", SQL_TEXT_FOLDS + """
SELECT fold, split, count(*)::BIGINT AS n, sum(label)::BIGINT AS n_pos FROM folds GROUP BY fold, split""")
def a7_fold_sink_json(spark, sf):
    """Folds written as JSON lines (one row per line), read back and counted."""
    path = scratch_path(spark, "text-folds-json")
    files.write_folds(_text_folds(spark, sf), path, fmt="json")
    back = spark.read.schema("id long, label int, fold int, split string").json(path)
    return back.groupBy("fold", "split").agg(F.count(F.lit(1)).alias("n"),
                                            F.sum("label").cast("bigint").alias("n_pos"))


@register("a6_a8_vector_sink_scan", f"""WITH {fx.SQL_VEC_BIN},
rep AS (SELECT v.*, CAST(g.r AS INTEGER) AS fold FROM vec_bin v, range(0, 2) g(r)),
hs AS (SELECT *, row_number() OVER (PARTITION BY fold, label ORDER BY {H("'holdout'", 'fold', 'id')}, id) AS rk,
              count(*) OVER (PARTITION BY fold, label) AS nc FROM rep)
SELECT 'embeddings' AS dataset, 'raw' AS embedding, fold,
       CASE WHEN rk <= round(0.2 * nc) THEN 'test' ELSE 'train' END AS split, id, features, label FROM hs""")
def a6_a8_vector_sink_scan(spark, sf):
    """Vector folds of two embeddings written partitioned by (dataset,
    embedding, fold, split); one (dataset, embedding) read back."""
    v = fx.vec_bin(spark, sf)
    folds = splits.stratified_holdout(v.select("id", "label"), repeats=2).withColumnRenamed("repeat", "fold")
    raw = folds.join(v.select("id", "features"), "id").withColumn("dataset", F.lit("embeddings")).withColumn("embedding", F.lit("raw"))
    mapped = raw.withColumn("embedding", F.lit("map8")).withColumn(
        "features", S.linear_map(seeded_matrix(fx.SEED, "map", MAP_ROWS, MAP_DIM), F.col("features")))
    path = scratch_path(spark, "vectors")
    files.write_vectors(raw.unionByName(mapped), path)
    back = files.read_vectors(spark, path, "embeddings", "raw")
    return back.select("dataset", "embedding", "fold", "split", "id", "features", "label")


# ---- A3 / A4: whole files and columnar fold JSON -------------------------------

@register("a3_whole_files", """SELECT source, sum(length(text) + 1)::BIGINT AS n_chars,
       sum(length(text) - length(replace(text, chr(10), '')) + 1)::BIGINT AS n_breaks
FROM documents GROUP BY source""")
def a3_whole_files(spark, sf):
    """Texts written as text files partitioned by source, read back one
    string per file (any number of files per source); characters and line
    breaks per source survive the round trip."""
    path = scratch_path(spark, "whole-files")
    (fx.table(spark, sf, "documents").select("source", "text")
       .write.mode("overwrite").partitionBy("source").text(path))
    w = files.read_whole_files(spark, path)   # + the partition column ``source``
    return w.groupBy("source").agg(
        F.sum(F.length("value")).cast("bigint").alias("n_chars"),
        F.sum(F.length("value") - F.length(F.replace("value", F.lit("\n"), F.lit(""))))
        .cast("bigint").alias("n_breaks"))


@register("a4_fold_json_scan", SQL_TEXT_FOLDS.replace(
    "SELECT t.id, t.label,", "SELECT t.id, t.label, t.text,").replace(
    "SELECT fold, id, label,", "SELECT fold, id, label, text,") + """
SELECT fold, split, count(*)::BIGINT AS n, sum(label)::BIGINT AS n_pos,
       sum(length(text))::BIGINT AS n_chars FROM folds GROUP BY fold, split""")
def a4_fold_json_scan(spark, sf):
    """Text folds exported as columnar JSON objects (bounded chunks), scanned
    back to one row per position and counted per fold and split."""
    # folds are ranked on ids; a text is joined to the list of its ten folds by the place of its row
    t = materialize(fx.text_bin(spark, sf).select("id", "label", "text").withColumn("_row", F.monotonically_increasing_id()), "fold-texts")
    folds = splits.stratified_holdout(t.select("_row", "id", "label"), repeats=10).withColumnRenamed("repeat", "fold")
    path = scratch_path(spark, "fold-json")
    sides = materialize(folds.select("_row", "fold", "split"), "fold-sides")
    files.write_fold_json(t, sides, path, "_row", chunk_rows=64)
    release(t, sides)
    back = files.read_fold_json(spark, path, multi_line=False)
    back = back.withColumn("fold", F.regexp_extract("path", "fold=([0-9]+)", 1).cast("int")) \
               .withColumn("split", F.regexp_extract("path", "split=([a-z]+)", 1))
    return back.groupBy("fold", "split").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").cast("bigint").alias("n_pos"),
        F.sum(F.length("text")).cast("bigint").alias("n_chars"))
