"""Benchmark decontamination: SimHash of item-sized windows, found through
multi-index Hamming blocks, verified by weighted-shingle similarity.

Shingles are ``SHINGLE`` consecutive words (runs of letters and digits after
lower-casing). A shingle weighs ``UNIT / number of different items that have it``,
so phrases that many items share count little; a shingle of no item weighs
``UNIT``. Items of the same shingles are one here, whatever their ids. A document
is contaminated by an item if one of its windows of the item's length has a weighted
Jaccard similarity of at least 0.75 with it, or with ``plain`` (as the queries ask
for) a plain one, and their fingerprints are within ``RADIUS``. The plain one finds
near copies of items that share a template, whose own shingles weigh less than the
words that differ.

1. *Places.* A document's matching shingles must be 0.75 of an item, by weight (or
   by number), for any window to qualify; and a window itself must hold that many
   of them. Both are necessary conditions, so windows are laid only where they hold.
2. *Fingerprints.* ``FP_BITS``-bit SimHash of each window: bit counts of all its
   shingle hashes are added in 15-bit lanes, 15 sums for 60 bits.
3. *Index.* Fingerprints are cut into ``RADIUS + 1`` blocks. Two that differ in at
   most ``RADIUS`` bits agree in one whole block, so an equi-join on (item length,
   block, its bits) finds every pair within the radius; ``bit_count`` confirms.
4. *Verification.* Candidates' shingles are joined with the item's, weighed and
   counted, in whole numbers.

All steps are DataFrame expressions. Texts are not shuffled; what is shuffled
are matches of benchmark shingles, windows of suspicious documents and, where the
benchmark is too long to broadcast, shingle hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, release
from .common import broadcast_within, fresh, row_key

SHINGLE = 5
NUM, DEN = 75, 100
UNIT = 1000
FP_BITS = 60
LANES = 15                         # bits apart
LANE_MOST = (1 << 14) - 1          # shingles that a lane counts; longer lists are counted bit by bit
RADIUS = 19
BROADCAST_SHINGLES = 500_000
BROADCAST_DOCS = 100_000
_ONES = sum(1 << (LANES * k) for k in range(FP_BITS // LANES))


def words_of(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits and non-ASCII characters."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _once(df: DataFrame, name: str, c: Column) -> DataFrame:
    """``df`` with column ``c``, computed once per row: a one-element generator,
    because the optimiser would copy the expression itself into every filter and
    lambda that reads it."""
    return df.select("*", F.explode(F.array(c)).alias(name))


def with_shingles(df: DataFrame, text: Column) -> DataFrame:
    """``df`` with ``sh``, the hashes of its shingles in order (fewer words than
    a shingle has are one, none are none), and ``nw``, the words of a shingle."""
    w = _once(df, "_w", words_of(text))
    n = F.size("_w")
    h = F.transform("_w", lambda x, i: F.xxhash64(x, *[F.get("_w", i + k) for k in range(1, SHINGLE)]))
    return _once(w, "sh", F.slice(h, 1, F.when(n > 0, F.greatest(n - (SHINGLE - 1), F.lit(1))).otherwise(0))).withColumn(
        "nw", F.least(n, F.lit(SHINGLE))).drop("_w")


def _lane_sum(j: int):
    return lambda total, h: total + F.shiftrightunsigned(h, j).bitwiseAND(F.lit(_ONES))


def _bit_sum(b: int):
    return lambda total, h: total + F.shiftrightunsigned(h, b).bitwiseAND(F.lit(1))


def simhash(sh: Column) -> Column:
    """Bit b of the result: whether more than half of the hashes have bit b."""
    need = F.floor(F.size(sh) / 2).cast("long") + 1            # bits needed in a lane
    out = F.lit(0).cast("long")
    for j in range(LANES):
        count = F.aggregate(sh, F.lit(0).cast("long"), _lane_sum(j))
        over = F.shiftrightunsigned(count + (F.lit(1 << (LANES - 1)) - need) * F.lit(_ONES), LANES - 1).bitwiseAND(F.lit(_ONES))
        out = out.bitwiseOR(F.shiftleft(over, j))
    slow = F.lit(0).cast("long")
    for b in range(FP_BITS):
        ones = F.aggregate(sh, F.lit(0).cast("long"), _bit_sum(b))
        slow = slow.bitwiseOR(F.when(ones >= need, F.lit(1 << b)).otherwise(F.lit(0)).cast("long"))
    return F.when(F.size(sh) <= LANE_MOST, out).otherwise(slow)


def blocks(fp: Column, radius: int = RADIUS) -> Column:
    """(block number, its bits) of all ``radius + 1`` blocks."""
    cuts = [FP_BITS * i // (radius + 1) for i in range(radius + 2)]
    return F.array(*[F.struct(F.lit(i).alias("no"), F.shiftrightunsigned(fp, a).bitwiseAND(
        F.lit((1 << (b - a)) - 1)).alias("bits")) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))])


def leaks(docs: DataFrame, items: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text",
          item_col: str = "item_id", item_text: str = "text", plain: bool = False) -> DataFrame:
    """``doc_id, item_id, start_word, end_word, distance, similarity, row_key``:
    the best window of each document and item that qualify. ``similarity`` is the
    weighted one, or the plain one where only that qualifies (``plain``).

    Null and empty texts hold nothing and leak nothing. Repeated rows are one
    document, found once; rows that share an id, or have none, are told apart by
    their text. Repeated items count once, items without an id are ignored. Empty
    tables give no rows; other columns are ignored. An item of fewer than five
    words is one shingle, and leaks only from a document of exactly these words."""
    d = docs.select(row_key(id_col, text_col).alias("row_key"), F.col(id_col).cast("long").alias("doc_id"),
                    F.col(text_col).alias("text"))
    it = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).alias("text")).where(
        "item_id is not null").distinct()
    it = with_shingles(it, F.col("text")).where("size(sh) > 0")
    it = it.select("item_id", "sh", F.size("sh").alias("m"), simhash(F.col("sh")).alias("fp"),
                   F.xxhash64("item_id", "text").alias("item_key"), F.xxhash64("sh").alias("like"))
    it = materialize(it, "items")
    parts = it.select("item_id", "item_key", "like", "m", F.explode(F.array_distinct("sh")).alias("h"))
    weights = parts.groupBy("h").agg(F.floor(F.lit(UNIT) / F.count_distinct("like")).cast("long").alias("w"))
    weights = weights.withColumn("w", F.greatest("w", F.lit(1)))
    parts = materialize(parts.join(weights, "h"), "item-shingles")
    n_parts = parts.count()
    weights = parts.select("h", "w").distinct()
    totals = parts.groupBy("item_key").agg(F.sum("w").alias("item_w"), F.count("*").alias("item_n"))
    it = it.join(totals, "item_key")
    small = lambda df: broadcast_within(df, n_parts, BROADCAST_SHINGLES)

    # 1. places: matches of (document, item), heavy enough as a whole
    places = (with_shingles(d, F.col("text")).select("row_key", F.size("sh").alias("n"), F.posexplode("sh").alias("pos", "h"))
              .join(small(weights.select("h")), "h")
              .groupBy("row_key", "h").agg(F.first("n").alias("n"), F.collect_set("pos").alias("ps")))
    places = materialize(places, "item-places")
    # a place that misses all of an item's seeds misses too much of it; seeds are its
    # rarest shingles, so a template that many items share leads to none of them
    rare = Window.partitionBy("item_key").orderBy(F.desc("w"), "h")
    before = rare.rowsBetween(Window.unboundedPreceding, -1)
    spare = lambda c: F.floor(F.col(c) * F.lit(DEN - NUM) / F.lit(DEN))
    seeds = (parts.join(small(totals), "item_key")
             .withColumn("w0", F.coalesce(F.sum("w").over(before), F.lit(0))).withColumn("n0", F.row_number().over(rare) - 1)
             .where((F.col("w0") <= spare("item_w")) | F.lit(plain) & (F.col("n0") <= spare("item_n"))).select("item_key", "h"))
    cand = places.select("row_key", "h").join(small(seeds), "h").select("row_key", "item_key").distinct()
    each = (cand.join(small(parts.select("item_key", "m", "h", "w")), "item_key").join(places, ["row_key", "h"]))
    need = F.lit(NUM) * F.col("item_w")
    pairs = (each.groupBy("row_key", "item_key").agg(
        F.sum("w").alias("got"), F.count("*").alias("got_n"), F.first("m").alias("m"), F.first("n").alias("n"), F.flatten(F.collect_list("ps")).alias("ps"))
        .join(small(totals), "item_key").where((F.lit(DEN) * F.col("got") >= need) | F.lit(plain) & (F.lit(DEN) * F.col("got_n") >= F.lit(NUM) * F.col("item_n"))))
    starts = pairs.select(
        "row_key", "m", "ps", "item_w", F.explode(F.array_distinct(F.flatten(F.transform("ps", lambda p: F.sequence(
            F.greatest(F.lit(0), F.least(p, F.col("n") - F.col("m")) - F.col("m") + 1),
            F.greatest(F.lit(0), F.least(p, F.col("n") - F.col("m")))))))).alias("s"))
    # a shingle weighs at most UNIT, so this also holds for what qualifies by number
    inside = F.size(F.filter("ps", lambda p: (p >= F.col("s")) & (p < F.col("s") + F.col("m"))))
    starts = (starts.where(F.lit(DEN * UNIT) * inside >= need).groupBy("row_key", "m")
              .agg(F.collect_set("s").alias("starts")))
    starts = materialize(starts, "window-starts")

    # 2. fingerprints of the windows
    n_rows, n_starts = starts.agg(F.count("*"), F.coalesce(F.sum(F.size("starts")), F.lit(0))).first()
    few = broadcast_within(starts, max(n_rows, n_starts // 40), BROADCAST_DOCS)
    at = with_shingles(d.join(few, "row_key"), F.col("text"))
    wins = (at.select("row_key", "doc_id", "m", "nw", "sh", F.explode("starts").alias("s"))
            .select("row_key", "doc_id", "m", "nw", "s", F.expr("slice(sh, s + 1, m)").alias("win")))
    wins = materialize(wins.withColumn("fp", simhash(F.col("win"))).dropDuplicates(["row_key", "m", "s"]), "windows")

    # 3. pairs within the radius, through their blocks
    left = wins.select("row_key", "m", "s", "fp", F.explode(blocks(F.col("fp"), radius)).alias("b"))
    right = it.select("item_key", "item_id", "item_w", "item_n", "m", F.col("fp").alias("item_fp"), F.explode(blocks(F.col("fp"), radius)).alias("b"))
    distance = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))
    near = (left.join(small(right), ["m", "b"]).withColumn("distance", distance.cast("int"))
            .where(F.col("distance") <= radius)
            .groupBy("row_key", "m", "s", "item_key").agg(F.first("distance").alias("distance"),
                                                          F.first("item_id").alias("item_id"), F.first("item_w").alias("item_w"),
                                                          F.first("item_n").alias("item_n")))

    # 4. exact weighted similarity
    cand = wins.select("row_key", "doc_id", "m", "nw", "s", "win").join(near, ["row_key", "m", "s"])
    sh = (cand.select("row_key", "doc_id", "m", "nw", "s", "item_key", "item_id", "item_w", "item_n", "distance",
                      F.explode(F.array_distinct("win")).alias("h"))
          .join(small(weights), "h", "left").join(small(parts.select("item_key", "h", F.lit(True).alias("own"))), ["item_key", "h"], "left"))
    w = F.coalesce("w", F.lit(UNIT))
    sims = sh.groupBy("row_key", "doc_id", "m", "nw", "s", "item_key", "item_id", "item_w", "item_n", "distance").agg(
        F.sum(w).alias("win_w"), F.coalesce(F.sum(F.when(F.col("own"), w)), F.lit(0)).alias("both"),
        F.count("*").alias("win_n"), F.count(F.when(F.col("own"), 1)).alias("both_n"))
    union, union_n = F.col("item_w") + F.col("win_w") - F.col("both"), F.col("item_n") + F.col("win_n") - F.col("both_n")
    sims = sims.withColumn("weighted", F.lit(DEN) * F.col("both") >= F.lit(NUM) * union)
    sims = sims.where(F.col("weighted") | F.lit(plain) & (F.lit(DEN) * F.col("both_n") >= F.lit(NUM) * union_n)).withColumn(
        "similarity", F.round(F.when(F.col("weighted"), F.col("both") / union).otherwise(F.col("both_n") / union_n), 6))
    best = sims.groupBy("row_key", "doc_id", "item_id").agg(
        F.max(F.struct("weighted", "similarity", (-F.col("distance")).alias("d"), (-F.col("s")).alias("s"), "m", "nw")).alias("x"))
    out = best.select("doc_id", "item_id", (-F.col("x.s")).cast("long").alias("start_word"),
                      (F.col("x.m") - F.col("x.s") + F.col("x.nw") - 1).cast("long").alias("end_word"),
                      (-F.col("x.d")).alias("distance"), "x.similarity", "row_key")
    out = materialize(out, "leaks")
    release(starts, wins, places)
    return out


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that leak an item, by weight or plainly; all columns as they were."""
    leak = fresh(docs, "_leak")
    found = leaks(docs, items, id_col=id_col, text_col=text_col, plain=True).select(F.col("row_key").alias(leak)).distinct()
    found = broadcast_within(found, found.count(), BROADCAST_DOCS)
    return docs.join(found, row_key(id_col, text_col) == F.col(leak), "left_anti")
