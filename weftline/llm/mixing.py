"""Mixing sources to target weights by Pareto order sampling (operator 10).

Every source gets a target number of words. Its documents share it unequally: the
expected copies of a document grow with the length class of its text (16 plus the
binary logarithm of its words), up to `most`, such that the source's expected
words are its target. The whole part of the expected copies is certain; the
fraction p is an inclusion probability. Documents are ranked by the odds of a
random number divided by the odds of p (Pareto order sampling), and the first of
that order are taken until the words reach the target, so the sample has a fixed
size and a document's chance follows its p.

Words are summed by slice of that order first; only the slice in which a source's
words end is ranked row by row, without texts. It gives the last row that is taken,
and every other row is judged by comparing itself with that.

Defined cases: a null text has size 0 and is never worth words; a null source
is a source of its own, the last; the random number of a row without a doc_id
comes from its text; repeated rows are documents of their own, and which of equal
rows is taken does not matter; an empty table gives an empty table. Only `doc_id`,
`text` and `source` are read, so other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm._graph import cut, packed, table, unpacked

#: Slices of the random order; words are summed by slice before any ranking.
SLICES = 4096
#: Rows of the plan (a source's length classes) that are sent to every task.
MOST_BROADCAST = 200_000
#: The weight of a length class is this plus its binary logarithm.
LENGTH_BASE = 16


def _sizes(docs: DataFrame, seed: int) -> list[Column]:
    """A row's words, its length class and its random number, the same in every run."""
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.md5("text")), F.lit("null"))
    u = F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{seed}"))), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))
    return [words.alias("size"), (F.length(F.bin(words)) - 1).cast("long").alias("class"), u.alias("u")]


def _targets(totals: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """(source, source_size, target): one row a source, so ranks and sums over all of them are small."""
    n = len(weights)
    every, by_code, by_ratio = Window.partitionBy(), Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("ratio", "rank")
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), ((F.col("rank") - 1) % n + 1).cast("int"))
    ahead = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    wide = "decimal(38,0)"
    ranked = (
        totals.withColumn("rank", F.row_number().over(by_code))
        .withColumn("w", weight.cast("long"))
        .withColumn("all_words", F.floor(F.sum("source_size").over(every) * F.lit(float(share))).cast("long"))
        .withColumn("ratio", F.col("source_size") / F.col("w"))
        .withColumn("capped_before", most * F.coalesce(F.sum("source_size").over(ahead), F.lit(0)))
        .withColumn("w_left", F.sum("w").over(every) - F.coalesce(F.sum("w").over(ahead), F.lit(0)))
        .withColumn("open", F.col("w").cast(wide) * (F.col("all_words") - F.col("capped_before")) < (most * F.col("source_size")).cast(wide) * F.col("w_left"))
        .withColumn("i", F.row_number().over(by_ratio))
        .withColumn("first_open", F.min(F.when(F.col("open"), F.col("i"))).over(every))
    )
    level = ranked.where("i = first_open").select(F.col("all_words").alias("t"), F.col("capped_before").alias("c"), F.col("w_left").alias("wl"))
    is_capped = F.col("first_open").isNull() | (F.col("i") < F.col("first_open"))
    target = F.when(is_capped, (most * F.col("source_size")).cast("double")).otherwise((F.col("w").cast(wide) * (F.col("t") - F.col("c"))).cast("double") / F.col("wl").cast("double"))
    return ranked.join(F.broadcast(level), F.lit(True), "left").select("source", "source_size", target.alias("target"))  # one row at most


def _copies(sized: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """(its_source, its_class, source_size, target, whole, p, need): certain copies and
    inclusion probability of each length class, and the words a source then still needs."""
    classes = cut(sized.groupBy("source", "class").agg(F.sum("size").alias("words")))
    targets = _targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most).withColumnRenamed("source", "s")
    # long classes reach `most` copies first; the others share what these leave
    longest = Window.partitionBy("source").orderBy(F.desc("class"))
    ahead, behind = longest.rowsBetween(Window.unboundedPreceding, -1), longest.rowsBetween(0, Window.unboundedFollowing)
    g = F.col("class") + LENGTH_BASE
    x = (
        classes.join(targets, F.col("source").eqNullSafe(F.col("s")))
        .withColumn("left", F.col("target") - (most * F.coalesce(F.sum("words").over(ahead), F.lit(0))).cast("double"))
        .withColumn("mass", F.sum(g * F.col("words")).over(behind).cast("double"))
        .withColumn("open", F.col("left") * g.cast("double") < F.lit(float(most)) * F.col("mass"))
        .withColumn("level", F.first(F.when(F.col("open"), F.struct("left", "mass")), ignorenulls=True).over(longest.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("expected", F.coalesce(F.col("level.left") * g.cast("double") / F.col("level.mass"), F.lit(float(most))))
        .withColumn("whole", F.when(F.col("words") > 0, F.least(F.floor("expected"), F.lit(most))).otherwise(0).cast("long"))
        .withColumn("p", F.when(F.col("words") > 0, F.col("expected") - F.col("whole")).otherwise(0.0))
    )
    need = F.col("target") - F.sum(F.col("whole") * F.col("words")).over(Window.partitionBy("source")).cast("double")
    return x.select(F.col("source").alias("its_source"), F.col("class").alias("its_class"), "source_size", "target", "whole", "p", need.alias("need"))


def _joined(rows: DataFrame, plan: DataFrame, small: bool, *on: str) -> DataFrame:
    """Rows with their plan: broadcast if it is small, else by a join whose large partitions can be split."""
    match = F.col("source").eqNullSafe(F.col("its_source"))
    for c in on:
        match = match & (F.col(c) == F.col(f"its_{c}"))
    return rows.join(F.broadcast(plan) if small else plan, match)


def _ranked(rows: DataFrame) -> DataFrame:
    """Rows with q, the place of their odds ratio between 0 and 1, and its slice; null if it has no chance."""
    a, b = F.col("u") * (1 - F.col("p")), (1 - F.col("u")) * F.col("p")
    q = F.when((F.col("p") > 0) & (F.col("size") > 0), F.try_divide(a, a + b))
    return rows.withColumn("q", q).withColumn("slice", F.floor(F.col("q") * SLICES))


def _plan(sized: DataFrame, weights: tuple[int, ...], share: float, most: int) -> tuple[DataFrame, bool]:
    """The copies of each class, with the last row that its source takes (edge, last_q,
    last_size) and how many of the rows equal to it (ties of all_ties); and whether it is small."""
    copies = cut(_copies(sized, weights, share, most))
    small = copies.count() <= MOST_BROADCAST
    chances = _ranked(_joined(sized.select("source", "class", "size", "u"), copies, small, "class")).where("q is not null")
    slices = chances.groupBy("source", "slice").agg(F.sum("size").alias("words"), F.first("need").alias("need"))
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sliced = slices.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
    # the slice in which the words reach what is needed, or the last one
    edges = cut(sliced.where("before < need").groupBy("source").agg(F.max("slice").alias("edge"), F.max_by("before", "slice").alias("before")).withColumnRenamed("source", "its_source"))
    inside = _joined(chances.drop("its_source", "its_class"), edges, small).where("slice = edge")
    running = Window.partitionBy("source").orderBy("q", "size").rowsBetween(Window.unboundedPreceding, -1)
    so_far = F.col("before") + F.coalesce(F.sum("size").over(running), F.lit(0))
    judged = inside.withColumn("take", 2 * so_far + F.col("size") <= 2 * F.col("need"))
    last = judged.groupBy("source", "edge", "q", "size").agg(F.count("*").alias("all_ties"), F.count_if("take").alias("ties")).where("ties > 0")
    last = last.groupBy("source").agg(F.max(F.struct("q", "size", "ties", "all_ties")).alias("last"))
    ends = edges.join(last.withColumnRenamed("source", "s"), F.col("its_source").eqNullSafe(F.col("s")), "left").select(F.col("its_source").alias("s"), "edge", F.col("last.q").alias("last_q"), F.col("last.size").alias("last_size"), F.col("last.ties").alias("ties"), F.col("last.all_ties").alias("all_ties"))
    return cut(copies.join(ends, F.col("its_source").eqNullSafe(F.col("s")), "left").drop("s")), small


def _taken(rows: DataFrame, plan: DataFrame, small: bool) -> DataFrame:
    """The rows (source, class, size, u, ...) with source_size, target and copies."""
    names = [c for c in rows.columns if c not in ("class", "u")]
    full = _ranked(_joined(rows, plan, small, "class"))
    in_edge = F.col("slice") == F.col("edge")
    equal = in_edge & (F.col("q") == F.col("last_q")) & (F.col("size") == F.col("last_size"))
    first = (F.col("slice") < F.col("edge")) | (in_edge & ((F.col("q") < F.col("last_q")) | ((F.col("q") == F.col("last_q")) & (F.col("size") <= F.col("last_size")))))
    columns = [*names, "source_size", "target"]
    split = F.coalesce(equal & (F.col("ties") < F.col("all_ties")), F.lit(False))
    clear = full.where(~split).select(*columns, (F.col("whole") + F.coalesce(first, F.lit(False)).cast("long")).alias("copies"))
    # only equal rows of which some are taken are numbered
    number = F.row_number().over(Window.partitionBy("source").orderBy("q"))
    tied = full.where(split).withColumn("i", number).select(*columns, (F.col("whole") + (F.col("i") <= F.col("ties")).cast("long")).alias("copies"))
    return clear.union(tied)


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, most: int = 3, seed: int = 7) -> DataFrame:
    """One row per document with the words that the mix takes from it.

    `weights` repeat over the sources in code point order, `share` is the part
    of all words that the mix holds, `most` the largest number of copies.
    Returns doc_id, source, size, source_size, target, copies and taken.
    """
    sized = cut(docs.select("doc_id", "source", *_sizes(docs, seed)))
    return _taken(sized, *_plan(sized, weights, share, most)).withColumn("taken", F.col("copies") * F.col("size"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, most: int = 3, seed: int = 7) -> DataFrame:
    """The documents of the mix, with all their columns, each as often as it is taken.

    Texts are never shuffled, but for those of equal rows of which some are taken.
    """
    plan = _plan(cut(docs.select("source", *_sizes(docs, seed))), weights, share, most)
    rows = docs.select(packed(docs.columns), "source", *_sizes(docs, seed))
    taken = _taken(rows, *plan).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return taken.select(*unpacked(docs.columns))


def op10_mix(spark, sf_dir):
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


ORACLE = {
    "op10_mix": r"""
WITH sized AS (
  SELECT doc_id, source, CAST(COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(COALESCE(CAST(doc_id AS VARCHAR), 'text:' || md5(text), 'null') || ':7'), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS u
  FROM documents
), classes AS (SELECT source, length(bin(size)) - 1 AS class, CAST(SUM(size) AS BIGINT) AS words FROM sized GROUP BY ALL
), totals AS (SELECT source, CAST(SUM(words) AS BIGINT) AS source_size FROM classes GROUP BY source
), a AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM totals
), b AS (SELECT *, (rank - 1) % 3 + 1 AS w FROM a
), c AS (
  SELECT *, SUM(source_size) OVER () AS t, row_number() OVER r AS i,
         3 * COALESCE(SUM(source_size) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped_before,
         SUM(w) OVER () - COALESCE(SUM(w) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_left
  FROM b WINDOW r AS (ORDER BY source_size / w, rank)
), d AS (SELECT *, w * (t - capped_before) < 3 * source_size * w_left AS open FROM c
), e AS (SELECT *, MIN(CASE WHEN open THEN i END) OVER () AS k FROM d
), f AS (
  SELECT e.source, e.source_size, CASE WHEN e.k IS NULL OR e.i < e.k THEN CAST(3 * e.source_size AS DOUBLE)
              ELSE CAST(e.w * (l.t - l.capped_before) AS DOUBLE) / CAST(l.w_left AS DOUBLE) END AS target
  FROM e LEFT JOIN (SELECT * FROM e WHERE i = k) l ON TRUE
), g AS (
  SELECT k.source, k.class, k.words, f.source_size, f.target,
         target - CAST(3 * COALESCE(SUM(words) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS room,
         CAST(SUM((class + 16) * words) OVER (r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS mass
  FROM classes k JOIN f ON k.source IS NOT DISTINCT FROM f.source WINDOW r AS (PARTITION BY k.source ORDER BY class DESC)
), h AS (SELECT *, MAX(CASE WHEN room * CAST(class + 16 AS DOUBLE) < 3.0::DOUBLE * mass THEN class END) OVER (PARTITION BY source) AS top FROM g
), o AS (
  SELECT h.*, CASE WHEN h.top IS NULL OR h.class > h.top THEN 3.0::DOUBLE ELSE l.room * CAST(h.class + 16 AS DOUBLE) / l.mass END AS expected
  FROM h LEFT JOIN h l ON l.source IS NOT DISTINCT FROM h.source AND l.class = h.top
), p AS (
  SELECT *, CASE WHEN words > 0 THEN LEAST(CAST(floor(expected) AS BIGINT), 3) ELSE 0 END AS whole FROM o
), q AS (
  SELECT *, CASE WHEN words > 0 THEN expected - CAST(whole AS DOUBLE) ELSE 0 END AS p, target - CAST(SUM(whole * words) OVER (PARTITION BY source) AS DOUBLE) AS need FROM p
), r AS (
  SELECT s.doc_id, s.source, s.size, q.source_size, q.target, q.whole, q.need,
         CASE WHEN q.p > 0 AND s.size > 0 THEN u * (1 - p) / (u * (1 - p) + (1 - u) * p) END AS odds
  FROM sized s JOIN q ON s.source IS NOT DISTINCT FROM q.source AND length(bin(s.size)) - 1 = q.class
), s AS (
  SELECT *, COALESCE(SUM(CASE WHEN odds IS NOT NULL THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY odds NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS so_far FROM r
), t AS (SELECT *, whole + CASE WHEN odds IS NOT NULL AND 2 * so_far + size <= 2 * need THEN 1 ELSE 0 END AS copies FROM s)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken, CAST(copies AS BIGINT) AS copies FROM t
"""
}
QUERIES = {"op10_mix": op10_mix}
