"""Mixing sources to target weights: Efraimidis-Spirakis sampling to token budgets, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialise, table

#: Weights that sources get in order, the share of all words that the mix has, and how often a source may repeat.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2.0
SEED = "mix-1"
#: Keys become codes of so many bits. Prefix sums go over their first digits (of SLICE_BITS bits each), digit after digit of the slice in which
#: a budget ends, until it holds at most END_ROWS rows of a source or no digit is left: only its documents are sorted.
CODE_BITS, SLICE_BITS, END_ROWS = 50, 10, 10_000
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>!"


def size_of(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def quality_of(text_col: str) -> Column:
    """A document's quality weight from 0.1 to 1: less by five times the share of its characters that are symbols."""
    n = F.length(text_col)
    share = (n - F.length(F.translate(text_col, SYMBOLS, ""))) / F.greatest(n, F.lit(1))
    return F.coalesce(F.greatest(F.lit(0.1), 1 - 5 * share), F.lit(0.1))


def uniform_of(id_col: str, seed: str = SEED) -> Column:
    """A number in (0, 1) that only the id and the seed decide: 52 bits of an md5 plus a half."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def targets(sizes: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size) -> with target: weights repeat over the sources in order of code points, null last.

    Sharing out the excess by weight until no source is above its limit ends where each target is the lesser of its
    limit and one multiple of its weight. Sources reach their limits in the order of limit / weight, so
    prefix sums in that order give the multiple in one pass. One row a source, so its single-partition windows are small.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("nth") % len(weights)).cast("int") + 1).cast("double")
    df = sizes.withColumn("nth", F.row_number().over(order) - 1).withColumn("weight", weight).withColumn("limit", most * F.col("source_size"))
    full = Window.orderBy(F.col("limit") / F.col("weight"), "nth")
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    after = full.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).orderBy(F.lit(0))
    df = df.withColumn("all", F.sum("source_size").over(everything))
    multiple = (share * F.col("all") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    df = df.withColumn("multiple", multiple)
    # the first source that stays below its limit fixes the multiple for those after it
    below = F.min(F.when(F.col("multiple") <= F.col("limit") / F.col("weight"), F.struct((F.col("limit") / F.col("weight")).alias("ratio"), "nth", "multiple"))).over(everything)
    df = df.withColumn("first", below)
    free = F.struct((F.col("limit") / F.col("weight")).alias("ratio"), "nth") >= F.struct(F.col("first.ratio"), F.col("first.nth"))
    return df.select("source", "source_size", F.when(free, F.col("first.multiple") * F.col("weight")).otherwise(F.col("limit")).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = SHARE, most: float = MOST, weights: tuple[int, ...] = WEIGHTS, seed: str = SEED, slice_bits: int = SLICE_BITS, end_rows: int = END_ROWS, carry: bool = False) -> DataFrame:
    """(id, source, size, source_size, target, epochs, taken) for every row: taken is size times the copies that the mix takes.

    A source's target in words is met by whole documents: as many complete epochs as fit, then a part of one more epoch, a
    sample without replacement whose keys are exponential, -ln(u) / quality weight, least first. A document of that epoch
    is in while the middle of its words lies within the budget, so the source ends nearest to its target.

    The keys' range is cut into slices; words are summed per source and slice before the shuffle, and the slice where the budget ends
    follows from prefix sums. However the keys crowd, that slice is cut again until it is small, and only its documents are sorted.
    Null source is a source of its own, in last place; null text has size 0 and is never taken; null ids share one random
    number; ties of keys go by id and size, and rows that agree in all of these are interchangeable: as many are taken as fit,
    in any order. An empty table gives no rows; other columns of docs are ignored, or with carry follow in a struct _row, so that no id is needed to find them again.
    """
    spark, whole = docs.sparkSession, ["_row"] if carry else []
    key = -F.log(uniform_of("id", seed)) / F.col("quality")
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), size_of(text_col).alias("size"), quality_of(text_col).alias("quality"), *([F.struct(*docs.columns).alias("_row")] if carry else []))
    code = F.floor(F.col("key") / (1 + F.col("key")) * (1 << CODE_BITS)).cast("long")
    rows = materialise(spark, rows.withColumn("key", key).withColumn("code", code).select("id", "source", "size", "key", "code", *whole), "sizes")
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    upto = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)

    def summed(some: DataFrame, left: int) -> DataFrame:
        """Words and rows by source and slice, a slice being what is above the lowest `left` bits of the code."""
        sums = some.groupBy("source", F.shiftright("code", left).alias("slice")).agg(F.sum("size").alias("words"), F.count("*").alias("n"))
        return materialise(spark, sums, "slices")

    def ends(sums: DataFrame, goal: DataFrame) -> DataFrame:
        """(e, end_slice, end_before, end_rows): of each source the slice in which its part ends, the words before it and its rows."""
        within = sums.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0))).join(goal.select(F.col("source").alias("g"), "part", "start"), same("source", "g"))
        within = within.withColumn("before", F.col("before") + F.col("start")).where("before < part")
        return within.groupBy("source").agg(F.max(F.struct("slice", "before", "n")).alias("end")).select(F.col("source").alias("e"), F.col("end.slice").alias("end_slice"), F.col("end.before").alias("end_before"), F.col("end.n").alias("end_rows"))

    left = CODE_BITS - slice_bits
    sums = summed(rows, left)
    goal = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), share, most, weights)
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goal = materialise(spark, goal.withColumn("part", F.col("target") - F.col("epochs") * F.col("source_size")), "goals")
    end = materialise(spark, ends(sums, goal.withColumn("start", F.lit(0))).withColumn("left", F.lit(left)), "ends")
    while left > 0 and not end.where((F.col("end_rows") > end_rows) & (F.col("left") == left)).isEmpty():  # some source's slice is still large
        deep = end.where((F.col("end_rows") > end_rows) & (F.col("left") == left))
        inside = rows.select("source", "size", "code").join(deep, same("source", "e")).where(F.shiftright("code", left) == F.col("end_slice"))
        more = max(0, left - slice_bits)
        part = goal.join(deep, same("source", "e")).select("source", "part", F.col("end_before").alias("start"))
        found = ends(summed(inside.select("source", "size", "code"), more), part).withColumn("left", F.lit(more))
        end = materialise(spark, end.where((F.col("end_rows") <= end_rows) | (F.col("left") != left)).unionByName(found), "ends")
        left = more
    goal = goal.join(end, same("source", "e"), "left").drop("e", "end_rows").withColumnRenamed("source", "goal_source")
    joined = rows.join(materialise(spark, goal, "goals"), same("source", "goal_source")).drop("goal_source")
    slices = [F.when(F.col("left") == n, F.shiftright("code", n)) for n in range(CODE_BITS - slice_bits, -slice_bits, -slice_bits) if n > 0]  # shifts take a constant
    joined = joined.withColumn("slice", F.coalesce(*slices, F.col("code")))
    last = joined.where("slice = end_slice")
    order = Window.partitionBy("source").orderBy("key", F.col("id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    last = last.withColumn("before", F.col("end_before") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    last = last.withColumn("extra", (F.col("before") + F.col("size") / 2.0 <= F.col("part")).cast("int"))
    rest = joined.where("end_slice is null or slice <> end_slice").withColumn("extra", F.coalesce((F.col("slice") < F.col("end_slice")).cast("int"), F.lit(0)))
    cols = ["id", "source", "size", "source_size", "target", "epochs", "extra", *whole]
    out = rest.select(*cols).unionByName(last.select(*cols))
    return out.withColumn("taken", F.col("size") * (F.col("epochs") + F.col("extra")))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes."""
    out = mix(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix itself: each row as often as it is taken, with its columns.

    Copies are decided row by row: rows without an id, or that share one, are each in the mix as often as mix() says of them. Columns
    of any names and nulls pass through, null and empty texts are never taken, an empty table stays empty.
    """
    copies = mix(docs, carry=True).withColumn("_copies", F.when(F.col("size") > 0, F.col("epochs") + F.col("extra")).otherwise(0).cast("int")).where("_copies > 0")
    return copies.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_nth")).select("_row.*")


_SYMBOLS_SQL = SYMBOLS
OP3_SQL = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
    greatest(0.1, 1 - 5 * ((length(text) - length(translate(text, '{_SYMBOLS_SQL}', ''))) / greatest(length(text), 1)::DOUBLE)) AS q,
    ((('0x' || substr(md5('{SEED}:' || doc_id), 1, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][(nth % 3 + 1)::INT]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
m AS (SELECT *, cap / weight AS ratio,
    (1.5 * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY cap / weight, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS multiple FROM w),
f AS (SELECT ratio, nth, multiple FROM m WHERE multiple <= ratio ORDER BY ratio, nth LIMIT 1),
g AS (SELECT m.source, source_size, CASE WHEN (m.ratio, m.nth) >= (f.ratio, f.nth) THEN f.multiple * weight ELSE cap END AS target FROM m, f),
k AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY -ln(u) / q, doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target::DOUBLE AS target,
  (size * (epochs + CASE WHEN before + size / 2.0 <= target - epochs * source_size THEN 1 ELSE 0 END))::BIGINT AS taken FROM k"""
