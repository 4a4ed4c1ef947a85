"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions only.

Each source is a queue of its documents in shuffled order, gone through ``passes`` times. A document's virtual finish
time is the tokens its source has then served, divided by the source's weight. Documents in the order of finish times,
cut where their sizes reach the budget, serve every source in proportion to its weight until it is used up.

Nothing is gathered by source: running sums are taken within short blocks of the shuffled order, to which the sums of
the earlier blocks are added, so one source may hold any share of the rows. One row per source and block, and one per
source, pass through ordered windows. The cut is found from sums over ranges of finish time and a sort of the one range
in which the budget ends.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import release, spread, staged

#: Rows that a block of the shuffled order, or a range of finish times, should hold.
BLOCK_ROWS = 2048
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: tuple[int, ...], share: float, passes: int) -> DataFrame:
    """(skey, source, source_size) -> with rank, weight, level and target.

    Level is the virtual time at which the budget, ``share`` of all sizes, is used: the sum over sources of
    min(passes * size, level * weight) equals it. Sources below their limit at that level get level * weight.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    everything = W.partitionBy(F.lit(1))
    by_ratio = W.partitionBy(F.lit(1)).orderBy("ratio", "rank")
    cap = F.col("source_size") * F.lit(passes)
    t = sources.withColumn("rank", F.row_number().over(order)).withColumn(
        "weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    )
    t = t.withColumn("ratio", cap.cast("double") / F.col("weight"))
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(0, W.unboundedFollowing)
    t = t.withColumn("budget", F.sum("source_size").over(everything).cast("double") * F.lit(float(share)))
    t = t.withColumn(
        "if_here", (F.col("budget") - F.coalesce(F.sum(cap).over(before), F.lit(0)).cast("double")) / F.sum("weight").over(onward)
    )
    t = t.withColumn(
        "level", F.min_by("if_here", F.when(F.col("if_here") <= F.col("ratio"), F.struct("ratio", "rank"))).over(everything)
    )
    return t.select(
        "skey", "source", "source_size", "rank", "weight", "level", "budget",
        F.least(cap.cast("double"), F.col("level") * F.col("weight")).alias("target"),
    )


def fair_mix(
    docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
    weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, passes: int = 2, seed: str = "mix", row_col: str | None = None,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, weight, target, finish, copies, taken, and, with
    ``row_col``, row: that number, which rows are told apart by.

    ``copies`` (0 to ``passes``) is how often the mix has the document and ``taken`` is copies * size. Sources in code
    point order, null last, weigh as ``weights`` repeat. Documents of no words never use the budget: they are taken with
    the passes that end before the cut. Rows alike in every used column are served one after the other; which is first
    does not matter. No rows, or no words at all: nothing is taken. Other columns of ``docs`` are not read.
    """
    sized = staged(
        spread(docs).select(
            F.col(id_col).alias("doc_id"),
            (F.col(row_col) if row_col else F.lit(0)).cast("long").alias("row"),
            F.col(source_col).alias("source"),
            F.when(F.col(source_col).isNull(), "~").otherwise(F.concat(F.lit("="), F.col(source_col))).alias("skey"),
            word_count(F.col(text_col)).alias("size"),
            F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))), 1, 16).alias("key"),
        ),
        "mix-sizes",
    )
    whole, rows = sized, sized.count()
    digits = max(1, math.ceil(math.log(max(rows, 1) / BLOCK_ROWS, 16))) if rows > BLOCK_ROWS else 1
    sized = sized.withColumn("block", F.substring("key", 1, digits))

    sums = sized.groupBy("skey", "block").agg(F.sum("size").alias("block_size"), F.first("source").alias("source"))
    targets = source_targets(
        sums.groupBy("skey").agg(F.first("source").alias("source"), F.sum("block_size").alias("source_size")), weights, share, passes
    )
    earlier = W.partitionBy("skey").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select("skey", "block", F.coalesce(F.sum("block_size").over(earlier), F.lit(0)).alias("served")).join(
        targets.drop("source"), "skey"
    )
    inside = W.partitionBy("skey", "block").orderBy("key", "doc_id", "size", "row").rowsBetween(W.unboundedPreceding, 0)
    placed = sized.withColumn("within", F.sum("size").over(inside)).join(offsets, ["skey", "block"])
    placed = staged(
        placed.select(
            "doc_id", "row", "source", "size", "key", "source_size", "rank", "weight", "target", "level", "budget",
            (F.col("served") + F.col("within")).alias("ends"),
        ),
        "mix-places",
    )

    release(whole)

    # An entry is a document in one pass. Ranges of finish time up to the level hold about BLOCK_ROWS entries each.
    ranges = max(1, rows * passes // BLOCK_ROWS)
    entry = lambda p: F.struct(
        ((F.col("ends") + F.lit(p) * F.col("source_size")).cast("double") / F.col("weight")).alias("finish"),
        "rank", "key", "doc_id", "ends", F.lit(p).alias("pass"),
    )
    entries = placed.select(
        "size", "level", "budget", F.explode(F.array(*[entry(p) for p in range(passes)])).alias("entry")
    ).withColumn(
        "range",
        F.when(F.col("level") > 0, F.least(F.floor(F.col("entry.finish") / F.col("level") * ranges), F.lit(2 * ranges + 1))).otherwise(0),
    )
    by_range = entries.groupBy("range").agg(F.sum("size").alias("tokens"), F.max("budget").alias("budget"))
    running = by_range.withColumn("before", F.sum("tokens").over(W.orderBy("range")) - F.col("tokens"))
    last = running.filter(F.col("before") <= F.col("budget")).agg(F.max("range"), F.max_by("before", "range")).first()
    cut = None
    if last[0] is not None:
        # The entry at which the budget ends, by a sort of the range in which it ends.
        end = entries.filter(F.col("range") == last[0]).withColumn(
            "upto", F.sum("size").over(W.partitionBy("range").orderBy("entry").rowsBetween(W.unboundedPreceding, 0)) + F.lit(last[1])
        )
        cut = end.filter(F.col("upto") <= F.col("budget")).agg(F.max("entry")).first()[0]
    if cut is not None:
        kinds = {f.name: f.dataType for f in entries.schema["entry"].dataType}
        bound = F.struct(*[F.lit(cut[k]).cast(kind).alias(k) for k, kind in kinds.items()])
        taken = [(entry(p) <= bound).cast("int") for p in range(passes)]
    elif last[0] is not None:  # the range's first entry is over the budget already: all of the ranges before are taken
        fin = lambda p: F.floor((F.col("ends") + F.lit(p) * F.col("source_size")).cast("double") / F.col("weight") / F.col("level") * ranges)
        taken = [F.coalesce((fin(p) < F.lit(last[0])).cast("int"), F.lit(0)) for p in range(passes)]
    else:
        taken = [F.lit(0)]
    copies = sum(taken[1:], taken[0])
    return placed.select(
        "doc_id", "source", "size", "source_size", "weight", "target", (F.col("ends") / F.col("weight")).alias("finish"),
        copies.alias("copies"), (F.col("size") * copies).alias("taken"), *(["row"] if row_col else []),
    )


#: The same mix as one statement: the first entries in the order of finish times, up to the budget.
SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 16) AS k
  FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rnk
  FROM sized GROUP BY source),
w AS (SELECT *, [5, 2, 1][(rnk - 1) % 3 + 1] AS weight FROM src),
r AS (SELECT *, (2 * source_size)::DOUBLE / weight AS ratio, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS budget FROM w),
h AS (
  SELECT *, (budget - coalesce(sum(2 * source_size) OVER (ORDER BY ratio, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
            / (sum(weight) OVER (ORDER BY ratio, rnk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS if_here FROM r),
l AS (SELECT first(if_here ORDER BY ratio, rnk) AS level FROM h WHERE if_here <= ratio),
t AS (SELECT h.*, least((2 * source_size)::DOUBLE, level * weight) AS target FROM h, l),
p AS (
  SELECT s.doc_id, s.size, s.k, t.source_size, t.rnk, t.weight, t.target, t.budget,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.doc_id, s.size ROWS UNBOUNDED PRECEDING)::BIGINT AS ends
  FROM sized s JOIN t ON s.source IS NOT DISTINCT FROM t.source),
e AS (
  SELECT p.*, pass, (ends + pass * source_size)::DOUBLE / weight AS finish FROM p, (VALUES (0), (1)) AS v(pass)),
c AS (
  SELECT *, sum(size) OVER (ORDER BY finish, rnk, k, doc_id, ends, pass ROWS UNBOUNDED PRECEDING) AS upto FROM e)
SELECT doc_id, size, source_size, target, sum(CASE WHEN upto <= budget THEN size ELSE 0 END)::BIGINT AS taken
FROM c GROUP BY doc_id, size, source_size, target, k, ends, rnk
"""


def mixed(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """``docs``, all columns of any name, each row as often as the mix has it (0 to ``passes`` times).

    Rows are told apart by a number of their own, written with them, so repeated rows, ties and rows of null id or source
    have their own shares and no more than the mix is taken. Documents of no words (null and empty texts) come with the
    passes that end before the cut. No rows give none.
    """
    row, copies = "mix_row", "mix_copies"
    while any(c.lower() in (row, copies) for c in docs.columns):
        row, copies = row + "_", copies + "_"
    docs = staged(docs.withColumn(row, F.monotonically_increasing_id()), "mix-rows")
    plan = fair_mix(docs, id_col=id_col, source_col=source_col, text_col=text_col, row_col=row, **options)
    plan = plan.filter("copies > 0").select(F.col("row").alias(row), F.col("copies").alias(copies))
    joined = docs.join(plan.hint("merge"), row).withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies))))
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns if c != row])
