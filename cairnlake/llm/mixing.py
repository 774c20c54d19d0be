"""Mixing sources to target weights by Pfair scheduling, with DataFrame operations only.

Each source's documents, in doc_id order, form blocks of `block` documents. Weights are whole numbers a out of a period P. Block i
of a source is released at slot floor(i P / a) and due at slot ceil((i + 1) P / a); in each slot the released block with the
earliest deadline runs (equal ones by source). As the weights add up to P no deadline is missed, so after t slots every source is
less than one block from its share a t / P. The schedule repeats every P slots: one period is computed by an SQL aggregate over P
steps, and every block finds its slot by its number, with no further sequence. When a source is used up its slots stay empty, so
the others keep their ratio; positions count existing documents only.

No task holds a source: ranks come from a range sort by (source, doc_id), whose partitions are counted, and so does the order of
the blocks, a row for every `block` documents. On the driver is a row per source (weights need them) and one period of the schedule,
P rows, where P is at most twice the number of sources (PERIOD at least); what is broadcast is counted before.

Cases: a null source is a source of its own; null ids come first in their source; rows that repeat an id follow one another; an
empty table gives an empty result; a source without a weight gets the least one; texts aren't read by `mixed`; extra columns,
whatever their names, are ignored by it and stay in `in_mixed_order`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import carried, in_memory, uncarried, written

PERIOD = 1000
BLOCK = 32


def shares(counts: list[tuple[str, int]], weights: dict[str, float] | None = None, period: int = PERIOD) -> tuple[list[int], int]:
    """(a, P) for sources in order: at least 1 each, in proportion to the weights (by default to the square roots of their counts), largest remainders first."""
    period = max(period, 2 * len(counts))
    wanted = [round(1_000_000 * (n**0.5 if weights is None else weights.get(s, 0.0))) for s, n in counts]
    total, free = max(1, sum(wanted)), period - len(counts)
    part = [w * free // total for w in wanted]
    rest = sorted(range(len(counts)), key=lambda i: (-(wanted[i] * free % total), i))
    for i in rest[: free - sum(part)] if counts else []:
        part[i] += 1
    while counts and sum(part) < free:  # no weights at all
        part[part.index(min(part))] += 1
    return [p + 1 for p in part], period


def schedule(spark, a: list[int], period: int) -> DataFrame:
    """(s, nth: of the source's blocks in the period, slot) of one period, found by P steps over the sources."""
    w = f"array({', '.join(f'{x}L' for x in a)})"
    pick = f"""array_min(filter(transform({w}, (w, j) -> if(st.served[j] * {period}L div w <= t, named_struct('due', ((st.served[j] + 1) * {period}L + w - 1) div w, 's', j), null)), x -> x is not null)).s"""
    steps = spark.sql(f"""select aggregate(sequence(0L, {period - 1}L), named_struct('served', transform({w}, x -> 0L), 'picked', cast(array() as array<int>)),
        (st, t) -> transform(array({pick}), p -> named_struct('served', transform(st.served, (v, j) -> v + if(j = p, 1L, 0L)), 'picked', concat(st.picked, array(p))))[0]).picked as picked""")
    nth = F.row_number().over(Window.partitionBy("s").orderBy("slot")) - 1
    return steps.select(F.posexplode("picked").alias("slot", "s")).select("s", F.col("slot").cast("long").alias("slot"), nth.cast("long").alias("nth"))


def _held(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if in_memory(rows) else df


def _numbered(df: DataFrame, group: list[str], value, name: str) -> DataFrame:
    """df, a written table whose `at` (monotonically_increasing_id) follows its order, with the sum of `value` over the rows of its
    group before each. A row per group and task is summed up; within a task the sum runs along its rows."""
    task = df.withColumn("task", F.shiftright("at", 33)).withColumn("_value", value)
    along = Window.partitionBy(*group, "task").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*group).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    pieces = written(task.groupBy(*group, "task").agg(F.sum("_value").alias("_sum")).withColumn("_offset", F.coalesce(F.sum("_sum").over(earlier), none)).drop("_sum"))
    run = task.withColumn("_run", F.coalesce(F.sum("_value").over(along), none))
    return run.join(_held(pieces, pieces.count()), [*group, "task"]).withColumn(name, F.col("_offset") + F.col("_run")).drop("_value", "_run", "_offset", "task")


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, period: int = PERIOD, block: int = BLOCK) -> DataFrame:
    """One row per row of docs: doc_id, source, block (of the source), slot, position (0 to rows - 1 in the mixed order)."""
    spark = docs.sparkSession
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source")).withColumn("key", key)
    order = written(src.repartitionByRange("key", "doc_id").sortWithinPartitions("key", "doc_id").withColumn("at", F.monotonically_increasing_id()))
    counts = sorted((r.key, r.n) for r in order.groupBy("key").agg(F.count("*").alias("n")).collect())
    if not counts:
        return order.select("doc_id", "source", *[F.lit(0).cast("long").alias(c) for c in ("block", "slot", "position")])
    a, period = shares([(k[1:], n) for k, n in counts], weights, period)
    number = spark.createDataFrame([(k, i, n, w) for i, ((k, n), w) in enumerate(zip(counts, a, strict=True))], "key string, s int, n long, a long")
    # ids of a task follow one another, so a rank is what earlier tasks hold of its source and how far it is from the task's first
    pieces = order.withColumn("task", F.shiftright("at", 33)).groupBy("key", "task").agg(F.count("*").alias("rows"), F.min("at").alias("first"))
    earlier = Window.partitionBy("key").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    pieces = written(pieces.withColumn("offset", F.coalesce(F.sum("rows").over(earlier), F.lit(0).cast("long"))).drop("rows").join(_held(number, len(counts)), "key"))
    ranked = order.withColumn("task", F.shiftright("at", 33)).join(_held(pieces, pieces.count()), ["key", "task"]).withColumn("rank", F.expr("offset + at - first"))
    ranked = ranked.withColumn("block", F.expr(f"rank div {block}")).withColumn("inside", F.expr(f"rank % {block}"))
    # one row per block, in the order of slots
    blocks = ranked.where("inside = 0").withColumn("nth", F.expr("block % a")).join(_held(schedule(spark, a, period), period), ["s", "nth"])
    blocks = blocks.select("s", "block", F.expr(f"(block div a) * {period}L + slot").alias("slot"), F.expr(f"least({block}L, n - rank)").alias("size"))
    blocks = written(blocks.repartitionByRange("slot").sortWithinPartitions("slot").withColumn("at", F.monotonically_increasing_id()))
    placed = written(_numbered(blocks, [], F.col("size"), "ahead").select("s", "block", "slot", "ahead"))
    return ranked.join(_held(placed, placed.count()), ["s", "block"]).select("doc_id", "source", "block", "slot", (F.col("ahead") + F.col("inside")).alias("position"))


def in_mixed_order(docs: DataFrame, weights: dict[str, float] | None = None, period: int = PERIOD, block: int = BLOCK) -> DataFrame:
    """docs range-partitioned and sorted by mixed position, so that written files hold them in that order; all columns stay.

    doc_id says which row is which: of rows that repeat one, each takes the first of their positions, in any order."""
    places = written(mixed(docs, weights, period, block).groupBy(F.col("doc_id").alias("_doc")).agg(F.min("position").alias("_position")))
    whole = carried(docs, _id=F.col("doc_id").cast("long"))
    placed = whole.join(_held(places, places.count()), F.col("_id").eqNullSafe(F.col("_doc")), "left")
    return placed.repartitionByRange("_position").sortWithinPartitions("_position").transform(uncarried, docs.columns)
