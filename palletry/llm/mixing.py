"""Mixing sources to target weights along a time-varying curriculum (DataFrame operations only).

Every source has a weight and a schedule, a piecewise linear rate over training time 0..1. Targets come from the
weights (water filling under a cap of `max_epochs` times a source's size). A source's schedule is integrated and scaled
to its target, which gives its cumulative demand in words. Documents stand in a fixed pseudo-random order inside their
source; a document's place is the time at which the demand reaches the words before it. The mix is range-sorted by it.

Prefix sums of a source use two levels, about sqrt(rows) buckets of about sqrt(rows) rows, so that a source with a third
of all rows is not one task. The last document of a source is taken in part, hence the taken words equal the target
but for rounding. Sources without words have target 0.

The mix itself moves whole texts once: a source is cut into slots of documents that follow each other in its order. The
times between which a slot's documents come tell, before any shuffle, the ranges of time to which a text goes: one, but
for the few slots that a cut between ranges falls into, whose texts go to both sides. Rows of the plan go to the range of
their exact position and say how often a document is used; each range is then sorted by position, texts without a row
of the plan are dropped.

Defined results: null text has no words; sources go by code point and null last; repeated rows each count, and if the mix
takes only some of the rows that agree in id, text and source, it doesn't matter which; a null id orders like the empty
string; an empty table gives an empty plan and an empty mix; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from palletry.llm.common import row_key, written

WORD = r"[^\x20\x09-\x0D]+"
#: Weight and schedule knots (time, rate) of the first source, the second and so on, repeating.
CURRICULUM = (
    (5.0, ((0.0, 1.5), (1.0, 0.5))),
    (2.0, ((0.0, 1.0), (1.0, 1.0))),
    (1.0, ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5))),
)
#: Slots for each range of time, shared out among the sources, and what may be broadcast.
SLOTS_A_RANGE, BROADCAST_ROWS = 64, 2_000_000


def sized(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", same: bool = False) -> DataFrame:
    """(id, row, source, size, key) as a written table and, if wanted, `same`, which tells other ids and texts apart.

    `key` is the pseudo-random order of documents."""
    return written(
        docs.select(
            F.col(id_col).alias("id"),
            F.monotonically_increasing_id().alias("row"),
            F.col(source_col).alias("source"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            order_key(F.col(id_col)).alias("key"),
            *([row_key(F.col(id_col), F.col(text_col)).alias("same")] if same else []),
        ),
        "sizes",
    )


def order_key(id_value: Column) -> Column:
    return F.md5(F.coalesce(id_value.cast("string"), F.lit("")))


def part_of(key: Column, parts: Column) -> Column:
    """Which of `parts` equal parts of a source's order a document's key falls into."""
    return F.floor(F.conv(F.substring(key, 1, 8), 16, 10).cast("long") * parts / F.lit(float(2**32)))


def targets(sizes: DataFrame, curriculum=CURRICULUM, share: float = 1.5, max_epochs: int = 2) -> DataFrame:
    """(source, nth, n_rows, source_size, target) by source.

    Sources in order of cap/weight: those at the front stop at their caps, the first whose share of the rest stays
    below its cap fixes the level for all that follow. This is where repeated resharing of the excess ends.
    """
    weights = F.array(*[F.lit(w) for w, _ in curriculum])
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    s = s.withColumn("nth", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    s = s.withColumn("weight", F.element_at(weights, (F.col("nth") % len(curriculum) + 1).cast("int")))
    cap = F.col("source_size") * max_epochs
    order = Window.orderBy(cap / F.col("weight"), "nth")
    everything = Window.partitionBy()
    s = s.withColumns(
        {
            "cap": cap,
            "left": F.sum("source_size").over(everything) * share - F.coalesce(F.sum(cap).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "weights_left": F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)),
        }
    )
    level = F.col("left") / F.col("weights_left")
    s = s.withColumn("place", F.row_number().over(order))
    first = F.min(F.when(level * F.col("weight") <= F.col("cap"), F.struct("place", level.alias("level")))).over(everything)
    s = s.withColumn("level", first["level"])
    s = s.withColumn("target", F.when(F.col("level").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight"))))
    return s.select("source", "nth", "n_rows", "source_size", "target")


def time_of(part: Column, nth: Column, curriculum=CURRICULUM) -> Column:
    """The training time at which a source has demanded `part` (0..1) of its target: the inverse of its integral."""
    out = F.lit(None).cast("double")
    for i, (_, knots) in enumerate(curriculum):
        area = sum((t1 - t0) * (r0 + r1) / 2 for (t0, r0), (t1, r1) in zip(knots, knots[1:]))
        before, chain = 0.0, None
        for (t0, r0), (t1, r1) in zip(knots, knots[1:]):
            slope = (r1 - r0) / (t1 - t0)
            x = part * area - before
            inside = x / r0 if slope == 0 else (F.sqrt(F.greatest(F.lit(r0 * r0) + x * (2 * slope), F.lit(0.0))) - r0) / slope
            before += (t1 - t0) * (r0 + r1) / 2
            here, upto = F.lit(t0) + inside, part * area <= before
            chain = F.when(upto, here) if chain is None else chain.when(upto, here)
        out = F.when(nth % len(curriculum) == i, chain.otherwise(F.lit(knots[-1][0]))).otherwise(out)
    return out


def placed(sizes: DataFrame, by_source: DataFrame) -> DataFrame:
    """`sizes` with the columns of its source in `by_source` and `before`, the words ahead in one pass over the source."""
    d = sizes.join(by_source.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    d = d.withColumn("bucket", part_of(F.col("key"), F.ceil(F.sqrt("n_rows"))))
    sums = d.groupBy("nth", "bucket").agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("nth").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("nth", "bucket", F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("base"))
    inside = Window.partitionBy("nth", "bucket").orderBy("key", "id", "row").rowsBetween(Window.unboundedPreceding, -1)
    return d.join(sums, ["nth", "bucket"]).withColumn("before", F.col("base") + F.coalesce(F.sum("size").over(inside), F.lit(0)))


def mix_plan(docs: DataFrame, curriculum=CURRICULUM, share: float = 1.5, max_epochs: int = 2, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(id, row, key, size, source_size, target, before, taken, position, nth): one row for each input row.

    `before`: words ahead of the document in one pass over its source. `taken`: words the mix takes of it, repeats
    counted. `position`: the time of its first use, null if it isn't used.
    """
    sizes = sized(docs, id_col, source_col, text_col)
    d = placed(sizes, written(targets(sizes, curriculum, share, max_epochs), "targets"))
    whole = F.round("target").cast("long")
    taken = sum((F.greatest(F.lit(0), F.least(F.col("size"), whole - F.col("before") - F.col("source_size") * e)) for e in range(max_epochs)), F.lit(0))
    d = d.withColumn("taken", taken.cast("long"))
    position = F.when(F.col("taken") > 0, F.round(time_of(F.col("before") / F.col("target"), F.col("nth"), curriculum), 6))
    return d.select("id", "row", "key", "size", "source_size", "target", "before", "taken", position.alias("position"), "nth")


def _fraction(key: Column) -> Column:
    """Where a key stands among all keys, from 0 to 1."""
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("long") / F.lit(float(2**32))


def slotted(sizes: DataFrame, by_source: DataFrame, max_epochs: int, curriculum) -> DataFrame:
    """(nth, slot, use, first, start, end): a row for each slot and use, with the words ahead and the times between which the
    slot's documents come then. `by_source` has the number of each source's slots.
    """
    d = sizes.join(by_source.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    words = d.groupBy("nth", part_of(F.col("key"), F.col("slots")).alias("slot")).agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("nth").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    words = words.withColumn("base", F.coalesce(F.sum("words").over(ahead), F.lit(0))).join(by_source.drop("source"), "nth")
    words = words.withColumn("use", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1)))).withColumn("first", F.col("base") + F.col("use") * F.col("source_size"))
    at = lambda before, fraction: _time(before, F.col("target"), fraction, F.col("nth"), curriculum)
    return words.select("nth", "slot", "use", "first", at(F.col("first"), F.col("slot") / F.col("slots")).alias("start"), at(F.col("first") + F.col("words"), (F.col("slot") + 1) / F.col("slots")).alias("end"))


def _time(before: Column, target: Column, fraction: Column, nth: Column, curriculum) -> Column:
    """When a source has demanded the words `before`; a source without target, which has no words, spreads by its keys."""
    part = F.least(before / F.nullif(target, F.lit(0.0)), F.lit(1.0))
    return F.when(target > 0, time_of(part, nth, curriculum)).otherwise(fraction)


def _small(df: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it has at most `BROADCAST_ROWS` rows of numbers."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def mixed_documents(docs: DataFrame, curriculum=CURRICULUM, share: float = 1.5, max_epochs: int = 2, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", slots: int | None = None) -> DataFrame:
    """The mix itself: whole documents, as often as the mix takes them, in the order of their exact training positions.

    A document that the mix takes in part comes once more if at least half of that copy is taken; one without words comes
    once. Rows that agree in id, text and source stand together, where the first of them belongs. The number of `slots`
    (`SLOTS_A_RANGE` for each range of time, unless given) changes how many texts are sent twice, not the result.
    """
    spark = docs.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = sized(docs, id_col, source_col, text_col, same=True)
    goals = written(targets(sizes, curriculum, share, max_epochs), "targets")
    total = F.sum("n_rows").over(Window.partitionBy())
    by_source = written(goals.withColumn("slots", F.ceil(F.col("n_rows") * (slots or SLOTS_A_RANGE * ranges) / total)), "sources")
    times = written(slotted(sizes, by_source, max_epochs, curriculum), "slots")
    cuts = times.agg(F.percentile_approx("start", [i / ranges for i in range(1, ranges)] or [0.5], 10 * ranges).alias("c")).first().c  # a number a range
    cuts = F.array(*[F.lit(c) for c in sorted(set(cuts or []))]).cast("array<double>")
    upto = lambda some, t: F.size(F.filter(some, lambda c: c <= t))
    times = _small(written(times.withColumns({"low": upto(cuts, F.col("start")), "high": upto(cuts, F.greatest("start", "end"))}).drop("start", "end"), "ranges"))

    plan = placed(sizes, goals).join(_small(by_source.select("nth", "slots")), "nth")
    plan = plan.withColumn("slot", part_of(F.col("key"), F.col("slots"))).join(times, ["nth", "slot"])
    before = F.col("before") + F.col("use") * F.col("source_size")
    plan = plan.where(F.when(F.col("size") == 0, F.col("use") == 0).otherwise(before + F.col("size") / 2 <= F.col("target")))
    plan = plan.withColumn("position", _time(before, F.col("target"), _fraction(F.col("key")), F.col("nth"), curriculum))
    plan = plan.groupBy("nth", "key", "same", "use").agg(F.count("*").alias("used"), F.min("position").alias("position"), F.first("low").alias("low"), F.first("high").alias("high"))
    inside = upto(F.slice(cuts, F.col("low") + 1, F.col("high") - F.col("low")), F.col("position"))
    plan = written(plan.select((F.col("low") + inside).alias("range"), "nth", "key", "same", "use", "used", "position"), "uses")

    doc = F.struct(*docs.columns).alias("doc")  # so no column can clash
    rows = docs.select(doc).join(_small(by_source.select("source", "nth", "slots", "target")), F.col("doc")[source_col].eqNullSafe(F.col("source")))
    rows = rows.withColumn("key", order_key(F.col("doc")[id_col]))
    rows = rows.withColumn("slot", part_of(F.col("key"), F.col("slots"))).join(times, ["nth", "slot"])
    wordless = ~F.coalesce(F.col("doc")[text_col].rlike(WORD), F.lit(False))
    rows = rows.where((F.col("first") <= F.col("target")) | (wordless & (F.col("use") == 0)))
    each = F.explode(F.sequence("low", "high")).alias("range")
    rows = rows.select(each, "nth", "key", row_key(F.col("doc")[id_col], F.col("doc")[text_col]).alias("same"), "use", F.lit(None).cast("long").alias("used"), F.lit(None).cast("double").alias("position"), "doc")
    both = rows.unionByName(plan, allowMissingColumns=True).repartitionByRange(ranges, "range")
    alike = Window.partitionBy("range", "nth", "key", "same", "use").orderBy(F.col("used").desc_nulls_last())
    both = both.withColumns({"most": F.first("used").over(alike), "copy": F.row_number().over(alike) - 1, "position": F.first("position").over(alike)})
    used = both.where((F.col("copy") > 0) & (F.col("copy") <= F.col("most")))
    return used.sortWithinPartitions("range", "position", "nth", "key", "same", "use").select("doc.*")
