"""Mixing sources to target weights with a low-discrepancy schedule.

Slot ``t`` of the mix has the point ``frac((t + 1) / golden ratio)``. Points
fall into the sources' cumulative shares, so every stretch of the schedule has
each source close to its share. Slots are ranked per source; the r-th slot of
a source takes block ``r mod blocks`` of the source's shuffled text, where all
blocks hold the same number of words (the last of a source may hold fewer).
What the schedule's resolution leaves over is settled: a source's last slot is
cut, or slots for its next blocks are added at the end, so that the words taken
of each source are its target, rounded to a whole number, at any total.

Nulls: a null source is a source of its own and sorts last; a null or empty
text has size 0 and is taken 0 times; a null doc_id is an id like any other.
Ties: documents of equal hash follow each other in the order of their row
numbers. Repeated rows, and rows that share a doc_id, are separate documents.
A very long text is cut by blocks, never by length: its words fall into as
many blocks as they fill. An empty table gives an empty mix. Other columns of
the input are ignored, whatever their names and types; the stage returns them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, numbered, running_sum, texts_of, unit_hash, word_count

GOLDEN = 0.6180339887498949
#: Slots of the whole schedule; a block holds the words of one slot.
SLOTS = 1 << 18
#: Ranks are counted in stretches of the schedule of this length.
STRETCH = 4096
#: Cells into which the unit interval is cut to look up a point's source.
CELLS = 4096
#: Documents in one ordering bucket of a source's shuffle.
BUCKET = 4_000


def source_targets(sized: DataFrame, weights: tuple[int, ...], max_repeats: int) -> DataFrame:
    """One row per source: src (its rank), source_size, n_docs, target, lo, hi.

    A target is a share by weight of all words, but at most ``max_repeats``
    times the source's words; what is cut off is shared again by weight. That
    fixed point is a water level: sources are sorted by cap over weight, and
    the level is the first at which the remaining sources stay below their cap.
    """
    sources = sized.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count("*").alias("n_docs")
    )
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    sources = sources.withColumn("src", rank).withColumn(
        "w", F.element_at(cycle, (F.col("src") % len(weights) + 1).cast("int"))
    )
    sources = sources.withColumn("cap", F.lit(float(max_repeats)) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), "src")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(onward)
    sources = sources.withColumn("level", level)
    fits = F.when(F.col("cap") / F.col("w") >= F.col("level"), F.col("level"))
    # From the fixed point on levels only fall, so the first that fits is the largest that fits.
    sources = sources.withColumn("level", F.max(fits).over(everything))
    sources = sources.withColumn(
        "target", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("w"), F.col("cap")))
    )
    total = F.sum("target").over(everything)
    up_to = Window.orderBy("src").rowsBetween(Window.unboundedPreceding, 0)
    hi = F.when(total > 0, F.sum("target").over(up_to) / total).otherwise(F.lit(0.0))
    sources = sources.withColumn("hi", hi)
    lo = F.coalesce(F.lag("hi").over(Window.orderBy("src")), F.lit(0.0))
    return sources.withColumn("lo", lo).select(
        "source", "src", "source_size", "n_docs", "target", "lo", "hi"
    )


def slot_schedule(sources: DataFrame, total: int, block: int) -> DataFrame:
    """The mix in order: slot, src, block, pass (how often the source ran through before), words (taken of the block)."""
    spark = sources.sparkSession
    n_slots = round(total / block)
    slots = spark.range(n_slots).select(
        F.col("id").alias("slot"), (((F.col("id") + 1) * GOLDEN) % 1.0).alias("x")
    )
    slots = slots.withColumn("cell", F.floor(F.col("x") * CELLS))
    first, last = F.floor(F.col("lo") * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1))
    shares = sources.filter("hi > lo").select(
        "src", "lo", "hi", F.explode(F.sequence(first, last)).alias("cell"),
    )
    slots = slots.join(shares, "cell").filter("x >= lo and x < hi").select("slot", "src")
    slots = slots.withColumn("stretch", F.floor(F.col("slot") / STRETCH)).withColumn("one", F.lit(1))
    slots = materialize(
        running_sum(slots, ["src"], [F.col("slot")], ["stretch"], "one", "rank").select("slot", "src", "rank"), "mix-slots"
    )

    # Passes and the words of the last, partial one; a source is passed over max_repeats times at most, as its target is.
    size, quota = F.greatest(F.col("source_size"), F.lit(1)), F.floor(F.col("target") + 0.5)
    plan = sources.filter("source_size > 0").select("src", size.alias("size"), quota.alias("quota"))
    plan = plan.withColumn("rest", F.col("quota") % F.col("size")).withColumn("blocks", F.expr(f"(size + {block - 1}) div {block}"))
    plan = plan.withColumn("passes", F.expr("(quota - rest) div size"))
    plan = plan.withColumn("need", F.expr(f"passes * blocks + (rest + {block - 1}) div {block}"))
    have = slots.groupBy("src").agg(F.count("*").alias("have"))
    short = plan.join(have, "src", "left").withColumn("have", F.coalesce("have", F.lit(0).cast("long"))).filter("have < need")
    short = short.select("src", F.explode(F.sequence(F.col("have"), F.col("need") - 1)).alias("rank"))
    added = F.row_number().over(Window.orderBy("rank", "src")) - 1 + n_slots
    slots = slots.unionByName(short.select(added.cast("long").alias("slot"), "src", "rank"))

    slots = slots.join(plan, "src").filter("rank < need")
    slots = slots.withColumn("block", F.col("rank") % F.col("blocks")).withColumn("pass", F.expr("rank div blocks"))
    until = F.when(F.col("pass") < F.col("passes"), F.col("size")).otherwise(F.col("rest"))
    words = F.least(F.lit(block), until - F.col("block") * block)
    return slots.select("slot", "src", "block", "pass", words.alias("words"))


def mix_sources(
    docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3, seed: int = 7, slots: int = SLOTS, row_id: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """Mix ``docs`` (doc_id, source, text, …) and return (documents, schedule).

    documents: row_id, doc_id, source, size, source_size, target, taken (words
    of the document in the mix, repeats counted). schedule: see
    ``slot_schedule``. ``row_id`` tells rows apart; rows are numbered without
    it. Reruns over the same files agree.
    """
    sized = materialize(
        docs.select(
            (F.monotonically_increasing_id() if row_id is None else row_id).alias("row_id"), "doc_id", "source",
            F.xxhash64(F.col("text")).alias("text_hash"), word_count(F.col("text")).alias("size"),
        ),
        "mix-sizes",
    )
    sources = materialize(source_targets(sized, weights, max_repeats), "mix-sources")
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    block = max(1, -(-total // slots))
    schedule = materialize(slot_schedule(sources, total, block), "mix-schedule")
    uses = schedule.groupBy("src", "block", "words").agg(F.count("*").alias("uses"))

    known = sized.join(sources, sized.source.eqNullSafe(sources.source)).drop(sources.source)
    order = unit_hash(F.col("doc_id"), F.col("text_hash"), F.lit(seed))
    known = known.withColumn("u", order).withColumn(
        "bucket", F.floor(F.col("u") * F.ceil(F.col("n_docs") / BUCKET))
    )
    # Copies under one doc_id share their hash; where they overfill a bucket, they are dealt on by row.
    full = known.groupBy("src", "bucket").agg(F.count("*").alias("rows")).filter(F.col("rows") > 2 * BUCKET)
    known = known.join(full, ["src", "bucket"], "left").withColumn(
        "part", F.pmod(F.xxhash64("row_id"), F.coalesce(F.ceil(F.col("rows") / BUCKET), F.lit(1)))
    )
    placed = running_sum(known, ["src"], [F.col("u"), F.col("row_id")], ["bucket", "part"], "size", "begin")
    placed = materialize(placed.drop("bucket", "part", "rows", "u", "text_hash", "lo", "hi", "n_docs"), "mix-placed")
    end = F.col("begin") + F.col("size")
    pieces = placed.filter("size > 0").select(
        "row_id", "src", "begin", end.alias("end"),
        F.explode(F.sequence(F.floor(F.col("begin") / block), F.floor((end - 1) / block))).alias("block"),
    )
    until = F.least(F.col("end"), F.col("block") * block + F.col("words"))
    part = F.greatest(until - F.greatest(F.col("begin"), F.col("block") * block), F.lit(0))
    taken = (
        pieces.join(uses, ["src", "block"])
        .groupBy("row_id")
        .agg(F.sum(part * F.col("uses")).alias("taken"))
    )
    mixed = placed.join(taken, "row_id", "left").withColumn(
        "taken", F.coalesce(F.col("taken"), F.lit(0)).cast("long")
    )
    return mixed, schedule


def op1_mix_sources(spark, sf_dir: str) -> DataFrame:
    """All documents with the words that the mix takes of each."""
    mixed, _ = mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select(
        "doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), "taken"
    )


def stage_mix(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, to the nearest whole number.

    Documents without words carry no weight and stay once.
    """
    rows = numbered(docs, "mix-rows")
    mixed, _ = mix_sources(texts_of(rows, "doc_id", "source", "text"), row_id=F.col("row_id"))
    copies = F.when(F.col("size") == 0, 1).otherwise(F.floor(F.col("taken") / F.col("size") + 0.5)).cast("int")
    plan = mixed.select("row_id", copies.alias("copies")).filter("copies > 0")
    out = rows.join(plan, "row_id").select("doc", F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("copy"))
    return out.select("doc.*")
