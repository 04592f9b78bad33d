"""Sharding by a k-d tree over metadata; DataFrame operations only.

A node is split at the weighted median of its widest metadata dimension until
leaves are down to the target bytes. Dimensions are the logarithm of the size,
the source and the language, each measured against its spread over all rows.
The median is found by two histograms, of places and of hashes within a place.
What is known of a level is one row for each node, joined to the units by the
node: as a broadcast while a level has ``NODES`` nodes at most, as a written
table beyond, so neither the driver nor a plan holds the tree.

Equal texts are one unit of the tree: a cut falls between units, at the edge
that is nearest to the median. Only where that edge would leave a half off by
more than ``TOLERANCE`` of itself is the unit at the median cut, its rows going
to either side in hash order, so that even a third of all rows in one group
leaves the shards equal.

Nulls: a null text counts as empty (size 1, CRC 0); a null source or language
comes before all others; a null doc_id is an id like any other. Ties: units of
one place follow each other by the hash of their text. Repeated rows, and rows
that share a doc_id, are separate rows. A very long text is one row of its
bytes, which may alone outweigh a shard. An empty table gives no rows. Other
columns are ignored, whatever their names and types; the stage returns them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, numbered, quoted, running_sum, texts_of, unit_hash

#: Bins of one histogram; medians are found by refining bins.
BINS = 1 << 16
#: Histograms of one median: one of the place, one of the hash.
DIGITS = 2
#: Nodes of a level, one row each, that are broadcast.
NODES = 1 << 12
#: Share of a half that may be off before a group of equal texts is cut.
TOLERANCE = 0.01
#: Rows in one numbering bucket of a shard.
BUCKET = 4_000


def _bins(at: Column, tie: Column) -> list[Column]:
    """Digits, base BINS, that order units by place and then by hash."""
    return [F.floor(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0 - 1e-12)) * BINS).cast("int") for x in (at, tie)]


def kd_leaves(units: DataFrame, dims: list[str], target_bytes: float) -> tuple[DataFrame, int]:
    """Give each unit (dims, tie, n, bytes) a leaf and the share of it that goes there.

    ``tie`` is in [0, 1) and differs between units. Returns (units with leaf,
    from_u, to_u; number of leaves): the rows of a unit whose own hash lies in
    [from_u, to_u) belong to the leaf. An uncut unit has one row, [0, 1).
    """
    edges = [f(d).alias(f"{k}_{d}") for d in dims for k, f in (("lo", F.min), ("hi", F.max))]
    whole = units.agg(F.sum("bytes").alias("w"), *edges).first()
    now = units.select("*", F.lit(0).cast("long").alias("leaf"), F.lit(0.0).alias("from_u"), F.lit(1.0).alias("to_u"))
    if not whole["w"]:
        return now, 1
    levels = max(0, math.ceil(math.log2(max(1.0, whole["w"] / target_bytes)) - 1e-9))
    span = {d: float(whole[f"hi_{d}"] - whole[f"lo_{d}"]) or 1.0 for d in dims}
    names = [c for c in now.columns if c not in ("leaf", "from_u", "to_u")]
    weight = F.col("bytes") * (F.col("to_u") - F.col("from_u"))
    digits = [f"b{i}" for i in range(DIGITS)]
    for level in range(levels):

        def held(known: DataFrame, tag: str, nodes: int = 1 << level) -> DataFrame:
            return F.broadcast(known) if nodes <= NODES else materialize(known, tag)

        # One row for each node: its widest dimension, and what is known of its median so far.
        wide = [
            F.struct(
                ((F.col(f"hi_{d}") - F.col(f"lo_{d}")) / span[d]).alias("width"), F.lit(-i).alias("dim"), F.col(f"lo_{d}").cast("double").alias("low"),
                (F.col(f"hi_{d}") - F.col(f"lo_{d}")).cast("double").alias("range"),
            )
            for i, d in enumerate(dims)
        ]
        known = now.groupBy("leaf").agg(F.sum(weight).alias("w"), *edges).withColumn("best", F.array_max(F.array(*wide)))
        known = known.select(
            "leaf", (F.col("w") / 2).alias("half"), F.lit(0.0).alias("base"), (-F.col("best.dim")).alias("dim"), F.col("best.low").alias("low"),
            F.when(F.col("best.range") > 0, F.col("best.range")).otherwise(1.0).alias("range"),
        )
        known = held(known, "shard-nodes")
        value = F.element_at(F.array(*[F.col(d).cast("double") for d in dims]), F.col("dim") + 1)
        place = [b.alias(n) for b, n in zip(_bins((value - F.col("low")) / F.col("range"), F.col("tie")), digits)]

        def found(known: DataFrame, now: DataFrame = now, value: Column = value, place: list[Column] = place) -> DataFrame:
            """Units with what is known of their node, their place and their weight."""
            return now.join(known, "leaf").select("*", *place, value.alias("v"), weight.alias("own"))

        keep = ["leaf", "half", "dim", "low", "range"]
        for i, digit in enumerate(digits):
            here = found(known)
            for b in digits[:i]:
                here = here.filter(F.col(b) == F.col(f"cut_{b}"))
            cuts = [f"cut_{b}" for b in digits[:i]]
            bins = here.groupBy(*keep, "base", *cuts, digit).agg(F.sum("own").alias("own"))
            at = Window.partitionBy("leaf").orderBy(digit)
            bins = bins.withColumns({"until": F.sum("own").over(at.rowsBetween(Window.unboundedPreceding, 0)), "next": F.lead(digit).over(at)})
            bins = bins.filter((F.col("base") + F.col("until") >= F.col("half")) | F.col("next").isNull())
            first = F.row_number().over(Window.partitionBy("leaf").orderBy(digit))
            known = bins.withColumn("place", first).filter("place = 1").select(
                *keep, (F.col("base") + F.col("until") - F.col("own")).alias("base"), *cuts, F.col(digit).alias(f"cut_{digit}")
            )
            known = held(known, "shard-cut")
        # Few units are left at the median: find the edge nearest to it, or the unit to cut.
        here = found(known)
        for b in digits:
            here = here.filter(F.col(b) == F.col(f"cut_{b}"))
        at = Window.partitionBy("leaf").orderBy("v", "tie")
        here = here.withColumns({"until": F.sum("own").over(at.rowsBetween(Window.unboundedPreceding, 0)), "next": F.lead("tie").over(at)})
        here = here.filter((F.col("base") + F.col("until") >= F.col("half")) | F.col("next").isNull())
        here = here.withColumn("place", F.row_number().over(at)).filter("place = 1")
        ahead = (F.col("half") - F.col("base") - F.col("until") + F.col("own")) / F.col("own")
        here = here.withColumn("share", F.greatest(F.least(F.when(F.col("own") > 0, ahead).otherwise(1.0), F.lit(1.0)), F.lit(0.0)))
        off = F.least("share", 1 - F.col("share")) * F.col("own")
        share = F.when(off > TOLERANCE * F.col("half"), F.col("share")).otherwise(F.when(F.col("share") >= 0.5, 1.0).otherwise(0.0))
        known = held(here.select(*keep, *[f"cut_{b}" for b in digits], F.col("v").alias("cut_v"), F.col("tie").alias("cut_tie"), share.alias("share")), "shard-edge")

        order = F.struct(*digits, "v", "tie")
        edge = F.struct(*[F.col(f"cut_{b}").alias(b) for b in digits], F.col("cut_v").alias("v"), F.col("cut_tie").alias("tie"))
        middle = F.col("from_u") + (F.col("to_u") - F.col("from_u")) * F.col("share")

        def piece(side: int, begin: Column, end: Column) -> Column:
            return F.struct(F.lit(side).alias("side"), begin.alias("f"), end.alias("t"))

        split = F.when(order < edge, F.array(piece(0, F.col("from_u"), F.col("to_u"))))
        split = split.when(order > edge, F.array(piece(1, F.col("from_u"), F.col("to_u"))))
        split = split.otherwise(F.filter(F.array(piece(0, F.col("from_u"), middle), piece(1, middle, F.col("to_u"))), lambda s: s["f"] < s["t"]))
        now = found(known).withColumn("piece", F.explode(split)).select(
            *names, (F.col("leaf") * 2 + F.col("piece.side")).alias("leaf"), F.col("piece.f").alias("from_u"), F.col("piece.t").alias("to_u")
        )
        now = materialize(now, f"shard-level{level}")
    return now, 1 << levels


def _spelled(text: Column) -> Column:
    """A number that orders texts as their first six bytes do; 0 for null."""
    start = F.rpad(F.hex(F.substring(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), 1, 6)), 12, "0")
    return F.conv(start, 16, 10).cast("double")


def shard_documents(docs: DataFrame, shards: int = 8, row_id: Column | None = None, metadata: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """row_id, doc_id, size, text_crc32, shard, slot for all rows of ``docs``.

    ``shards`` (a power of two) sets the target bytes of a leaf. ``row_id``
    tells rows apart; rows are numbered without it. Dimensions besides the size
    are the columns of ``metadata`` that there are; a group of equal texts has
    the least value of its rows.
    """
    if shards < 1 or shards & (shards - 1):
        raise ValueError("shards must be a power of two")
    text = F.coalesce(F.col("text"), F.lit(""))
    known = [c for c in metadata if c in docs.columns]
    dims = [f"d_{i}" for i in range(len(known))]
    rows = materialize(
        docs.select(
            (F.monotonically_increasing_id() if row_id is None else row_id).alias("row_id"), "doc_id",
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            F.xxhash64(text).alias("text_hash"),
            *[_spelled(quoted(c).cast("string")).alias(f"d_{i}") for i, c in enumerate(known)],
        ),
        "shard-rows",
    )
    unit = ["size", "text_crc32", "text_hash"]
    units = rows.groupBy(*unit).agg(F.sum("size").alias("bytes"), *[F.min(d).alias(d) for d in dims])
    units = units.select("*", F.log2(F.col("size")).alias("d_size"), unit_hash(F.col("text_hash"), F.col("text_crc32"), F.col("size")).alias("tie"))
    units = materialize(units, "shard-units")
    total = units.agg(F.sum("bytes")).first()[0] or 0
    leaves, _ = kd_leaves(units, ["d_size", *dims], max(1.0, total / shards))
    leaves = leaves.select(*unit, "leaf", "from_u", "to_u")
    rows = rows.drop(*dims).withColumn("_h", unit_hash(F.col("row_id"), F.col("doc_id")))
    # Rows of a cut unit are ranked in hash order, so that each side gets its exact share of them; a node cuts one unit at most.
    cut = leaves.filter("from_u > 0 or to_u < 1").select(*unit).distinct().join(units.select(*unit, (F.col("bytes") / F.col("size")).alias("_n")), unit)
    cut = materialize(cut, "shard-cut")
    hot = rows.join(cut, unit).withColumns({"_bucket": F.floor(F.col("_h") * F.ceil(F.col("_n") / BUCKET)), "_one": F.lit(1).cast("long")})
    hot = running_sum(hot, unit, [F.col("_h"), F.col("row_id")], ["_bucket"], "_one", "_rank")
    hot = hot.withColumn("_u", (F.col("_rank") + 0.5) / F.col("_n")).drop("_bucket", "_one", "_rank", "_n")
    pieces = materialize(leaves.join(cut.select(*unit), unit, "left_semi"), "shard-pieces")
    hot = hot.join(pieces, unit).filter("_u >= from_u and _u < to_u").drop("_u", "from_u", "to_u")
    rest = rows.join(cut, unit, "left_anti").join(leaves.drop("from_u", "to_u"), unit)
    placed = rest.unionByName(hot).withColumnRenamed("leaf", "shard")
    placed = materialize(placed, "shard-placed")
    n = placed.count()
    placed = placed.withColumn("_bucket", F.floor(F.col("_h") * max(1, math.ceil(n / shards / BUCKET))))
    placed = placed.withColumn("_one", F.lit(1).cast("long"))
    placed = running_sum(placed, ["shard"], [F.col("_h"), F.col("row_id")], ["_bucket"], "_one", "slot")
    return placed.select("row_id", "doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"))


def op7_shard_documents(spark, sf_dir: str) -> DataFrame:
    """All documents in 8 shards of nearly equal bytes."""
    placed = shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def stage_shard(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with shard and slot; columns of those names are replaced."""
    docs = docs.select(*[quoted(c) for c in docs.columns if c.lower() not in ("shard", "slot")])
    rows = numbered(docs, "shard-docs")
    placed = shard_documents(texts_of(rows, "doc_id", "source", "lang", "text"), row_id=F.col("row_id"))
    return rows.join(placed.select("row_id", "shard", "slot"), "row_id").select("doc.*", "shard", "slot")
