"""Sharding: contiguous shards of near equal bytes by global prefix sums.

Method
    Rows are dealt into ranges of the order (id, crc32, size) and written as (place in the order,
    size), without their texts. The ranges' totals, one row for each, give the offset of each range;
    within a range a running sum gives every row the bytes and rows before it. With the total T, a
    row goes to the shard that the middle of its bytes falls into when [0, T) is cut at equal
    targets. Shards are therefore contiguous, and each is within half a row of its target on
    either side.

    Equal rows are first counted, so a row that very often repeats is one row with a count until its
    place is known, and is unfolded in blocks of BLOCK. A range is one task's input and holds rows of
    some 40 bytes; ranges are as many as the input's bytes ask for. One id that many rows share is dealt
    out by crc32 and size.

Defined results
    * null texts have size 1 and crc32 0; so have empty texts.
    * null ids come first in the order; equal rows take successive slots.
    * with fewer rows than shards some shards stay empty; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import ids_and_texts, ranges, written


#: Repeats of one row that are unfolded at a time.
BLOCK = 100_000


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard), one row for each row of docs."""
    spark = docs.sparkSession
    raw = F.encode(F.col("text"), "UTF-8")
    rows = ids_and_texts(docs, id_col, text_col).select(
        "id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
        F.coalesce(F.crc32(raw), F.lit(0)).cast("long").alias("crc"),
    )
    parts = ranges(docs)
    rows = written(rows.groupBy("id", "crc", "size").agg(F.count(F.lit(1)).alias("times")), "sizes")
    rows = rows.repartitionByRange(parts, "id", "crc", "size").sortWithinPartitions("id", "crc", "size")
    ranged = written(rows.withColumn("range", F.spark_partition_id()), "ranges")

    # one row for each range
    totals = {r[0]: (r[1], r[2]) for r in ranged.groupBy("range").agg(F.sum(F.col("size") * F.col("times")), F.sum("times")).collect()}
    before, total, count = {}, 0, 0
    for r in sorted(totals):
        before[r] = (total, count)
        total, count = total + totals[r][0], count + totals[r][1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Running sums of each range, whose rows come in order, in successive batches."""
        sums: dict[int, tuple[int, int]] = {}
        for batch in batches:
            size, times, own = (batch.column(i).to_numpy() for i in (2, 3, 4))
            lead, place = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
            for r in np.unique(own).tolist():
                at = np.flatnonzero(own == r)
                b, n = sums.get(r, before[r])
                ends, places = b + np.cumsum(size[at] * times[at]), n + np.cumsum(times[at])
                lead[at], place[at] = ends - size[at] * times[at], places - times[at]
                sums[r] = (int(ends[-1]), int(places[-1]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(lead), pa.array(place)], ["id", "crc", "size", "times", "lead", "place"])

    # each range is one partition again, in its order
    regrouped = ranged.repartition(max(1, len(totals)), "range").sortWithinPartitions("range", "id", "crc", "size")
    placed = regrouped.select("id", "crc", "size", "times", "range").mapInArrow(run, "id long, crc long, size long, times long, lead long, place long")
    placed = written(placed, "offsets")
    # a row that repeats very often is unfolded in blocks, which other tasks take
    often = placed.filter(F.col("times") > BLOCK)
    blocks = often.withColumn("from", F.explode(F.expr(f"sequence(0L, times - 1, {BLOCK}L)"))).repartition(parts)
    once = placed.filter(F.col("times") <= BLOCK).withColumn("from", F.lit(0).cast("long"))
    placed = once.union(blocks).withColumn("i", F.explode(F.expr(f"sequence(from, least(from + {BLOCK}L, times) - 1)")))
    placed = placed.select("id", "crc", "size", (F.col("lead") + F.col("i") * F.col("size")).alias("lead"), (F.col("place") + F.col("i")).alias("place"))
    middle = (F.col("lead").cast("decimal(38,0)") * 2 + F.col("size")) * shards
    placed = written(placed.withColumn("shard", F.least(F.floor(middle / F.lit(max(2 * total, 1)).cast("decimal(38,0)")).cast("int"), F.lit(shards - 1))), "placed")
    first = placed.groupBy("shard").agg(F.min("place").alias("first"))  # one row for each shard
    return placed.join(F.broadcast(first), "shard").select(
        "id",
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("place") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
