"""Token streams, fixed-length samples and padded batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..session import checkpoint_dir
from ..sources.tables import partitions, shuffle_partitions

#: End of text of the public 50k vocabulary; padding too.
EOS = 50256
IGNORED = -100


def with_eos(ids: str) -> Column:
    """Ids with the end of text; ids above 65535 do not fit the file format."""
    top = F.coalesce(F.array_max(ids), F.lit(0))
    checked = F.when(top > 65535, F.raise_error(F.concat(F.lit("token id above 65535: "), top.cast("string"))).cast("array<int>")).otherwise(F.col(ids))
    return F.concat(F.coalesce(checked, F.array().cast("array<int>")), F.array(F.lit(EOS)))


def offsets(df: DataFrame, id_col: str = "doc_id", size_col: str = "n_tokens") -> DataFrame:
    """``df`` with ``token_offset``: the tokens before it in order of the id;
    of equal ids in any order. Null ids have none.

    The rows, which should be slim, are put into ranges of the id, as many as
    two for each partition of the input; each task runs through its sorted
    range once. The ranges are written to the shared folder, as their totals and their rows must
    be of one cut; the totals, a row a range, are summed up and added.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    rows = df.filter(F.col(id_col).isNotNull())
    ranges = max(shuffle_partitions(spark), 2 * partitions(df, 1))
    sorted_ = rows.repartitionByRange(ranges, id_col).sortWithinPartitions(id_col)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, total = TaskContext.get().partitionId(), 0
        for frame in frames:
            sums = frame[size_col].cumsum() + total
            yield frame.assign(_part=part, _inside=sums - frame[size_col])
            total = int(sums.iloc[-1]) if len(sums) else total

    schema = StructType([*rows.schema.fields, StructField("_part", IntegerType()), StructField("_inside", LongType())])
    made = sorted_.mapInPandas(run, schema).checkpoint()
    totals = made.groupBy("_part").agg(F.sum(size_col).alias("_s"))
    before = totals.withColumn("_before", F.coalesce(F.sum("_s").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_s")
    return made.join(F.broadcast(before), "_part").withColumn("token_offset", (F.col("_before") + F.col("_inside")).cast("long")).drop("_part", "_before", "_inside")


def pack(df: DataFrame, length: int, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(chunk_id, input_ids, target_ids): the stream of all ids cut into samples
    of ``length``; targets are shifted by one; the tail is dropped.

    A text is cut at sample borders where it lies, so only the pieces of one
    sample meet in a task. The ids are written once to the shared folder, with
    a number a row by which their offsets, made from sizes alone, are joined.
    """
    checkpoint_dir(df.sparkSession)
    rows = df.select(id_col, F.col(ids_col).alias("ids"), F.size(ids_col).cast("long").alias("n_tokens")).filter("n_tokens > 0").withColumn("_row", F.monotonically_increasing_id()).checkpoint()
    placed = offsets(rows.select(id_col, "_row", "n_tokens"), id_col).select("_row", "token_offset")
    sized = rows.join(placed, "_row")
    first, last = F.floor(F.col("token_offset") / length), F.floor((F.col("token_offset") + F.col("n_tokens") - 1) / length)
    # the first token of a sample is also the last target of the one before
    begin = F.greatest(F.lit(0), F.when(F.col("token_offset") % length == 0, first - 1).otherwise(first))
    pieces = sized.withColumn("chunk_id", F.explode(F.sequence(begin, last))).withColumn("_from", F.greatest(F.col("chunk_id") * length - F.col("token_offset"), F.lit(0)))
    upto = F.least((F.col("chunk_id") + 1) * length + 1 - F.col("token_offset"), F.col("n_tokens"))
    cut = pieces.withColumn("_n", upto - F.col("_from")).filter("_n > 0").select("chunk_id", (F.col("token_offset") + F.col("_from")).alias("pos"), F.slice("ids", (F.col("_from") + 1).cast("int"), F.col("_n").cast("int")).alias("part"))
    whole = cut.groupBy("chunk_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "part"))), lambda x: x["part"])).alias("all")).filter(F.size("all") == length + 1)
    return whole.select("chunk_id", F.slice("all", 1, length).alias("input_ids"), F.slice("all", 2, length).alias("target_ids"))


def pair_tokens(prompt: str, body: str, most: int) -> dict[str, Column]:
    """Columns input_ids, prompt_len, truncated, dropped of a prompt and an answer:
    the answer is cut to what is left less the end of text; a prompt that
    leaves nothing, or an empty answer, is dropped."""
    p, b = F.col(prompt), F.col(body)
    budget = F.lit(most) - F.size(p)
    dropped = (F.size(b) == 0) | (F.size(p) >= most)
    cut = F.slice(b, F.lit(1), F.greatest(budget - 1, F.lit(0)))
    return {
        "input_ids": F.when(~dropped, F.concat(p, cut, F.array(F.lit(EOS)))),
        "prompt_len": F.size(p),
        "truncated": ~dropped & (F.size(b) + 1 > budget),
        "dropped": dropped,
    }


def collate(df: DataFrame, batch: int, order: str = "row_id", ids: str = "input_ids", prompt: str = "prompt_len", drop_last: bool = False) -> DataFrame:
    """(batch_id, row, x, y): inputs and targets of each example, padded to the
    longest of its batch; targets inside the prompt and padding are ignored.

    ``df`` has ``rn``, the rank from 1. Batches are keyed by it, so the maximum
    is taken inside a batch.
    """
    b = df.withColumn("batch_id", F.floor((F.col("rn") - 1) / batch))
    w = Window.partitionBy("batch_id")
    wide = b.withColumn("_most", F.max(F.size(ids) - 1).over(w)).withColumn("_rows", F.count(F.lit(1)).over(w))
    if drop_last:
        wide = wide.filter(F.col("_rows") == batch)
    n = F.size(ids) - 1
    pad = F.col("_most") - n
    masked = F.greatest(F.least(F.col(prompt) - 1, n), F.lit(0))
    x = F.concat(F.slice(ids, F.lit(1), n), F.array_repeat(F.lit(EOS), pad))
    y = F.concat(F.array_repeat(F.lit(IGNORED), masked), F.slice(ids, masked + 2, n - masked), F.array_repeat(F.lit(IGNORED), pad))
    return wide.select("batch_id", order, x.alias("x"), y.alias("y"))
