"""Mixing sources to target weights by Pareto order sampling.

1. Weights share out all words. A target stops at a fixed multiple of its source; the rest is shared anew.
2. A document's expected copies are its source's target over its size, times its own weight if it has one.
   Whole copies are certain. What is left is the document's chance of one more copy.
3. Documents of a source are ranked by the odds of a random number over the odds of that chance; the first
   ones get the copy, up to the words the source still lacks. So the size of the sample is fixed.

Where the first ones end is found digit by digit: each round adds words by the next digits of the rank, so
no task sorts a source, however large, and equal ranks fall back to a row number.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowcairn.llm.shared import materialise

WEIGHTS = (1.0, 2.0, 3.0)
MOST_TIMES = 3
RANK_BITS = 48
DIGIT_BITS = 12
PARTS = 1 << 20  # of a word, when expected words are summed
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str) -> Column:
    """Words of a text, parted by ASCII white space; a null text has none."""
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def numbered_sources(sizes: DataFrame) -> DataFrame:
    """Sources with their place (from 0) in code point order, null last.

    Places are offsets of range partitions plus the place inside, so no task holds all sources.
    """
    key = [F.col("source").asc_nulls_last()]
    parts = sizes.repartitionByRange(max(1, math.ceil(sizes.count() / 10_000)), *key).withColumn("part", F.spark_partition_id())
    parts = materialise(parts, "sources")
    before = F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))  # a row per part
    offsets = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(before, F.lit(0)).alias("ahead"))
    inside = F.row_number().over(W.partitionBy("part").orderBy(*key))
    return parts.join(F.broadcast(offsets), "part").select("source", "size", (F.col("ahead") + inside - 1).alias("place"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most_times: int = MOST_TIMES) -> DataFrame:
    """source, size, target: all words shared out by weight, a target at most ``most_times`` its source.

    ``sizes`` has source and size, one row for each source. Weights repeat along the sources. What sources
    above their limit cannot take is shared by weight among the others, until none is above.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    left = materialise(numbered_sources(sizes).select("source", "size", weight.alias("weight"), F.lit(False).alias("full")), "weights")
    while True:  # every round fills one source at least
        limit = F.lit(most_times) * F.col("size")
        row = left.agg(
            F.coalesce(F.sum("size"), F.lit(0)).alias("words"),
            F.coalesce(F.sum(F.when(F.col("full"), limit)), F.lit(0)).alias("taken"),
            F.coalesce(F.sum(F.when(~F.col("full"), F.col("weight"))), F.lit(0.0)).alias("weight"),
        ).first()
        if not row["weight"]:
            return left.select("source", "size", limit.cast("double").alias("target"))
        share = F.lit(float(row["words"] - row["taken"])) * F.col("weight") / F.lit(float(row["weight"]))
        above = ~F.col("full") & (share > limit)
        if left.where(above).isEmpty():
            return left.select("source", "size", F.when(F.col("full"), limit.cast("double")).otherwise(share).alias("target"))
        left = materialise(left.withColumn("full", F.col("full") | above), "weights")


def _random(seed: int, *keys: str) -> Column:
    """A number between 0 and 1, both excluded, from the md5 of the keys."""
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]
    digits = F.substring(F.md5(F.concat_ws("|", *parts, F.lit(str(seed)))), 1, 12)
    return (F.conv(digits, 16, 10).cast("long").cast("double") + 0.5) / float(1 << 48)


def _first_ranks(rows: DataFrame, lacking: DataFrame) -> DataFrame:
    """source, cut_rank, cut_row, cut_taken: the last (rank, row) that may get a copy, and whether it does.

    ``rows`` has source, rank, row and size; ``lacking`` source and the words it lacks. The digits of
    the rank and then of the row number are fixed one after another: the first digit whose running sum of
    words reaches what is lacking goes on to the next round.
    """
    most_row = rows.agg(F.max("row")).first()[0] or 0
    row_bits = DIGIT_BITS * max(1, -(-int(most_row).bit_length() // DIGIT_BITS))
    base = float(1 << DIGIT_BITS)
    state = lacking.select("source", "lack", F.lit(0).cast("long").alias("at_rank"), F.lit(0).cast("long").alias("at_row"))
    steps = [("rank", shift) for shift in range(RANK_BITS - DIGIT_BITS, -1, -DIGIT_BITS)]
    steps += [("row", shift) for shift in range(row_bits - DIGIT_BITS, -1, -DIGIT_BITS)]
    same = lambda a, b: a.eqNullSafe(b)
    for column, shift in steps:
        s = state.select(F.col("source").alias("s_source"), "lack", "at_rank", "at_row")
        inside = same(F.col("source"), F.col("s_source"))
        above = shift + DIGIT_BITS
        inside &= F.shiftright("rank", above if column == "rank" else 0) == F.col("at_rank")
        if column == "row":
            inside &= F.shiftright("row", above) == F.col("at_row")
        digit = F.shiftright(column, shift).bitwiseAND((1 << DIGIT_BITS) - 1)
        sums = rows.join(s, inside).groupBy("source", digit.alias("digit")).agg(
            F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in ("lack", "at_rank", "at_row")]
        )
        upto = F.sum("words").over(W.partitionBy("source").orderBy("digit").rowsBetween(W.unboundedPreceding, 0))
        reached = sums.withColumn("upto", upto).where(F.col("upto") >= F.col("lack"))
        first = reached.groupBy("source").agg(F.min_by(F.struct("digit", "words", "upto", "lack", "at_rank", "at_row", "n"), "digit").alias("x"))
        grown = lambda c: (F.col(f"x.{c}") * int(base) + F.col("x.digit")) if c == f"at_{column}" else F.col(f"x.{c}")
        state = materialise(first.select(
            "source", (F.col("x.lack") - (F.col("x.upto") - F.col("x.words"))).alias("lack"),
            grown("at_rank").alias("at_rank"), grown("at_row").alias("at_row"), F.col("x.words").alias("words"),
        ), "cut")
    # The document in which the sum gets there is taken if that comes nearer than leaving it.
    return state.select("source", F.col("at_rank").alias("cut_rank"), F.col("at_row").alias("cut_row"), (F.col("lack") * 2 >= F.col("words")).alias("cut_taken"))


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    most_times: int = MOST_TIMES,
    seed: int = 12,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weight_col: str | None = None,
) -> DataFrame:
    """Copies of each document in the mix: doc_id, source, row, size, source_size, target, chance, copies, taken.

    ``taken`` is copies times size, at most ``most_times`` times the size. A source's taken words miss its
    target by half a document at most when documents have equal weights; with ``weight_col`` (positive
    numbers; null counts as 1) chances inside a source differ, and what the limit of copies cuts off is
    not made up for. Reruns agree: ranks come from the md5 of id, source and text.

    A null text has size 0 and no words to take. A null source is a source, the last one. Null and
    repeated ids are rows of their own; rows equal in id, source and text are told apart by a row number,
    so reruns agree on how many of them are taken. An empty table gives no rows; other columns are ignored.
    """
    own = F.coalesce(F.col(weight_col).cast("double"), F.lit(1.0)) if weight_col else F.lit(1.0)
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), own.alias("weight"),
        word_count(text_col).alias("size"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    sized = materialise(rows.select(
        "doc_id", "source", "size", "weight", F.monotonically_increasing_id().alias("id"),
        _random(seed, "doc_id", "source", "text").alias("random"),
    ), "sized")
    # Row numbers are dense enough for few digits: the partition above, the place in it below.
    place = F.col("id").bitwiseAND((1 << 33) - 1)
    bits = max(1, int(sized.agg(F.max(place)).first()[0] or 0).bit_length())
    sized = sized.withColumn("row", F.shiftleft(F.shiftright("id", 33), bits) + place)
    per_source = sized.groupBy("source").agg(F.sum("size").alias("size"), F.sum(F.col("size") * F.col("weight")).alias("mass"))
    per_source = materialise(per_source, "source-sizes")
    goal = targets(per_source.select("source", "size"), weights, most_times)
    goal = goal.join(per_source.select(F.col("source").alias("s"), "mass"), F.col("source").eqNullSafe(F.col("s"))).select(
        F.col("source").alias("g_source"), F.col("size").alias("source_size"), "target", "mass"
    )
    goal = materialise(goal, "goal")
    known = sized.join(goal, F.col("source").eqNullSafe(F.col("g_source"))).drop("g_source")
    mass = F.when(F.col("mass") > 0, F.col("mass"))
    expected = F.coalesce(F.least(F.lit(float(most_times)), F.col("target") * F.col("weight") / mass), F.lit(0.0))
    known = known.withColumn("expected", expected).withColumn("sure", F.floor("expected")).withColumn("chance", F.col("expected") - F.col("sure"))
    chance = F.when(F.col("chance") > 0, F.col("chance"))
    odds = (F.col("random") / (1 - F.col("random"))) / (chance / (1 - chance))
    rank = F.least(F.floor(odds / (1 + odds) * float(1 << RANK_BITS)), F.lit((1 << RANK_BITS) - 1))
    known = known.withColumn("rank", F.when(F.col("chance") > 0, rank))
    known = materialise(known, "ranked")
    in_play = known.where("chance > 0 AND size > 0").select("source", "rank", "row", "size", "expected", "sure")
    # Summed in whole parts of a word, so that the order of rows does not matter.
    share = F.floor(F.col("size") * (F.col("expected") - F.col("sure")) * float(PARTS)).cast("decimal(28, 0)")
    lacking = in_play.groupBy("source").agg(F.sum(share).alias("parts"))
    lacking = lacking.select("source", F.expr(f"CAST((parts + {PARTS // 2}) DIV {PARTS} AS BIGINT)").alias("lack")).where("lack > 0")
    cuts = _first_ranks(in_play, materialise(lacking, "lacking")).withColumnRenamed("source", "c_source")
    joined = known.join(cuts, F.col("source").eqNullSafe(F.col("c_source")), "left")
    before = (F.col("rank") < F.col("cut_rank")) | ((F.col("rank") == F.col("cut_rank")) & (F.col("row") < F.col("cut_row")))
    at = (F.col("rank") == F.col("cut_rank")) & (F.col("row") == F.col("cut_row")) & F.col("cut_taken")
    extra = F.when(F.coalesce(before | at, F.lit(False)), 1).otherwise(0)
    copies = (F.col("sure") + extra).cast("long")
    return joined.select(
        "doc_id", "source", "row", "size", "source_size", "target", "chance", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )
