"""Comparing overlaps with known placements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def interval_overlaps(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of half-open intervals ``(key, id, s, e)`` that intersect.

    Cells come in levels, those of level L being 2^L wide.  An interval belongs
    to the lowest level whose cells are as long as it is and lies in at most two
    of them there, however long it is.  Of two intervals the one of the higher
    level stays in its own cells and the other one is looked up at that level,
    again in at most two cells; an intersecting pair is reported in the cell
    where the later of the two starts.
    """
    levels = [r[0] for r in _levelled(left).select("own").union(_levelled(right).select("own")).distinct().collect()]  # 63 at most
    a, b = _renamed(_levelled(left), "a"), _renamed(_levelled(right), "b")
    pairs = None
    for high, low, strict in ((a, b, False), (b, a, True)):
        # of two intervals of one level, the left one counts as the higher
        met = _in_cells(high, [], True).join(_in_cells(low, levels, False, strict), ["key", "level", "cell"])
        pairs = _met(met) if pairs is None else pairs.unionByName(_met(met))
    return pairs


def _levelled(df: DataFrame) -> DataFrame:
    size = F.col("e") - F.col("s")
    return df.where("e > s").withColumn("own", F.length(F.bin(size - 1)) - F.when(size == 1, 1).otherwise(0))


def _renamed(df: DataFrame, side: str) -> DataFrame:
    return df.select("key", F.col("s").alias("_s"), F.col("e").alias("_e"), "own", *[F.col(c).alias(f"{side}_{c}") for c in ("id", "s", "e")])


def _in_cells(df: DataFrame, levels: list[int], own: bool, strict: bool = False) -> DataFrame:
    """Rows by the cells they lie in, at their own level or at all of ``levels`` from it on."""
    if own:
        at = df.withColumn("level", F.col("own"))
    else:
        above = F.filter(F.array(*[F.lit(n) for n in levels]), lambda n: n > F.col("own") if strict else n >= F.col("own"))
        at = df.withColumn("level", F.explode(above))
    cell = lambda c: F.expr(f"shiftright(cast({c} as bigint), level)")
    return at.withColumn("cell", F.explode(F.sequence(cell("_s"), cell("_e - 1")))).drop("_s", "_e", "own")


def _met(met: DataFrame) -> DataFrame:
    hit = (F.col("a_s") < F.col("b_e")) & (F.col("b_s") < F.col("a_e")) & (F.col("a_id") != F.col("b_id"))
    here = F.expr("shiftright(cast(greatest(a_s, b_s) as bigint), level)") == F.col("cell")
    return met.where(hit & here).select("key", "a_id", "a_s", "a_e", "b_id", "b_s", "b_e")


def true_pairs(truth: DataFrame, genome: int | None = None, wrap: int = 0) -> DataFrame:
    """Read pairs whose placements intersect, with the shared length.

    On a circular genome the intervals starting below ``wrap`` count a second
    time, moved behind the end.
    """
    spans = truth.select(F.lit(0).alias("key"), F.col("rid").alias("id"), "s", "e")
    moved = spans
    if genome is not None:
        moved = spans.unionByName(
            spans.where(F.col("s") < wrap).select("key", "id", F.col("s") + genome, F.col("e") + genome).toDF(*spans.columns)
        )
    met = interval_overlaps(spans, moved)
    shared = F.least("a_e", "b_e") - F.greatest("a_s", "b_s")
    return (
        met.groupBy(F.least("a_id", "b_id").alias("lo"), F.greatest("a_id", "b_id").alias("hi"))
        .agg(F.max(shared).alias("olen"))
    )


def mark_true(records: DataFrame, truth_pairs: DataFrame) -> DataFrame:
    """Found overlaps with a flag telling whether the truth has them."""
    keyed = records.withColumn("lo", F.least("rid0", "rid1")).withColumn("hi", F.greatest("rid0", "rid1"))
    known = truth_pairs.select("lo", "hi", F.lit(1).alias("hit"))
    return keyed.join(known, ["lo", "hi"], "left").withColumn("is_true", F.coalesce("hit", F.lit(0))).drop("hit")


def mark_found(truth_pairs: DataFrame, records: DataFrame) -> DataFrame:
    """True pairs with a flag telling whether they were found."""
    seen = records.select(
        F.least("rid0", "rid1").alias("lo"), F.greatest("rid0", "rid1").alias("hi"), F.lit(1).alias("hit")
    ).distinct()
    return truth_pairs.join(seen, ["lo", "hi"], "left").withColumn("found", F.coalesce("hit", F.lit(0))).drop("hit")
