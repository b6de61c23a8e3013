"""Seed matches are looked for once, however many steps read them."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from readloom.operators import kmers


@pytest.mark.parametrize("step", [kmers.densest_diagonal, lambda m: kmers.alignment_range(m, 50, 3)])
def test_matches_are_made_once(spark, step):
    rng = random.Random(2)
    rows = [(q, t, p, p + rng.randrange(-3, 4) + 10 * t) for q in range(3) for t in range(2) for p in range(0, 400, 8)]
    seen = spark.sparkContext.accumulator(0)

    def passed(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    schema = "q_id long, t_id long, q_pos int, t_pos int"
    out = step(spark.createDataFrame(rows, schema).mapInArrow(passed, schema))
    assert out.select(F.countDistinct("q_id", "t_id")).first()[0] == 6
    assert seen.value == len(rows)
