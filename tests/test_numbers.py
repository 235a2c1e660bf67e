"""Rounding agrees with the language's own for every kind of tie."""

import random

from pyspark.sql import functions as F

from shortlist.functions.numbers import exact_round, fixed


def test_rounding_of_the_stored_value(spark):
    draw = random.Random(1)
    values = [0.125, 0.025, 0.285, 0.145, 2.675, 0.35, 2.25, 0.5, 1.5, -0.125, -2.675, 0.0, 1e-9, 123456.785]
    values += [round(draw.uniform(0, 100), 3) for _ in range(3000)] + [i / 8 for i in range(100)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    columns = [exact_round(F.col("x"), n).alias(f"r{n}") for n in (0, 1, 2, 4)] + [fixed(F.abs("x"), 2).alias("t")]
    for row in df.select("x", *columns).collect():
        for n in (0, 1, 2, 4):
            assert row[f"r{n}"] == round(row["x"], n), (row["x"], n)
        assert row["t"] == f"{abs(row['x']):.2f}"
