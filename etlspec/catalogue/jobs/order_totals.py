"""A job file: the code a spec names instead of declaring transforms."""

from pyspark.sql import functions as F


def run(spark, frames):
    price = F.col("o_totalprice").cast("decimal(18,2)")
    return frames["orders"].groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"), F.sum(price).cast("double").alias("total")
    )
