"""Latency and throughput summaries of benchmark samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def median(column: str) -> Column:
    """Exact, the mean of the two middle values of an even number."""
    return F.expr(f"percentile({column}, 0.5)")


def p95(column: str) -> Column:
    """Nearest rank."""
    return F.expr(f"percentile_disc(0.95) within group (order by {column})")


def http_summary(samples: DataFrame, seconds: DataFrame) -> DataFrame:
    """samples: clients, status, ms; seconds: clients, seconds of the run."""
    fine = F.when(F.col("status") == 200, F.col("ms"))
    found = samples.withColumn("ok_ms", fine).groupBy("clients").agg(
        F.count("*").alias("requests"), F.count("ok_ms").alias("successes"), F.count_if(F.col("status") == 503).alias("rejected_503"), F.count_if(~F.col("status").isin(200, 503)).alias("other_errors"),
        median("ok_ms").alias("success_median_ms"), p95("ok_ms").alias("success_p95_ms"),
    )
    return found.join(seconds, "clients").withColumn("completed_requests_per_second", F.col("requests") / F.col("seconds")).withColumn("successful_requests_per_second", F.col("successes") / F.col("seconds"))


def query_medians(samples: DataFrame) -> DataFrame:
    """samples: books, mode, query, iteration, ms, results."""
    return samples.groupBy("books", "mode").agg(median("ms").alias("median_ms"), F.count("*").alias("samples"))
