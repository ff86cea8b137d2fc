"""The same score Columns on a stream: stateless, append mode."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.units import lines, score_units
from ..plans.query import parse_file_query


def score_arrived(stream: DataFrame, folder: str) -> DataFrame:
    """Run a stream over what has arrived so far into Parquet files below ``folder``, which
    also keeps how far it came, and read them: called again it adds what is new."""
    run = stream.writeStream.format("parquet").option("path", f"{folder}/scores").option("checkpointLocation", f"{folder}/progress").outputMode("append").trigger(availableNow=True)
    run.start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/scores")


def scored_stream(spark: SparkSession, folder: str, schema, file_id: str, text: str, query: str, weights: dict | None = None) -> DataFrame:
    """Scored units of the Parquet files that arrive in a folder."""
    return score_lines(spark.readStream.schema(schema).parquet(folder), file_id, text, query, weights)


def score_lines(rows: DataFrame, file_id: str, text: str, query: str, weights: dict | None = None) -> DataFrame:
    return score_units(lines(rows, file_id, text), parse_file_query(query), weights).where("score > 0")
