"""Queries of problem 3: stated values in common units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import units
from ..session import table

#: The units of p3_found.
LISTED = ["cm", "mm", "in", "ft", "yd", "cm2", "ft2", "yd2", "ms", "min", "h"]


def _values(spark: SparkSession, d: str) -> DataFrame:
    def part(t: str, row_id: str, q: str, source: str | None, fields: list[str]) -> DataFrame:
        each = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields))
        src = F.col(source) if source else F.lit(None).cast("string")
        return table(spark, d, t).select(F.lit(t).alias("tab"), F.col(row_id).alias("row_id"), src.alias("source"), F.col(q).alias("question"), F.explode(each).alias("e")).select("tab", "row_id", "e.field", "source", "question", "e.text")

    return (
        part("vsi_annotation", "id", "question", "dataset", ["ground_truth"])
        .unionByName(part("vsi_result", "row_id", "question", "dataset", ["ground_truth", "predicted_answer"]))
        .unionByName(part("spar_result", "row_id", "question", None, ["ground_truth", "predicted_answer"]))
        .unionByName(part("training_example", "problem_id", "problem", "data_source", ["solution"]))
    )


def p3_values(spark: SparkSession, d: str) -> DataFrame:
    """Every stated value with its unit and its value in metres, square metres or seconds."""
    out = units.convert_values(_values(spark, d), table(spark, d, "source_card"))
    return out.withColumn("value", F.round("value", 6)).withColumn("common_value", F.round("common_value", 6))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    out = units.convert_values(_values(spark, d), table(spark, d, "source_card"))
    return out.where(F.col("unit").isin(LISTED)).select("tab", "row_id", "field", "unit").distinct()


QUERIES = {"p3_found": p3_found, "p3_values": p3_values}
