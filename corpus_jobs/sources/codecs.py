"""Tags and vectors as JSON text, the way they travel over JDBC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def encode_tags(tags: Column) -> Column:
    return F.to_json(F.coalesce(tags, F.array().cast("array<string>")))


def decode_tags(text: Column) -> Column:
    """An array of tags; null and empty text give none."""
    return F.from_json(F.coalesce(F.nullif(text, F.lit("")), F.lit("[]")), "array<string>")


def encode_vector(vector: Column) -> Column:
    return F.to_json(vector)


def decode_vector(text: Column) -> Column:
    return F.from_json(text, "array<float>")
