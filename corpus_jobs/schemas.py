"""Schemas of the tables that the jobs read and write."""

from pyspark.sql import types as T

_TEXT = T.StringType()


def _fields(*names: str) -> list[T.StructField]:
    return [T.StructField(name, _TEXT) for name in names]


NOTES = T.StructType(
    [
        *_fields("slug", "url", "title", "heading", "list_title", "description", "lang", "category", "date", "date_text", "content_html"),
        T.StructField("published", T.BooleanType()),
        T.StructField("tags", T.ArrayType(_TEXT)),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)
PARSED = T.StructType(NOTES.fields[:-2])
CHUNKS = T.StructType(
    [
        *_fields("slug"),
        T.StructField("chunk_index", T.IntegerType()),
        *_fields("heading", "text", "content_hash"),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("updated_at", T.TimestampType()),
    ]
)
SECTIONS = T.ArrayType(T.StructType(_fields("heading", "text")))
