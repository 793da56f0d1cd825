"""Schemas of the stored tables; nothing is inferred."""

from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "boolean": T.BooleanType(), "array<float>": T.ArrayType(T.FloatType()),
}


def struct(columns: str) -> T.StructType:
    """A schema from "name type, name type"; needs no session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (c.strip().split(" ") for c in columns.split(","))])


#: Version of what is derived from a file (chunks, terms, vectors); a change makes all of it stale.
INDEX_VERSION = "1"

DOCUMENTS = struct(
    "relative_path string, file_type string, original_pdf string, mtime bigint, created_at bigint, "
    "content_hash string, index_version string, vectors_complete boolean"
)
CHUNKS = struct(
    "relative_path string, original_pdf string, heading_path string, start_line int, end_line int, content string"
)
#: Chunks as they are stored: with their terms, so that a query cuts no text into words.
INDEXED_CHUNKS = T.StructType([*CHUNKS.fields, T.StructField("terms", T.ArrayType(T.StringType())), T.StructField("dl", T.IntegerType())])
CHUNK_VECTORS = struct("relative_path string, start_line int, embedding array<float>")
CHUNK_KEY = ["relative_path", "start_line"]
