"""Schemas and record sizes of the store's relations."""

from pyspark.sql import types as T

#: Bytes of the stored formats. Fixed values.
MANIFEST_HEADER = 28
MANIFEST_FILE = 32
CHUNK_ID = 32
INDEX_RECORD = 48
FRAME = 1
SEAL = 40
SNAPSHOT_ID = 16
MAX_CHUNK = 16 << 20

CHUNKS = T.StructType(
    [
        T.StructField("path", T.StringType(), False),
        T.StructField("target_size", T.LongType(), False),
        T.StructField("seq", T.IntegerType(), False),
        T.StructField("offset", T.LongType(), False),
        T.StructField("len", T.LongType(), False),
        T.StructField("chunk_id", T.StringType(), False),
    ]
)
FILES = T.StructType(
    [
        T.StructField("path", T.StringType(), False),
        T.StructField("size", T.LongType(), False),
        T.StructField("mtime_secs", T.LongType(), False),
        T.StructField("mtime_nanos", T.IntegerType(), False),
        T.StructField("mode", T.LongType(), False),
        T.StructField("content", T.BinaryType(), True),
    ]
)
MANIFEST = T.StructType(
    [
        T.StructField("snapshot_id", T.BinaryType()),
        T.StructField("created_at", T.LongType()),
        T.StructField(
            "files",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("path", T.StringType()),
                        T.StructField("size", T.LongType()),
                        T.StructField("mtime_secs", T.LongType()),
                        T.StructField("mtime_nanos", T.LongType()),
                        T.StructField("mode", T.LongType()),
                        T.StructField("chunks", T.ArrayType(T.BinaryType())),
                    ]
                )
            ),
        ),
    ]
)
