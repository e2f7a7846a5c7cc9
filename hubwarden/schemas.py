"""Column layouts shared by all operators."""

from __future__ import annotations

from pyspark.sql import types as T

# One row per file, link or directory below a scan target.
ARTIFACTS = T.StructType(
    [
        T.StructField("target", T.StringType()),
        T.StructField("relpath", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("depth", T.IntegerType()),
        T.StructField("size", T.LongType()),
        T.StructField("is_file", T.BooleanType()),
        T.StructField("is_symlink", T.BooleanType()),
        T.StructField("path", T.StringType()),
    ]
)

# One row per finding; ``evidence`` is a JSON object, so that findings of all
# checks union, compare and land in any file format.
FINDING_COLUMNS = (
    "target",
    "scan_type",
    "category",
    "severity",
    "check",
    "file",
    "detail",
    "evidence",
    "recommendation",
)

TENSORS = T.StructType(
    [
        T.StructField("target", T.StringType()),
        T.StructField("file", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("dtype", T.StringType()),
        T.StructField("shape", T.ArrayType(T.LongType())),
        T.StructField("n", T.LongType()),
        T.StructField("max_abs", T.DoubleType()),
        T.StructField("has_nan", T.BooleanType()),
        T.StructField("read_status", T.StringType()),
    ]
)
