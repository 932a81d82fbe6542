"""Declared schemas of the library's tables."""

from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

_TYPES = {"string": StringType(), "long": LongType(), "int": IntegerType(), "double": DoubleType(), "boolean": BooleanType()}


def _of(text: str) -> StructType:
    return StructType([StructField(n, _TYPES[t]) for n, t in (f.split() for f in text.split(", "))])


FILES = _of("language string, codebase string, file_id long, path string, content string")
LOSSES = _of("scorer string, language string, codebase string, file_id long, i int, pos long, n_bytes int, n_chars int, ubits long")
CURVE = _of("scorer string, language string, bucket int, n long, ubits long, n_bytes long, bpb double, stderr double")
ROLLOUTS = _of("language string, codebase string, task_id long, sample int, condition string, context_limit int, passed boolean")
