"""Schemas of the catalog and the relation of file extensions to categories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The catalogued extensions of each category.
IMAGE = (".jpg", ".jpeg", ".png", ".gif", ".bmp", ".tif", ".tiff", ".webp", ".heic", ".heif", ".raw", ".cr2", ".nef", ".arw", ".dng", ".orf", ".rw2")
VIDEO = (".mp4", ".mov", ".avi", ".mkv", ".wmv", ".flv", ".m4v", ".3gp", ".mpg", ".mpeg", ".webm")
DOC = (".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".txt", ".rtf", ".odt", ".ods", ".odp", ".csv")


def _fields(*specs: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(*s) for s in specs])


_S, _L, _D = T.StringType(), T.LongType(), T.DoubleType()

#: One observed file.
SEEN = _fields(("path", _S, False), ("dir", _S, False), ("name", _S, False), ("ext", _S, False), ("category", _S, False), ("size", _L, False), ("mtime", _D, False), ("ctime", _D, True))

#: One row of a catalog snapshot.
CATALOG = _fields(
    ("path", _S, False), ("root", _S, False), ("dir", _S, False), ("name", _S, False), ("ext", _S, False), ("category", _S, False), ("size", _L, False),
    ("mtime", _D, False), ("ctime", _D, True), ("partial_hash", _S, True), ("full_hash", _S, True), ("error", _S, True),
)

#: A folder-priority rule; the lowest rank is kept first, rule_seq settles equal ones.
RULES = _fields(("path", _S, False), ("recursive", T.BooleanType(), False), ("rank", T.IntegerType(), False), ("rule_seq", T.IntegerType(), False))

#: A planned removal.
PLAN = _fields(("full_hash", _S, False), ("path", _S, False), ("size", _L, False), ("dir", _S, False), ("name", _S, False), ("why", _S, False))

#: A content hash, or the error met while reading.
HASHED = _fields(("path", _S, False), ("hash", _S, True), ("error", _S, True))


def category(ext: Column) -> Column:
    """image, video or doc; null for an extension that isn't catalogued."""
    return F.when(ext.isin(*IMAGE), "image").when(ext.isin(*VIDEO), "video").when(ext.isin(*DOC), "doc")
