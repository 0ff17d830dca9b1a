"""The four relations of a block set, and fixed limits of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

_B, _L, _S = T.BinaryType(), T.LongType(), T.StringType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


#: One row for each block hash; ``count`` is the saturated sum of its sub-counts.
HASH = _struct(block_hash=_B, k_entropy=_L, block_label=_S, count=_L)
#: One row for each block hash and source that holds it.
HASH_SOURCE = _struct(block_hash=_B, file_hash=_B, sub_count=_L)
SOURCE = _struct(file_hash=_B, filesize=_L, file_type=_S, zero_count=_L, nonprobative_count=_L)
SOURCE_NAME = _struct(file_hash=_B, repository_name=_S, filename=_S)

# Fixed values of the data model.
SETTINGS_VERSION = 4
BLOCK_SIZE = 512
MAX_SUB_COUNT = 65535
MAX_COUNT = 4294967295
LABEL_BYTES = 10
PREFIX_BYTES = 7
