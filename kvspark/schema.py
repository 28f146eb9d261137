"""The log: one row per version of a key.

``(key, seq)`` is unique, ``vtype`` is 0 for a delete and 1 for a put, and only deletes have a
null value. The newest row with ``seq <= S`` decides what a read at S sees.
"""

from pyspark.sql import types as T

DELETE, PUT = 0, 1
#: Sequence numbers fit 56 bits.
MAX_SEQ = (1 << 56) - 1
LOG = T.StructType([
    T.StructField("key", T.BinaryType(), False),
    T.StructField("seq", T.LongType(), False),
    T.StructField("vtype", T.IntegerType(), False),
    T.StructField("value", T.BinaryType(), True),
])
BATCH = T.StructType([
    T.StructField("op_index", T.LongType(), False),
    T.StructField("vtype", T.IntegerType(), False),
    T.StructField("key", T.BinaryType(), False),
    T.StructField("value", T.BinaryType(), True),
])
