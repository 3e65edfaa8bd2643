"""Size bounds, and the only place where broadcast hints are given."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The shard number domain.
MIN_SHARD_NO = 0
MAX_SHARD_NO = 9999
MAX_SHARDS = MAX_SHARD_NO - MIN_SHARD_NO + 1

# A lookup side up to this many rows and bytes of its values of variable width may be broadcast.
MAX_BROADCAST_ROWS = 200_000
MAX_BROADCAST_BYTES = 32 << 20


def fits(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES) -> bool:
    """Whether df is within both bounds. Pass a stored or checkpointed frame, as it is counted.

    Counted per partition and in whole: a limit would first bring its number of
    rows of every partition into one task.
    """
    wide = []
    for field in df.schema.fields:
        value = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            value = F.to_json(F.struct(value))
        elif not isinstance(field.dataType, (T.StringType, T.BinaryType)):
            continue
        wide.append(F.coalesce(F.sum(F.octet_length(value)), F.lit(0)))
    rows, *sizes = df.agg(F.count(F.lit(1)), *wide).first()
    return rows <= max_rows and sum(sizes) <= max_bytes


def broadcast_within(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast of df if it was counted to be small, else return it as is.

    Beyond the bound the join is left to Spark: sort-merge, with skewed shards
    split by adaptive execution.
    """
    return F.broadcast(df) if fits(df, max_rows) else df
