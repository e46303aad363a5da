"""Engine-neutral output types, for comparing results with another SQL engine.

Analyses return Spark's exact decimals. For a comparison, every integral
column becomes ``bigint``, every date an ISO ``yyyy-MM-dd`` string, and every
decimal becomes ``double``, after rounding half up to 6 places when it carries
more (T-SQL's minimum division scale).
A decimal of at most 6 places and below 2**53 in its last digit converts to
the same double in any engine, so results can be hashed value for value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def portable(df: DataFrame, max_scale: int = 6) -> DataFrame:
    columns = []
    for field in df.schema.fields:
        col = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DecimalType):
            if field.dataType.scale > max_scale:
                col = F.round(col, max_scale)
            col = col.cast("double")
        elif isinstance(field.dataType, INTEGRAL):
            col = col.cast("long")
        elif isinstance(field.dataType, T.DateType):
            col = F.date_format(col, "yyyy-MM-dd")
        columns.append(col.alias(field.name))
    return df.select(*columns)
