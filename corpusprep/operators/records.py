"""Schema enforcement on JSON records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusprep.session import materialize


def enforce(df: DataFrame, json_col: str, fields: str) -> DataFrame:
    """``df`` with ``record`` (the fields of a DDL schema) and ``problem``: empty,
    ``malformed`` (null, or no JSON object) or ``missing: a, b`` (null, absent or of another type)."""
    parsed = F.from_json(json_col, fields)
    # read again as a plain map, which tells a broken text from one that lacks fields
    broken = F.col(json_col).isNull() | F.from_json(json_col, "map<string,string>").isNull()
    d = df.withColumn("record", parsed)
    names = d.schema["record"].dataType.fieldNames()
    gone = F.array_compact(F.array(*[F.when(F.col("record")[n].isNull(), F.lit(n)) for n in names]))
    return d.withColumn("problem", F.when(broken, "malformed").when(F.size(gone) > 0, F.concat(F.lit("missing: "), F.array_join(gone, ", "))).otherwise(""))


def accepted_and_rejected(df: DataFrame, json_col: str, fields: str) -> tuple[DataFrame, DataFrame]:
    """(rows with ``record``, rejected rows with ``problem``); checked once, written once."""
    d = materialize(enforce(df, json_col, fields), "records")
    return d.where("problem = ''").drop("problem"), d.where("problem != ''").drop("record")
