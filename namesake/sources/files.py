"""Results as CSV files, and back: nested fields as JSON, cells that a spreadsheet can't take for formulas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType, _parse_datatype_string

#: How a null is written; text of just this form can't be told from it.
NULL = "\\N"
FORMULA = r"^'*[=+\-@\t\r]"
OPTIONS = {"header": True, "quoteAll": True, "escape": '"', "nullValue": NULL, "emptyValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def _nested(kind: DataType) -> bool:
    return isinstance(kind, ArrayType | MapType | StructType)


def _cell(c: Column, kind: DataType) -> Column:
    """A value as text; text that begins like a formula, after quotes or not, gets one quote more, so that the way back is plain."""
    if _nested(kind):
        return F.to_json(c, {"ignoreNullFields": "false"})
    if isinstance(kind, StringType):
        return F.when(c.rlike(FORMULA), F.concat(F.lit("'"), c)).otherwise(c)
    return c.cast("string")


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV files with headers, all cells in quotes, nested columns as JSON."""
    cells = df.select(*[_cell(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema])
    cells.write.mode("overwrite").options(**OPTIONS).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What write_csv() wrote, under its schema. Cells may hold line breaks, so a file is read by one task."""
    kinds = _parse_datatype_string(schema)
    text = StructType()
    for f in kinds:
        text = text.add(f.name, "string")
    rows = spark.read.options(**OPTIONS, multiLine=True).schema(text).csv(path)

    def value(name: str, kind: DataType) -> Column:
        c = F.col(f"`{name}`")
        if _nested(kind):
            return F.from_json(c, kind)
        if isinstance(kind, StringType):
            return F.when(c.rlike("^'+[=+\\-@\\t\\r]"), F.substring(c, 2, 1 << 30)).otherwise(c)
        return c.cast(kind)

    return rows.select(*[value(f.name, f.dataType).alias(f.name) for f in kinds])
