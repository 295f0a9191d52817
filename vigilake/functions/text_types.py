"""Types of text values, and how a column's votes become one type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigilake.fixed import INTEGER_TEXT, NUMBER_TEXT


def infer_text_type(value: Column) -> Column:
    """``integer``, ``number`` or ``string``; null for null and empty text (no vote)."""
    return (
        F.when(value.isNull() | (value == ""), F.lit(None).cast("string"))
        .when(value.rlike(INTEGER_TEXT), "integer")
        .when(value.rlike("(?i)" + NUMBER_TEXT), "number")
        .otherwise("string")
    )


def pick_type(integers: Column, numbers: Column, strings: Column) -> Column:
    """One type from vote counts; anything mixed with text, or no vote at all, is text."""
    return (
        F.when(strings > 0, "string")
        .when(numbers > 0, "number")
        .when(integers > 0, "integer")
        .otherwise("string")
    )


def render_type(type_name: Column) -> Column:
    """Non-text types always also allow text: ``integer/string``."""
    return F.when(type_name == "string", "string").otherwise(F.concat(type_name, F.lit("/string")))


def json_value_type(sql_type: Column, text: Column, lenient_numbers: bool = False) -> Column:
    """Vote of one JSON value from its variant type.

    By default true JSON types count. With ``lenient_numbers`` a value votes as its
    conversion to an integer or number would: fractions and booleans are ``integer``
    and numeric strings vote by their text.
    """
    base = F.regexp_extract(sql_type, r"^[A-Z]+", 0)
    whole = base.isin("TINYINT", "SMALLINT", "INT", "BIGINT")
    fraction = base.isin("DECIMAL", "FLOAT", "DOUBLE")
    infinite = text.isin("Infinity", "-Infinity", "NaN")
    if lenient_numbers:
        return (
            F.when(base == "VOID", F.lit(None).cast("string"))
            .when(fraction & infinite, "number")
            .when(whole | fraction | (base == "BOOLEAN"), "integer")
            .when(base == "STRING", infer_text_type(text))
            .otherwise("string")
        )
    return (
        F.when((base == "VOID") | ((base == "STRING") & (text == "")), F.lit(None).cast("string"))
        .when(whole | (base.isin("DECIMAL") & sql_type.endswith(",0)")), "integer")
        .when(fraction, "number")
        .when(base == "BOOLEAN", "boolean")
        .otherwise("string")
    )


def generic_class(sql_type: Column) -> Column:
    """Generic class of a Spark SQL type name."""
    return (
        F.when(sql_type.isin("tinyint", "smallint", "int", "bigint"), "integer")
        .when(sql_type.isin("float", "double") | sql_type.startswith("decimal"), "number")
        .when((sql_type == "string") | sql_type.rlike(r"^(char|varchar)\("), "string")
        .when(sql_type.startswith("timestamp") | (sql_type == "date"), "date-time")
        .when(sql_type.rlike("^(array|map|struct)<"), "nested")
        .otherwise(sql_type)
    )
