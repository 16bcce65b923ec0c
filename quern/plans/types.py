"""Value families: what the dialect knows of a value's type."""

from __future__ import annotations

from enum import Enum
from typing import NamedTuple

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.errors import SqlError


class Family(Enum):
    INT = "bigint"
    REAL = "double"
    TEXT = "string"
    BLOB = "binary"
    BOOL = "boolean"
    NULL = "void"
    #: Columns of attached files that the dialect has no type for: they can be projected, no more.
    OPAQUE = "opaque"


class Typed(NamedTuple):
    column: Column
    family: Family


NUMERIC = (Family.INT, Family.REAL, Family.BOOL)


def family_of(kind: T.DataType) -> Family:
    if isinstance(kind, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        return Family.INT
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return Family.REAL
    return {T.StringType: Family.TEXT, T.BinaryType: Family.BLOB, T.BooleanType: Family.BOOL}.get(type(kind), Family.OPAQUE)


def usable(value: Typed) -> Typed:
    """A value fit for an expression."""
    if value.family is Family.OPAQUE:
        raise SqlError("TypeMismatch", "columns of this type can only be selected")
    return value


def stored(value: Typed) -> Typed:
    """A value as it leaves an expression: truth values become 1 and 0."""
    return Typed(value.column.cast("bigint"), Family.INT) if value.family is Family.BOOL else value


def null(family: Family) -> Column:
    return F.lit(None).cast("string" if family in (Family.NULL, Family.OPAQUE) else family.value)


#: What a text must be to become a number, blanks not allowed.
NUMBER = {Family.INT: r"^[+-]?[0-9]+$", Family.REAL: r"(?i)^[+-]?([0-9]+\.?[0-9]*(e[+-]?[0-9]+)?|\.[0-9]+(e[+-]?[0-9]+)?|inf|infinity|nan)$"}


def shortest(value: Column) -> Column:
    """A positive real as `d.ddd` or `d.dddEn`, in the fewest digits that read back as it, of these the
    nearest to it. Spark's own text is Java's, which has digits too many or not the nearest before
    Java 19 (JDK-4511638): 1.1807E21 as 1.1807000000000001E21. The same digits come from the Jackson
    library that Spark reads JSON with; a call of it is an expression like any other to Catalyst."""
    jvm = SparkContext._active_spark_context._jvm
    spark = jvm.org.apache.spark.sql

    def call(name: str, kind: object, method: str, argument: object) -> object:
        owner = jvm.java.lang.Class.forName(name, True, jvm.java.lang.Thread.currentThread().getContextClassLoader())
        none = getattr(getattr(jvm.scala, "None$"), "MODULE$")
        return spark.catalyst.expressions.objects.StaticInvoke(owner, kind, method, jvm.PythonUtils.toSeq([argument]), jvm.PythonUtils.toSeq([]), True, True, True, none)

    java_text = spark.types.ObjectType(jvm.java.lang.Class.forName("java.lang.String"))
    digits = call("com.fasterxml.jackson.core.io.schubfach.DoubleToDecimal", java_text, "toString", spark.classic.ExpressionUtils.expression(value.cast("double")._jc))
    text = Column(spark.classic.ExpressionUtils.column(call("org.apache.spark.unsafe.types.UTF8String", spark.types.DataTypes.StringType, "fromString", digits)))
    # It gives two digits where one would do, which only the least reals show: 4.9E-324.
    one = F.format_string("%.0E", value)
    return F.when((value > 0) & (value < 2e-322) & (one.try_cast("double") == value), one).otherwise(text)


def plain_real(value: Column) -> Column:
    """The decimal digits of a real without an exponent and without a fraction of 0: 1e20 as a 1 and
    twenty zeros, 0.0005 as it is written."""

    def spelled(text: Column) -> Column:
        mantissa = F.regexp_replace(F.substring_index(text, "E", 1), r"\.0$", "")
        power = F.when(text.contains("E"), F.substring_index(text, "E", -1)).cast("int")
        digits = F.replace(mantissa, F.lit("."), F.lit(""))
        size, whole = F.char_length(digits), power + 1
        large = F.when(size <= whole, F.rpad(digits, whole, F.lit("0"))).otherwise(F.concat(F.left(digits, whole), F.lit("."), F.substr(digits, whole + 1)))
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -whole), digits)
        return F.when(power.isNull(), mantissa).when(power >= 0, large).otherwise(small)

    # As a lambda's variable the text is made once; repeated, it would outgrow what Java compiles.
    plain = F.get(F.transform(F.array(shortest(F.abs(value))), spelled), F.lit(0))
    sign = F.when(value < 0, "-").otherwise("")
    return F.when(value.isNull(), None).when(F.isnan(value), "nan").when(F.abs(value) == float("inf"), F.concat(sign, F.lit("inf"))).otherwise(F.concat(sign, plain))


def as_text(value: Typed) -> Column:
    """Decimal digits; reals without a fraction as integers, truth values as 1 and 0."""
    if value.family is Family.REAL:
        return F.when(value.column.isNotNull(), plain_real(value.column))
    if value.family is Family.BOOL:
        return value.column.cast("bigint").cast("string")
    return value.column.cast("string")


def as_number(text: Column, family: Family) -> Column:
    """A text as a number. What does not look like one whole becomes a text that Spark refuses, too."""
    return F.when(text.rlike(NUMBER[family]), text).otherwise(F.concat(F.lit("not a number: "), text)).cast(family.value)


def cast(value: Typed, family: Family) -> Column:
    if value.family is family:
        return value.column
    if value.family is Family.NULL:
        return null(family)
    if family in (Family.TEXT, Family.BLOB):
        text = as_text(value)
        return text if family is Family.TEXT else text.cast("binary")
    column = value.column.cast("string") if value.family is Family.BLOB else value.column
    return as_number(column, family) if value.family in (Family.TEXT, Family.BLOB) and family in NUMBER else column.cast(family.value)


def unified(families: list[Family]) -> Family:
    """The family that branches of one value share: text beside anything, real beside whole numbers."""
    known = {Family.INT if x is Family.BOOL else x for x in families} - {Family.NULL}
    if not known:
        return Family.NULL
    if len(known) == 1:
        return Family.BOOL if set(families) - {Family.NULL} == {Family.BOOL} else known.pop()
    if known == {Family.INT, Family.REAL}:
        return Family.REAL
    if known == {Family.BLOB, Family.TEXT} or Family.TEXT in known or Family.BLOB in known:
        return Family.TEXT
    raise SqlError("TypeMismatch")


def truth(value: Typed) -> Column:
    """Whether a value counts as true: integers that are not 0, and any text or real but null."""
    if value.family is Family.BOOL:
        return value.column
    if value.family is Family.INT:
        return value.column != F.lit(0).cast("bigint")
    if value.family is Family.NULL:
        return F.lit(None).cast("boolean")
    return F.when(value.column.isNull(), F.lit(None).cast("boolean")).otherwise(F.lit(True))
