"""Column expressions and schema checks that metrics share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.model import MetricError


class PreconditionError(MetricError):
    pass


def only_where(x: Column, where: str | None) -> Column:
    """x for rows that meet a filter, null for the others."""
    return x if where is None else F.when(F.expr(where), x)


def count_where(where: str | None) -> Column:
    """Rows that meet a filter; null on an empty input with a filter."""
    return F.count(F.lit(1)) if where is None else F.sum(F.coalesce(F.expr(where), F.lit(False)).cast("long"))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole; NaN for an empty whole."""
    return F.when(whole == 0, F.lit(float("nan"))).otherwise(part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0)))


def field_of(schema: T.StructType, path: str) -> T.StructField | None:
    """The field at a dotted path, in any case; names may hold dots or be back-quoted."""

    def find(struct: T.StructType, rest: str) -> T.StructField | None:
        low = rest.lower()
        for f in struct.fields:
            name = f.name.lower()
            if low in (name, f"`{name}`"):
                return f
            for head in (name, f"`{name}`"):
                if low.startswith(head + ".") and isinstance(f.dataType, T.StructType):
                    found = find(f.dataType, rest[len(head) + 1 :])
                    if found is not None:
                        return found
        return None

    return find(schema, path)


def exists(column: str):
    def check(schema: T.StructType) -> None:
        if field_of(schema, column) is None:
            raise PreconditionError(f"Input data does not include column {column}!")

    return check


def not_nested(column: str):
    def check(schema: T.StructType) -> None:
        f = field_of(schema, column)
        if f is not None and isinstance(f.dataType, (T.StructType, T.MapType, T.ArrayType)):
            raise PreconditionError(f"Unsupported nested column type of column {column}: {f.dataType.simpleString()}!")

    return check


def numeric(column: str):
    def check(schema: T.StructType) -> None:
        exists(column)(schema)
        kind = field_of(schema, column).dataType
        if not isinstance(kind, T.NumericType):
            raise PreconditionError(f"Expected type of column {column} to be numeric, but found {kind.simpleString()} instead!")

    return check


def text(column: str):
    def check(schema: T.StructType) -> None:
        exists(column)(schema)
        kind = field_of(schema, column).dataType
        if not isinstance(kind, (T.StringType, T.VarcharType, T.CharType)):
            raise PreconditionError(f"Expected type of column {column} to be string, but found {kind.simpleString()} instead!")

    return check


def at_least_one(columns: tuple[str, ...]):
    def check(schema: T.StructType) -> None:
        if not columns:
            raise PreconditionError("At least one column needs to be specified!")

    return check


def exactly(n: int, columns: tuple[str, ...]):
    def check(schema: T.StructType) -> None:
        if len(columns) != n:
            raise PreconditionError(f"{n} columns have to be specified! Currently, columns contains only {len(columns)} column(s): {','.join(columns)}!")

    return check
