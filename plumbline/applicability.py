"""Whether checks and analyzers can run on a schema, tried on generated rows."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.checks import Check
from plumbline.operators.base import Analyzer
from plumbline.plans.runner import run_analysis

ROWS = 1000
NULL_SHARE = 0.01


@dataclass(frozen=True)
class Applicability:
    """applicable: every one can run. failures: what each that cannot says."""

    applicable: bool
    failures: dict[str, Exception]


def _random(kind: T.DataType, seed: int) -> Column:
    r = F.rand(seed)
    if isinstance(kind, T.BooleanType):
        return r < 0.5
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return (r * 100).cast(kind)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return (r * 1000).cast(kind)
    if isinstance(kind, T.DecimalType):
        return (r * (10 ** min(kind.precision - kind.scale, 6) - 1)).cast(kind)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.timestamp_seconds((r * 1_700_000_000).cast("long")).cast(kind)
    if isinstance(kind, T.DateType):
        return F.date_add(F.lit("2000-01-01").cast("date"), (r * 9000).cast("int"))
    if isinstance(kind, T.BinaryType):
        return F.unhex(F.md5((r * 1e9).cast("string")))
    if isinstance(kind, T.StructType):
        return F.struct(*(_random(f.dataType, seed * 31 + i + 1).alias(f.name) for i, f in enumerate(kind.fields)))
    if isinstance(kind, T.ArrayType):
        return F.array(_random(kind.elementType, seed * 31))
    if isinstance(kind, T.MapType):
        return F.create_map(_random(kind.keyType, seed * 31), _random(kind.valueType, seed * 37))
    return F.substring(F.md5((r * 1e9).cast("string")), 1, 16).cast(kind)


def random_rows(schema: T.StructType, spark: SparkSession, rows: int = ROWS) -> DataFrame:
    """Rows of the schema; nullable fields are null in a hundredth of them."""
    columns = []
    for i, f in enumerate(schema.fields):
        x = _random(f.dataType, i + 1)
        columns.append((F.when(F.rand(1000 + i) >= NULL_SHARE, x) if f.nullable else x).alias(f.name))
    return spark.range(rows).select(*columns)


def analyzer_applicability(analyzers: Iterable[Analyzer], schema: T.StructType, spark: SparkSession) -> Applicability:
    context = run_analysis(random_rows(schema, spark), analyzers)
    failures = {str(a): m.outcome.error for a, m in context.metrics.items() if not m.ok}
    return Applicability(not failures, failures)


def check_applicability(check: Check, schema: T.StructType, spark: SparkSession) -> Applicability:
    found = analyzer_applicability(check.required_analyzers(), schema, spark)
    by_constraint = {str(c): found.failures[str(c.analyzer)] for c in check.constraints if str(c.analyzer) in found.failures}
    return Applicability(found.applicable, by_constraint)
