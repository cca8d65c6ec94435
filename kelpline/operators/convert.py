"""Typed conversion of source values to the stored kinds, structs to dotted names, and the envelope of single updates."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The nullable value columns of a long samples table, one for each stored kind.
KINDS = {"bool": "boolean", "int": "int", "long": "bigint", "float": "float", "double": "double", "string": "string", "bytes": "binary"}
#: Source types to the kind that stores them.
STORED = {"bool": "bool", "int8": "int", "int16": "int", "int32": "int", "int64": "long", "uint8": "int", "uint16": "int", "uint32": "int", "uint64": "long", "float32": "float", "float64": "double", "string": "string"}


def wrap_unsigned(value: Column, bits: int) -> Column:
    """An unsigned value as the signed one with the same bits: 32 bits and fewer become int, 64 become long. Casts would raise."""
    width, kind = (64, "long") if bits == 64 else (32, "int")
    half, full = F.lit(Decimal(2 ** (width - 1))), F.lit(Decimal(2**width))
    return (F.pmod(value.cast("decimal(38,0)") + half, full) - half).cast(kind)


def stored_values(df: DataFrame, kind: str, value: str) -> DataFrame:
    """Spreads one column of values into v_bool … v_bytes by the row's source type; others are null. Unsigned values wrap."""
    out = df
    for k, sql in KINDS.items():
        cases = None
        for source, to in STORED.items():
            if to != k:
                continue
            v = F.col(value)
            v = wrap_unsigned(v.try_cast("decimal(38,0)"), int(source[4:])) if source.startswith("uint") else v.try_cast(sql)
            cases = F.when(F.col(kind) == source, v) if cases is None else cases.when(F.col(kind) == source, v)
        out = out.withColumn(f"v_{k}", (F.lit(None) if cases is None else cases).cast(sql))
    return out


def flatten_structs(df: DataFrame) -> DataFrame:
    """Structs to columns with dotted names, recursively; names are quoted, so dots within names do no harm."""

    def walk(c: Column, kind: T.DataType, name: str):
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                yield from walk(c.getField(f.name), f.dataType, f"{name}.{f.name}")
        else:
            yield c.alias(name)

    return df.select(*[x for f in df.schema.fields for x in walk(F.col(f"`{f.name}`"), f.dataType, f.name)])


def struct_array_rows(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Cells of a struct array as (keys, pos, name, value): names repeat from cell to cell and carry no index; values as text."""
    fields = df.schema[column].dataType.elementType.fields
    cell = F.posexplode(column).alias("pos", "cell")
    pairs = F.array(*[F.struct(F.lit(f"{column}.{f.name}").alias("name"), F.col("cell").getField(f.name).cast("string").alias("value")) for f in fields])
    return df.select(*keys, cell).select(*keys, "pos", F.inline(pairs))


def unwrap_union(variants: list[str]) -> Column:
    """The member of a union that is set, under the union's own name."""
    return F.coalesce(*[F.col(v).cast("string") for v in variants])


def null_literal(c: Column) -> Column:
    """Null values are stored as the string `null`."""
    return F.coalesce(c.cast("string"), F.lit("null"))


def dump_value(c: Column) -> Column:
    """Values of types that have no kind of their own, as text."""
    return F.to_json(F.struct(c.alias("value")))


def default_mode(updates: DataFrame, strict: bool, now: Column | None = None) -> DataFrame:
    """Single updates (value, alarm, seconds, nanos, compound): adds accepted and reason.

    strict: value, alarm and both parts of the time must be there and the value not be compound. Otherwise only the value is
    required, and a missing time becomes `now`, which the caller fixes, with nanoseconds zero."""
    timed = F.col("seconds").isNotNull() & F.col("nanos").isNotNull()
    reason = F.when(F.col("value").isNull(), "no value")
    if strict:
        reason = reason.when(F.col("alarm").isNull(), "no alarm").when(~timed, "no timestamp").when(F.col("compound"), "compound value")
        return updates.withColumn("reason", reason).withColumn("accepted", reason.isNull())
    out = updates.withColumn("reason", reason).withColumn("accepted", reason.isNull())
    seconds, nanos = F.when(timed, F.col("seconds")).otherwise(now), F.when(timed, F.col("nanos")).otherwise(F.lit(0))
    return out.withColumn("t_seconds", seconds.cast("long")).withColumn("t_nanos", nanos.cast("int")).withColumn("seconds", F.col("t_seconds")).withColumn("nanos", F.col("t_nanos")).drop("t_seconds", "t_nanos")


def flatten_values(df: DataFrame, keys: list[str], scalars: list[str], arrays: list[str]) -> DataFrame:
    """Values of typed columns as rows (keys, column, pos, value): a scalar column holds a list and gives one row for each value; an
    array column gives one row in all."""
    parts = [df.select(*keys, F.lit(c).alias("column"), F.posexplode(c).alias("pos", "v")).withColumn("value", F.col("v").cast("string")).drop("v") for c in scalars]
    parts += [df.select(*keys, F.lit(c).alias("column"), F.lit(0).alias("pos"), F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: x.cast("string")), ","), F.lit("]")).alias("value")) for c in arrays]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
