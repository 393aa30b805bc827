"""Table schemas, defaults and errors of the knowledge graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA_VERSION = 4


class GraphError(Exception):
    """Base of every error that the engine raises."""


class EntityNotFound(GraphError): ...


class RelationNotFound(GraphError): ...


class HyperedgeNotFound(GraphError): ...


class VersionNotFound(GraphError): ...


class InvalidVectorDimension(GraphError): ...


class InvalidDepth(GraphError): ...


class InvalidWeight(GraphError): ...


class InvalidArity(GraphError): ...


class DuplicateVersionName(GraphError): ...


class InvalidMerge(GraphError): ...


class VersionLimitExceeded(GraphError): ...


class CorruptBitSlot(GraphError): ...


class InvalidInput(GraphError): ...


def _table(*fields: str) -> dict[str, tuple[T.DataType, object]]:
    kinds = {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "floats": T.ArrayType(T.FloatType()), "longs": T.ArrayType(T.LongType()), "binary": T.BinaryType()}
    out = {}
    for f in fields:
        name, kind, *default = f.split(":")
        out[name] = (kinds[kind], default[0] if default else None)
    return out


#: table -> column -> (type, default literal)
TABLES: dict[str, dict[str, tuple[T.DataType, object]]] = {
    "kg_entities": _table(
        "id:long", "entity_type:string", "name:string", "properties:string", "created_at:long", "updated_at:long", "confidence:double:1.0", "access_count:long:0",
        "last_accessed:long", "valid_from:long", "valid_until:long", "base_confidence:double:1.0", "decay_rate:double:0.05", "validity:long",
    ),
    "kg_relations": _table(
        "id:long", "source_id:long", "target_id:long", "rel_type:string", "weight:double:1.0", "properties:string", "created_at:long", "confidence:double:1.0",
        "valid_from:long", "valid_until:long", "validity:long",
    ),
    "kg_vectors": _table("entity_id:long", "vector:floats", "dimension:int", "created_at:long"),
    "kg_hyperedges": _table("id:long", "hyperedge_type:string", "entity_ids:longs", "weight:double:1.0", "arity:int", "properties:string", "created_at:long", "updated_at:long"),
    "kg_dependencies": _table("id:long", "source_id:long", "target_id:long", "dep_type:string", "created_at:long"),
    "kg_confidence_log": _table("id:long", "entity_id:long", "old_value:double", "new_value:double", "reason:string", "created_at:long"),
    "kg_versions": _table("id:long", "name:string", "branch:string:main", "parent_id:long", "description:string", "created_at:long", "is_merged:boolean:false", "bit_slot:int"),
}


def struct_type(table: str) -> T.StructType:
    return T.StructType([T.StructField(c, t) for c, (t, _) in TABLES[table].items()])


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], struct_type(table))


def conform(df: DataFrame, table: str) -> DataFrame:
    """Brings an older or partial table to the current schema: missing columns get their defaults, others are cast.

    Null weights become 1.0. A binary weight is read as a little-endian double or float.
    """
    out = []
    for name, (kind, default) in TABLES[table].items():
        if name not in df.columns:
            col = F.lit(default).cast(kind)
        elif name == "weight" and isinstance(df.schema[name].dataType, T.BinaryType):
            col = _blob_weight(F.col(name))
        else:
            col = F.col(name).cast(kind)
        out.append((F.coalesce(col, F.lit(1.0)) if name == "weight" else col).alias(name))
    return df.select(out)


def _blob_weight(col):
    """A weight kept as 8 or 4 little-endian bytes; other sizes count as 1.0."""

    def bits(size: int):
        total = F.lit(0).cast("long")
        for k in range(size):
            total = total.bitwiseOR(F.shiftleft(F.conv(F.hex(F.substring(col, k + 1, 1)), 16, 10).cast("long"), 8 * k))
        return total

    b = bits(8)
    sign = F.when(F.shiftrightunsigned(b, 63) == 1, -1.0).otherwise(1.0)
    exp = F.shiftrightunsigned(b, 52).bitwiseAND(F.lit(0x7FF)).cast("int")
    double = sign * (1 + b.bitwiseAND(F.lit((1 << 52) - 1)) / float(1 << 52)) * F.pow(F.lit(2.0), exp - 1023)
    f = bits(4)
    fsign = F.when(F.shiftrightunsigned(f, 31) == 1, -1.0).otherwise(1.0)
    fexp = F.shiftrightunsigned(f, 23).bitwiseAND(F.lit(0xFF)).cast("int")
    single = fsign * (1 + f.bitwiseAND(F.lit((1 << 23) - 1)) / float(1 << 23)) * F.pow(F.lit(2.0), fexp - 127)
    size = F.octet_length(col)
    return F.when((size == 8) & (exp > 0), double).when((size == 8), 0.0).when((size == 4) & (fexp > 0), single).when(size == 4, 0.0).otherwise(1.0)


def check_weight(weight: float) -> None:
    if not 0.0 <= weight <= 1.0:
        raise InvalidWeight(weight)


def check_depth(depth: int, most: int) -> None:
    if depth > most or depth < 0:
        raise InvalidDepth(depth)
