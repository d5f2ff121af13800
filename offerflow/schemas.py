"""The entity tables: columns, keys, defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.text import epoch_timestamp, int_or_null, strip_newlines, thousands_float


def _struct(spec: str) -> T.StructType:
    """``name:type``; ``text`` is a string that keeps its line feeds."""
    kinds = {"string": T.StringType(), "text": T.StringType(), "long": T.LongType(), "double": T.DoubleType(), "timestamp": T.TimestampType(), "binary": T.BinaryType()}
    return T.StructType([T.StructField(n, kinds[k], True, {"kind": k}) for n, k in (x.split(":") for x in spec.split())])


OFFERS = _struct("url:string siteid:string sitename:string title:string shop:text image:string address:text city:text cityid:string geoinfo:string details:text detailsimg:text category:string bought:long original:double discount:double saved:double current:double geogrid:long starttime:timestamp duetime:timestamp")
SITES = _struct("siteid:string updateserver:string enqueuetime:timestamp lastupdate:timestamp error:text data:binary")
SERVERS = _struct("address:string servertype:string sites:string lastupdate:timestamp cpu_usage:double outgoing_bandwidth:double incomming_bandwidth:double datastore:double email:double")
TABLES = {"offers": (OFFERS, "url"), "sites": (SITES, "siteid"), "servers": (SERVERS, "address")}
DEFAULTS = {"string": "", "text": "", "long": 0, "double": 0.0, "binary": b""}


def table(name: str) -> tuple[T.StructType, str]:
    if name not in TABLES:
        raise ValueError(f"no table {name}")
    return TABLES[name]


def with_type_defaults(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Null becomes the default of the column's type; times stay null."""
    kinds = {f.name: f.metadata["kind"] for f in schema}
    return df.select(*[F.coalesce(c, F.lit(DEFAULTS[kinds[c]])).alias(c) if kinds.get(c) in DEFAULTS else F.col(c) for c in df.columns])


def coerce(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Text columns cast to the schema's types; columns that have their type already, or that it lacks, stay."""
    casts = {"long": int_or_null, "double": thousands_float, "timestamp": epoch_timestamp, "string": strip_newlines, "text": lambda c: c}
    kinds = {f.name: f.metadata["kind"] for f in schema}
    return df.select(*[casts[kinds[f.name]](F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) and kinds.get(f.name) in casts else F.col(f.name) for f in df.schema])
