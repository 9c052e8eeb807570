"""Schemas of the fact tables and of what is derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SCHEMA_VERSION = 1

FILES = "path string, lang string, hash string, mtime double, size long, indexed_at double, warnings array<string>"
SYMBOLS = "id long, file string, name string, kind string, container string, lang string, start_line int, end_line int, start_byte long, end_byte long, signature string"
REFS = "id long, file string, lang string, callee string, receiver string, line int, src_symbol long"
IMPORTS = "file string, module string"
ASSIGNS = "file string, lang string, scope_symbol long, var string, cls string, kind string"
HOOKS = (
    "id long, file string, lang string, kind string, hook string, hook_raw string, hook_class string, enclosing_symbol long, cb_kind string, cb_name string, "
    "cb_container string, cb_recv string, cb_raw string, callback_symbol long, entry_point boolean, unauth boolean, note string, line int"
)
EDGES = "src long, dst long, kind string, resolution string, file string, line int, ref_id long"
UNRESOLVED = "file string, lang string, callee string, receiver string, line int, src_symbol long, ref_id long"

#: Tables extracted from files, and tables computed from all of those.
FACTS = {"files": FILES, "symbols": SYMBOLS, "refs": REFS, "imports": IMPORTS, "assigns": ASSIGNS, "hooks": HOOKS}
DERIVED = {"edges": EDGES, "unresolved": UNRESOLVED}
TABLES = FACTS | DERIVED


def schema(table: str) -> StructType:
    return StructType.fromDDL(TABLES[table])


def conform(df: DataFrame, table: str) -> DataFrame:
    """df with the columns and types of the current schema: columns an older writer lacked are null."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(table)])


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema(table)])


class Facts(dict):
    """Fact tables by name; a missing one is empty."""

    def __init__(self, spark: SparkSession, **tables: DataFrame):
        super().__init__({name: conform(tables[name], name) if name in tables else empty(spark, name) for name in FACTS})
        self.spark = spark

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self[name]
        except KeyError:
            raise AttributeError(name) from None
