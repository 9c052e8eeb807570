"""Registered queries over generated programs, constants, Python dispatch and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.functions import expressions as X
from callweave.model import Facts
from callweave.operators import lookups, traverse
from callweave.operators.storage import stored
from callweave.parse.extract import facts_from, parse_files
from callweave.plans import hooks as H
from callweave.plans.queries import query
from callweave.plans.resolve import call_edges, resolve_refs
from callweave.sources import tables as T
from callweave.sources.programs import programs

_STEPS = {"@receiver": "signal", "@task": "task", "connect": "signal", "route": "route"}


# --- extraction ---
def _extracted(spark: SparkSession, sf: str) -> Facts:
    return facts_from(stored(parse_files(programs(spark, sf)), "parsed"))


@query
def extracted_symbols(spark: SparkSession, sf: str) -> DataFrame:
    return _extracted(spark, sf).symbols.select("file", "name", "kind", "container", "start_line", "end_line", "signature")


@query
def extracted_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Calls with the name of the definition around them."""
    f = _extracted(spark, sf)
    inside = f.symbols.select(F.col("id").alias("src_symbol"), F.col("name").alias("inside"))
    return f.refs.join(inside, "src_symbol", "left").select("file", "callee", "receiver", "line", "inside")


@query
def extracted_bindings(spark: SparkSession, sf: str) -> DataFrame:
    """Typed bindings: constructions, annotations and mixins."""
    f = _extracted(spark, sf)
    inside = f.symbols.select(F.col("id").alias("scope_symbol"), F.col("name").alias("inside"))
    return f.assigns.where("kind <> 'shadow'").join(inside, "scope_symbol", "left").select("file", "var", "cls", "kind", "inside").distinct()


@query
def extracted_imports(spark: SparkSession, sf: str) -> DataFrame:
    return _extracted(spark, sf).imports.select("file", "module")


@query
def extracted_hooks(spark: SparkSession, sf: str) -> DataFrame:
    return _extracted(spark, sf).hooks.select("file", "kind", "hook", "hook_class", "cb_kind", "cb_name", "line")


@query
def program_edges(spark: SparkSession, sf: str) -> DataFrame:
    """From programs to edges: of equally named classes the call's own file decides."""
    f = _extracted(spark, sf)
    lang = f.symbols.select(F.col("id").alias("src"), "lang", F.col("name").alias("caller"))
    e = call_edges(resolve_refs(f)).join(f.symbols.select(F.col("id").alias("dst"), F.col("name").alias("callee"), "kind"), "dst")
    return e.drop("kind").join(lang, "src").groupBy("lang", "callee", "resolution").agg(F.count("*").alias("n"))


# --- dispatch ---
def _constants(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as constants: NAME_k, and KEY of a class; every seventh token has two values."""
    s = T.read(spark, sf, "supplier")
    k = F.col("s_suppkey")
    token = F.when(k % 2 == 0, F.concat(F.lit("NAME_"), k % 70)).otherwise(F.concat(F.lit("Brand"), k % 25, F.lit("::KEY")))
    value = F.concat(F.lit("v"), F.when(k % 7 == 0, k).otherwise(F.when(k % 2 == 0, k % 70).otherwise(k % 25)))
    return s.select(F.lit("c.php").alias("file"), F.lit("php").alias("lang"), F.lit(None).cast("long").alias("scope_symbol"), token.alias("var"), value.alias("cls"), F.lit("const").alias("kind"))


@query
def hook_constants(spark: SparkSession, sf: str) -> DataFrame:
    """Hook names with constants: events name one of NAME_k, BrandN::KEY or self::KEY between fixed parts."""
    p = T.read(spark, sf, "part")
    n = p.select(F.count("*").alias("n"))
    e = T.read(spark, sf, "events").crossJoin(F.broadcast(n)).withColumn("at", F.col("event_id") % F.col("n"))
    way, u = F.col("event_id") % 3, F.col("user_id")
    token = F.when(way == 0, F.concat(F.lit("NAME_"), u % 70)).when(way == 1, F.concat(F.lit("Brand"), u % 25, F.lit("::KEY"))).otherwise("self::KEY")
    hooks = e.select(F.col("event_id").alias("id"), F.lit("php").alias("lang"), F.concat(F.lit("on."), token, F.lit(".end")).alias("hook"), F.col("at").alias("enclosing_symbol"), F.lit("fire").alias("kind"))
    symbols = p.select(F.col("p_partkey").alias("id"), F.replace("p_brand", F.lit("#"), F.lit("")).alias("container"))
    f = Facts(spark, symbols=stored(symbols, "symbols"), hooks=stored(hooks, "hooks"), assigns=stored(_constants(spark, sf), "assigns"))
    return H.with_constants(f.hooks, f).select("id", "hook", "hook_raw")


def python_facts(spark: SparkSession, sf: str) -> Facts:
    """Events as signals, tasks and routes of Python: one in twenty listens, and some names have a Signal() behind them."""
    p = T.read(spark, sf, "part")
    n = p.select(F.count("*").alias("n"))
    i, u = F.col("event_id"), F.col("user_id")
    listen = i % 20 == 0
    e = T.read(spark, sf, "events").crossJoin(F.broadcast(n)).withColumn("at", i % F.col("n")).withColumn("cb", (i * 7 + u) % F.col("n"))
    here = p.select(F.col("p_partkey").alias("at"), F.col("p_type").alias("file"))
    there = p.select(F.col("p_partkey").alias("cb"), F.col("p_name").alias("cb_name"))
    notes = F.element_at(F.array(*[F.lit(x) for x in _STEPS]), (u % 4).cast("int") + 1)
    note = F.when(listen, notes).otherwise(F.when(u % 2 == 0, "signal").otherwise("task"))
    classes = F.create_map(*[F.lit(x) for pair in _STEPS.items() for x in pair])
    name = F.when(u % 6 == 0, "post_save").otherwise(F.concat(F.lit("sig"), (u + i) % 40))
    hooks = e.join(here, "at").join(there, "cb").select(
        i.alias("id"), "file", F.lit("python").alias("lang"), F.when(listen, "listen").otherwise("fire").alias("kind"), name.alias("hook"), F.when(listen, classes[note]).otherwise("fire").alias("hook_class"),
        F.col("at").alias("enclosing_symbol"), F.when(listen, "free").alias("cb_kind"), F.when(listen, F.col("cb_name")).alias("cb_name"), note.alias("note"), F.lit(1).alias("line"), F.lit(False).alias("entry_point"), F.lit(False).alias("unauth"),
    )
    made = T.read(spark, sf, "supplier").where("s_suppkey < 10").select(F.lit("s.py").alias("file"), F.lit("python").alias("lang"), F.concat(F.lit("sig"), F.col("s_suppkey")).alias("var"), F.lit("Signal").alias("cls"), F.lit("construct").alias("kind"))
    return Facts(spark, symbols=stored(T.symbols(spark, sf), "symbols"), hooks=stored(hooks, "hooks"), assigns=stored(made, "assigns"))


@query
def python_trusted(spark: SparkSession, sf: str) -> DataFrame:
    f = python_facts(spark, sf)
    return H.trusted(f.hooks, f).select("id", "kind", "hook")


@query
def python_dispatch(spark: SparkSession, sf: str) -> DataFrame:
    return H.resolve_hooks(python_facts(spark, sf))[1].groupBy("src", "dst", "file").agg(F.count("*").alias("n"))


@query
def hook_listeners(spark: SparkSession, sf: str) -> DataFrame:
    hooks = T.hooks(spark, sf).withColumn("callback_symbol", F.col("enclosing_symbol")).withColumn("cb_raw", F.col("cb_name"))
    return lookups.listeners(hooks, T.symbols(spark, sf).where("id % 2 = 0"), "click_5").select("id", "hook", "file", "callback", "cb_file", "cb_line")


@query
def hook_fires(spark: SparkSession, sf: str) -> DataFrame:
    return lookups.fires(T.hooks(spark, sf), "click_5").select("id", "file", "line")


@query
def hooks_by_callback(spark: SparkSession, sf: str) -> DataFrame:
    return lookups.hooks_of_symbol(T.hooks(spark, sf).withColumn("callback_symbol", F.col("enclosing_symbol")), 7).select("id", "kind", "hook")


# --- lookups and scalars ---
@query
def symbols_by_id(spark: SparkSession, sf: str) -> DataFrame:
    """The parts that suppliers' keys name."""
    return lookups.by_ids(T.symbols(spark, sf), T.read(spark, sf, "supplier").select((F.col("s_suppkey") * 3).alias("id"))).select("id", "name", "file")


@query
def file_states(spark: SparkSession, sf: str) -> DataFrame:
    """What is stored of each page's file: hash, size and time."""
    p = T.read(spark, sf, "pages")
    files = p.select(F.col("url").alias("path"), F.sha1(F.encode("html", "UTF-8")).alias("hash"), F.octet_length("html").cast("long").alias("size"), F.col("page_id").cast("double").alias("mtime"))
    return lookups.file_states(files, p.where("page_id % 3 = 0").select(F.col("url").alias("path")).distinct())


@query
def is_called(spark: SparkSession, sf: str) -> DataFrame:
    """Whether any caller of each of two customers is stored: an existence probe."""
    e = T.graph_edges(spark, sf)
    return spark.createDataFrame([(k, not e.where(F.col("dst") == k).limit(1).isEmpty()) for k in (3, 10**9)], "id long, called boolean")


@query
def receivers(spark: SparkSession, sf: str) -> DataFrame:
    """Labels, stripped receivers, module tails and clamped depths of parts."""
    p = T.read(spark, sf, "part")
    path: Column = F.concat(F.lit("./lib/"), F.replace("p_name", F.lit(" "), F.lit("/")), F.lit(".min.js"))
    depth = F.udf(lambda n: traverse.clamp(n, 1, 25, 3), "int")(F.col("p_size"))
    return p.select(
        "p_partkey", X.label(F.when(F.col("p_size") % 3 != 0, F.col("p_brand")).when(F.col("p_size") % 3 == 0, ""), F.col("p_name")).alias("label"),
        X.stripped(F.concat(F.lit("\t "), "p_name", F.lit(" \n"))).alias("receiver"), X.import_tail(path).alias("tail"), X.import_tail(F.col("p_name")).alias("no_tail"), depth.alias("depth"), X.targets_file(path, "widget.min.js").alias("hit"),
    )
