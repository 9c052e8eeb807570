"""Fact tables over ordinary tables, so that every operator can be run and checked at any scale without source code.

parts are definitions, line items are calls, orders are bindings, events are hooks, and customers and suppliers make a
sparse graph.  The same definitions in SQL are in callweave.plans.oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.model import Facts
from callweave.operators.storage import stored

LANGS = ("python", "javascript", "php", "ruby", "go")
#: Ids of class rows stand above those of parts.
CLASS_IDS = 1_000_000_000_000
TIERS = {"AUTOMOBILE": "exact", "BUILDING": "exact", "FURNITURE": "inferred", "HOUSEHOLD": "ambiguous", "MACHINERY": "hook"}
KINDS = {"1-URGENT": "construct", "2-HIGH": "hint", "3-MEDIUM": "shadow", "4-NOT SPECIFIED": "construct", "5-LOW": "mixin"}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _lang(n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in LANGS]), (n % len(LANGS)).cast("int") + 1)


def _mapped(c: Column, table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[c]


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    lang = _lang(F.col("p_size"))
    free = F.col("p_partkey") % 4 == 0
    one = p.select(
        F.col("p_partkey").alias("id"), F.col("p_type").alias("file"), F.col("p_name").alias("name"), F.when(free, "function").otherwise("method").alias("kind"),
        F.when(~free, F.col("p_brand")).alias("container"), lang.alias("lang"), (F.col("p_partkey") % 1000 + 1).cast("int").alias("start_line"), F.col("p_partkey").alias("start_byte"),
    )
    number = F.regexp_extract("p_brand", r"(\d+)", 1).cast("long")
    classes = p.select(F.col("p_brand"), lang.alias("lang"), (F.col("p_size") % len(LANGS)).cast("long").alias("l"), number.alias("b")).distinct()
    classes = classes.select((F.lit(CLASS_IDS) + F.col("b") * 10 + F.col("l")).alias("id"), F.col("p_brand").alias("file"), F.col("p_brand").alias("name"), F.lit("class").alias("kind"), F.lit(None).cast("string").alias("container"), "lang", F.lit(1).alias("start_line"), F.lit(0).cast("long").alias("start_byte"))
    return one.unionByName(classes)


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    n = p.select(F.count("*").alias("n"))  # one row
    x = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").agg(F.min("l_returnflag").alias("flag"))
    x = x.crossJoin(F.broadcast(n)).withColumn("src_symbol", F.col("l_orderkey") % F.col("n"))
    called = p.select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("callee"), F.col("p_brand").alias("brand"), _lang(F.col("p_size")).alias("lang"))
    caller = p.select(F.col("p_partkey").alias("src_symbol"), F.col("p_type").alias("file"))
    x = x.join(called, "l_partkey").join(caller, "src_symbol")
    ident = ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1_000_000 + F.col("l_partkey")) * 10_000 + F.col("l_suppkey")
    receiver = F.when(F.col("flag") == "A", "").when(F.col("flag") == "N", "self").otherwise(F.col("brand"))
    return x.select(ident.alias("id"), "file", "lang", "callee", receiver.alias("receiver"), F.col("l_linenumber").cast("int").alias("line"), "src_symbol")


def assigns(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    n = p.select(F.count("*").alias("n"))
    o = read(spark, sf_dir, "orders").crossJoin(F.broadcast(n))
    scope, var, cls = F.col("o_orderkey") % F.col("n"), (F.col("o_orderkey") * 7 + F.col("o_custkey")) % F.col("n"), (F.col("o_custkey") * 3) % F.col("n")
    o = o.select(scope.alias("scope"), var.alias("v"), cls.alias("c"), _mapped(F.col("o_orderpriority"), KINDS).alias("kind"), (F.col("o_orderstatus") == "P").alias("top"))
    part = lambda k, *cols: p.select(F.col("p_partkey").alias(k), *cols)
    o = o.join(part("scope", F.col("p_type").alias("file"), _lang(F.col("p_size")).alias("lang")), "scope").join(part("v", F.col("p_brand").alias("var")), "v").join(part("c", F.col("p_brand").alias("cls")), "c")
    inside = F.when(~F.col("top") | (F.col("kind") == "mixin"), F.col("scope"))
    return o.select("file", "lang", inside.alias("scope_symbol"), "var", F.when(F.col("kind") == "shadow", "").otherwise(F.col("cls")).alias("cls"), "kind")


def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every link of the pages: path-style modules."""
    p = read(spark, sf_dir, "pages").select(F.concat(F.lit("page"), F.col("page_id")).alias("file"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("module"))
    return p


#: File extensions of the dialects of `module_symbols`.
EXTENSIONS = (".py", ".js", ".php", ".rb", ".go")


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as definitions in files of packages: k, name, brand, pkg, mod, lang, file."""
    p = read(spark, sf_dir, "part")
    pkg, mod = F.concat(F.lit("pkg"), F.regexp_extract("p_brand", r"(\d+)", 1)), F.concat(F.lit("mod"), F.col("p_size") % 7)
    ext = F.element_at(F.array(*[F.lit(x) for x in EXTENSIONS]), (F.col("p_size") % len(EXTENSIONS)).cast("int") + 1)
    return p.select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), pkg.alias("pkg"), mod.alias("mod"), _lang(F.col("p_size")).alias("lang"), F.concat(F.lit("src/"), pkg, F.lit("/"), mod, ext).alias("file"))


def module_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, free = _places(spark, sf_dir), F.col("k") % 2 == 0
    return p.select(F.col("k").alias("id"), "file", "name", F.when(free, "function").otherwise("method").alias("kind"), F.when(~free, F.col("brand")).alias("container"), "lang", F.lit(1).alias("start_line"), F.col("k").alias("start_byte"))


def module_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as calls through a parent (flag A) or through the module of the part; every ninth stands outside any definition."""
    p, n = _places(spark, sf_dir), read(spark, sf_dir, "part").select(F.count("*").alias("n"))
    x = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").agg(F.min("l_returnflag").alias("flag"))
    x = x.crossJoin(F.broadcast(n)).withColumn("at", F.col("l_orderkey") % F.col("n"))
    x = x.join(p.select(F.col("k").alias("l_partkey"), F.col("name").alias("callee"), "lang", "pkg", "mod"), "l_partkey").join(p.select(F.col("k").alias("at"), "file"), "at")
    module = F.when(F.col("lang") == "python", F.concat("pkg", F.lit("."), "mod")).when(F.col("lang") == "go", F.col("pkg")).otherwise(F.col("mod"))
    ident = ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1_000_000 + F.col("l_partkey")) * 10_000 + F.col("l_suppkey")
    return x.select(ident.alias("id"), "file", "lang", "callee", F.when(F.col("flag") == "A", "super()").otherwise(module).alias("receiver"), F.col("l_linenumber").cast("int").alias("line"), F.when(F.col("l_orderkey") % 9 != 0, F.col("at")).alias("src_symbol"))


def module_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as imports of one part's module by another part's file; in Python dotted, elsewhere as a path."""
    p, n = _places(spark, sf_dir), read(spark, sf_dir, "part").select(F.count("*").alias("n"))
    o = read(spark, sf_dir, "orders").crossJoin(F.broadcast(n)).select((F.col("o_orderkey") % F.col("n")).alias("a"), ((F.col("o_custkey") * 3) % F.col("n")).alias("b"))
    module = F.when(F.col("lang") == "python", F.concat("pkg", F.lit("."), "mod")).when(F.col("lang") == "go", F.concat(F.lit("tree.org/"), "pkg")).otherwise(F.concat(F.lit("./"), "pkg", F.lit("/"), "mod"))
    return o.join(p.select(F.col("k").alias("a"), "file"), "a").join(p.select(F.col("k").alias("b"), module.alias("module")), "b").select("file", "module")


def module_facts(spark: SparkSession, sf_dir: str) -> Facts:
    return Facts(spark, symbols=stored(module_symbols(spark, sf_dir), "symbols"), refs=stored(module_refs(spark, sf_dir), "refs"), imports=stored(module_imports(spark, sf_dir), "imports"))


def hooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    n = p.select(F.count("*").alias("n"))
    e = read(spark, sf_dir, "events").crossJoin(F.broadcast(n))
    listen = F.col("event_id") % 50 == 0
    name = F.concat(F.when(F.col("user_id") % 7 == 0, "wp_ajax_nopriv_").when(F.col("user_id") % 7 == 1, "admin_post_").otherwise(""), "event_type", F.lit("_"), F.col("user_id") % 97)
    e = e.select("event_id", listen.alias("listen"), name.alias("hook"), (F.col("event_id") % F.col("n")).alias("at"), ((F.col("event_id") * 31 + F.col("user_id")) % F.col("n")).alias("cb"), (F.col("event_id") % 100 == 0).alias("free"))
    here = p.select(F.col("p_partkey").alias("at"), F.col("p_type").alias("file"))
    there = p.select(F.col("p_partkey").alias("cb"), F.col("p_name").alias("cb_name"), F.col("p_brand").alias("brand"))
    e = e.join(here, "at").join(there, "cb")
    only = lambda c: F.when(F.col("listen"), c)
    return e.select(
        F.col("event_id").alias("id"), "file", F.lit("php").alias("lang"), F.when(F.col("listen"), "listen").otherwise("fire").alias("kind"), "hook", F.col("hook").alias("hook_raw"), F.when(F.col("listen"), "action").otherwise("fire").alias("hook_class"),
        F.col("at").alias("enclosing_symbol"), only(F.when(F.col("free"), "free").otherwise("static")).alias("cb_kind"), only(F.col("cb_name")).alias("cb_name"), only(F.when(~F.col("free"), F.col("brand"))).alias("cb_container"),
        F.lit(None).cast("string").alias("cb_recv"), F.lit(None).cast("string").alias("cb_raw"), F.lit(None).cast("long").alias("callback_symbol"), F.lit(False).alias("entry_point"), F.lit(False).alias("unauth"), F.lit("").alias("note"), (F.col("event_id") % 100 + 1).cast("int").alias("line"),
    )


def facts(spark: SparkSession, sf_dir: str, *names: str) -> Facts:
    """The named fact tables, or all; like the facts of an index they are tables in storage, which plans read many times."""
    made = {"symbols": symbols, "refs": refs, "assigns": assigns, "imports": imports, "hooks": hooks}
    return Facts(spark, **{t: stored(made[t](spark, sf_dir), t) for t in names or made})


# --- a sparse graph ---
def graph_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = read(spark, sf_dir, "customer"), read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("file"))
    return c.join(n, "c_nationkey").select(F.col("c_custkey").alias("id"), "file", F.col("c_name").alias("name"), F.lit("method").alias("kind"), F.col("c_mktsegment").alias("container"), F.lit("go").alias("lang"), (F.col("c_custkey") % 1000).cast("int").alias("start_line"), F.col("c_custkey").alias("start_byte"))


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One edge for every customer and supplier."""
    c, s = read(spark, sf_dir, "customer"), read(spark, sf_dir, "supplier")
    n = c.select(F.count("*").alias("n"))
    nation = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("file"))
    a = c.crossJoin(F.broadcast(n)).select(F.col("c_custkey").alias("src"), ((F.col("c_custkey") * 7919 + F.col("c_nationkey") * 13) % F.col("n")).alias("dst"), _mapped(F.col("c_mktsegment"), TIERS).alias("resolution"), F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("ref_id"))
    b = s.crossJoin(F.broadcast(n)).select(((F.col("s_suppkey") * 13) % F.col("n")).alias("src"), ((F.col("s_suppkey") * 101 + F.col("s_nationkey")) % F.col("n")).alias("dst"), F.lit("exact").alias("resolution"), F.col("s_nationkey").alias("k"), (F.col("s_suppkey") + 1_000_000_000).alias("ref_id"))
    e = a.unionByName(b).join(nation, "k")
    hook = F.col("resolution") == "hook"
    return e.select("src", "dst", F.when(hook, "hook").otherwise("calls").alias("kind"), "resolution", "file", F.lit(1).alias("line"), F.when(~hook, F.col("ref_id")).alias("ref_id"))
