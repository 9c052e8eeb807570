"""String dispatch: hook names with constants filled in, callbacks, and edges from fires to callbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callweave.functions import languages as L
from callweave.model import HOOKS, Facts
from callweave.plans.resolve import definitions, type_environment

_COLUMNS = [c.split()[0] for c in HOOKS.split(", ")]


def constants(assigns: DataFrame) -> DataFrame:
    """(token, value) of PHP string constants; a token with two values is left out."""
    c = assigns.where("kind = 'const' and lang = 'php'").groupBy(F.col("var").alias("token")).agg(F.count_distinct("cls").alias("n"), F.max("cls").alias("value"))
    return c.where("n = 1").select("token", "value")


def _substituted(hooks: DataFrame, text: str, pieces: str, token: Column, consts: DataFrame) -> DataFrame:
    """hooks with column `text` rebuilt from its pieces, each replaced by its constant if it has one.

    Only different pieces meet the constants and only hooks with a hit are gathered; the text is rebuilt in place.
    """
    cut = F.regexp_extract_all(F.col(text), F.lit(pieces), F.lit(0))
    p = hooks.select("id", "container", F.explode(F.array_distinct(cut)).alias("piece")).withColumn("token", token).where("token is not null")
    hits = p.join(consts, "token").groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("piece", "value"))).alias("_map"))
    rebuilt = F.array_join(F.transform(cut, lambda x: F.coalesce(F.try_element_at("_map", x), x)), "")
    return hooks.join(hits, "id", "left").withColumn(text, F.when(F.col("_map").isNull(), F.col(text)).otherwise(rebuilt)).drop("_map")


def with_constants(hooks: DataFrame, facts: Facts) -> DataFrame:
    """hook_raw keeps the name as written; hook has PHP constants filled in, scoped ones first, then whole words.

    self:: and static:: mean the class around the hook.  Tokens without a constant stay as they are.
    """
    h = hooks.withColumn("hook_raw", F.coalesce("hook_raw", "hook")).withColumn("hook", F.col("hook_raw"))
    may = (F.col("lang") == "php") & F.col("hook").isNotNull() & F.col("hook").rlike("::|[A-Z_]")
    consts = constants(facts.assigns)
    inside = facts.symbols.select(F.col("id").alias("enclosing_symbol"), "container")
    some = h.where(may).join(inside, "enclosing_symbol", "left")
    scope, name = F.split_part("piece", F.lit("::"), F.lit(1)), F.split_part("piece", F.lit("::"), F.lit(2))
    real = F.when(scope.isin("self", "static") & (F.coalesce("container", F.lit("")) != ""), F.col("container")).otherwise(scope)
    some = _substituted(some, "hook", r"\w+::\w+|\w+|[^\w]+", F.when(F.col("piece").contains("::"), F.concat(real, F.lit("::"), name)), consts.where("token like '%::%'"))
    some = _substituted(some, "hook", r"\w+|[^\w]+", F.col("piece"), consts.where("token not like '%::%'"))
    return some.select(_COLUMNS).unionByName(h.where(~may | F.col("hook").isNull()).select(_COLUMNS))


def evidence(facts: Facts) -> DataFrame:
    """Names (python) that are known to be a signal or a task."""
    built_in = facts.spark.createDataFrame([(s,) for s in L.BUILTIN_SIGNALS], "hook string")
    made = facts.assigns.where("lang = 'python' and cls = 'Signal'").select(F.col("var").alias("hook"))
    heard = facts.hooks.where("lang = 'python' and kind = 'listen' and note in ('@receiver', '@task') and hook is not null").select("hook")
    return built_in.union(made).union(heard).distinct()


def trusted(hooks: DataFrame, facts: Facts) -> DataFrame:
    """Hooks that are dispatch for certain: all of PHP, decorators and routes, and in Python names with evidence."""
    known = evidence(facts).withColumn("_known", F.lit(True))
    sure = (F.col("lang") != "python") | F.col("note").isin("@receiver", "@task", "route") | F.col("_known")
    return hooks.join(known, "hook", "left").where(F.coalesce(sure, F.lit(False))).select(_COLUMNS)


def mechanism(lang: Column, tag: Column) -> Column:
    """Python signals and tasks have namespaces of their own; everything else shares one."""
    return F.when((lang == "python") & tag.isin("signal", "task"), tag).otherwise("")


def with_callbacks(listeners: DataFrame, facts: Facts) -> DataFrame:
    """Listeners with callback_symbol: the one definition the callback can mean, else null; never a guess."""
    defs = definitions(facts.symbols)
    h = listeners.drop("callback_symbol")
    inside = facts.symbols.select(F.col("id").alias("enclosing_symbol"), F.col("container").alias("_owner"))
    h = h.join(inside, "enclosing_symbol", "left")
    for by, key, out in (("scope_symbol", "enclosing_symbol", "_scope_cls"), ("file", "file", "_file_cls")):
        env = type_environment(facts.assigns, defs, by).where("cls is not null").select(F.col(by).alias(key), F.col("var").alias("cb_recv"), F.col("cls").alias(out))
        h = h.join(env, [key, "cb_recv"], "left")
    cont = F.when(F.col("cb_kind") == "method_self", F.col("_owner")).when((F.col("cb_kind") == "method") & (F.coalesce("cb_recv", F.lit("")) != ""), F.coalesce("_scope_cls", "_file_cls")).otherwise(F.col("cb_container"))
    h = h.withColumn("_cont", F.when(cont != "", cont))
    bare = F.substring_index("cb_name", "\\", -1)
    wanted = F.when(F.col("cb_kind") == "free", F.array_distinct(F.array("cb_name", bare))).otherwise(F.array("cb_name"))
    asked = h.where("cb_name is not null and cb_name <> ''").withColumn("_name", F.explode(wanted))
    c = asked.join(defs.withColumnRenamed("name", "_name").withColumnRenamed("fam", "lang"), ["lang", "_name"])
    exact, same = F.col("_name") == F.col("cb_name"), F.col("dst_file") == F.col("file")
    free = F.when(F.col("free"), F.when(exact & same, 1).when(exact, 2).when(same, 3).otherwise(4))
    tail = F.substring_index("_cont", "\\", -1)
    held = F.when(F.col("method"), F.when((F.col("container") == F.col("_cont")) & same, 1).when(F.col("container") == F.col("_cont"), 2).when(F.col("container") == tail, 3))
    loose = F.when(F.col("method"), 1).when(F.col("free") & (F.col("lang") == "python"), 2)
    c = c.withColumn("_rank", F.when(F.col("cb_kind") == "free", free).when(F.col("_cont").isNotNull(), held).otherwise(loose)).where("_rank is not null")
    best = c.withColumn("_best", F.min("_rank").over(Window.partitionBy("id"))).where("_rank = _best").groupBy("id").agg(F.count("*").alias("_n"), F.max("dst").alias("callback_symbol")).where("_n = 1").drop("_n")
    return h.join(best, "id", "left").select(_COLUMNS)


def resolve_hooks(facts: Facts) -> tuple[DataFrame, DataFrame]:
    """(hooks with names and callbacks filled in, edges from fires to callbacks)."""
    named = with_constants(facts.hooks, facts)
    facts = Facts(facts.spark, **(dict(facts) | {"hooks": named}))
    sure = trusted(named.where("kind = 'listen'"), facts)
    heard = with_callbacks(sure, facts)
    others = named.join(heard.select("id"), "id", "left_anti").withColumn("callback_symbol", F.lit(None).cast("long")).select(_COLUMNS)
    listeners = heard.where("callback_symbol is not null and hook is not null and hook <> '' and hook_class <> 'route'").select("lang", mechanism(F.col("lang"), F.col("hook_class")).alias("mech"), "hook", F.col("callback_symbol").alias("dst"))
    fires = trusted(named.where("kind = 'fire' and hook is not null and hook <> '' and enclosing_symbol is not null"), facts)
    fires = fires.select("lang", mechanism(F.col("lang"), F.col("note")).alias("mech"), "hook", F.col("enclosing_symbol").alias("src"), "file", "line")
    edges = fires.join(listeners, ["lang", "mech", "hook"]).select("src", "dst", F.lit("hook").alias("kind"), F.lit("hook").alias("resolution"), "file", "line", F.lit(None).cast("long").alias("ref_id"))
    return heard.unionByName(others), edges
