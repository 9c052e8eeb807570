"""Column expressions over the fact tables."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from callweave.functions import languages as L


def family(lang: Column) -> Column:
    """The resolution family of a dialect."""
    return F.when(lang.isin(*L.JS_FAMILY), "js").otherwise(lang)


def is_free(kind: Column, container: Column) -> Column:
    return (kind == "function") | ((kind == "method") & (F.coalesce(container, F.lit("")) == ""))


def is_method(kind: Column, container: Column) -> Column:
    return (kind == "method") & (F.coalesce(container, F.lit("")) != "")


def label(container: Column, name: Column) -> Column:
    """container.name, or the bare name."""
    return F.when(F.coalesce(container, F.lit("")) != "", F.concat(container, F.lit("."), name)).otherwise(name)


def stripped(c: Column) -> Column:
    """Without white space at both ends; null is empty."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")


def language_of(path: Column) -> Column:
    """The dialect of a path by its lower-cased extension; null if unknown."""
    base = F.element_at(F.split(path, "/"), -1)
    ext = F.lower(F.regexp_extract(base, r"^.+(\.[^.]*)$", 1))
    table = F.create_map(*[F.lit(x) for pair in L.EXTENSIONS.items() for x in pair])
    return F.try_element_at(table, ext)


def import_tail(module: Column) -> Column:
    """The name a path-style import binds: last segment up to its first dot; null for other imports or an empty tail."""
    tail = F.split_part(F.element_at(F.split(module, "/"), -1), F.lit("."), F.lit(1))
    return F.when((module.contains("/") | module.startswith(".")) & (tail != ""), tail)


def module_matches(path: Column, module: Column, fam: Column) -> Column:
    """Whether the file defines the imported module, by the family's convention."""
    p = F.concat(F.lit("/"), path)
    base = F.regexp_replace(p, r"\.py\z", "")
    suffix = F.concat(F.lit("/"), F.replace(module, F.lit("."), F.lit("/")))
    python = base.endswith(suffix) | base.endswith(F.concat(suffix, F.lit("/__init__")))
    tail = F.split_part(F.element_at(F.split(module, "/"), -1), F.lit("."), F.lit(1))
    parts = F.split(p, "/")
    go = F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit("")) == tail
    stem = F.split_part(F.element_at(parts, -1), F.lit("."), F.lit(1)) == tail
    return F.when(fam == "python", python).otherwise((tail != "") & F.when(fam == "go", go).otherwise(stem))


def module_tail(module: Column, fam: Column) -> Column:
    """The last segment of a module's name, which module_tails of the files that module_matches accepts include."""
    dotted = F.element_at(F.split(F.replace(module, F.lit("."), F.lit("/")), "/"), -1)
    return F.when(fam == "python", dotted).otherwise(F.split_part(F.element_at(F.split(module, "/"), -1), F.lit("."), F.lit(1)))


def module_tails(path: Column, fam: Column) -> Column:
    """The last segments under which modules can mean a file."""
    parts = F.split(F.concat(F.lit("/"), path), "/")
    parent, base = F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit("")), F.element_at(parts, -1)
    stem = F.regexp_replace(base, r"\.py\z", "")
    python = F.when(stem == "__init__", F.array(stem, parent)).otherwise(F.array(stem))
    return F.when(fam == "python", python).when(fam == "go", F.array(parent)).otherwise(F.array(F.split_part(base, F.lit("."), F.lit(1))))


def entry_class(hook: Column) -> Column:
    """ajax_nopriv, admin_post_nopriv, ajax or admin_post for the hooks a request can reach; else null."""
    fits = lambda p: hook.startswith(p + "_") | (hook == p)
    return (
        F.when(fits("wp_ajax_nopriv"), "ajax_nopriv")
        .when(fits("admin_post_nopriv"), "admin_post_nopriv")
        .when(fits("wp_ajax"), "ajax")
        .when(fits("admin_post"), "admin_post")
    )


def glob_regex(pattern: str) -> str:
    """A case-sensitive shell pattern as a whole-string regex; * and ? cross slashes, [!x] negates."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and "]" in pattern[i + 1 :]:
            j = pattern.index("]", i + 1)
            inner = pattern[i:j].replace("\\", r"\\").replace("[", r"\[").replace("&&", r"&\&")
            out.append("[" + ("^" + inner[1:] if inner[0] == "!" else r"\^" + inner[1:] if inner[0] == "^" else inner) + "]")
            i = j + 1
        else:
            out.append(re.escape(c))
    return "(?s)^(?:" + "".join(out) + r")\z"


def any_glob(path: Column, globs: list[str]) -> Column:
    out = F.lit(False)
    for g in globs:
        out = out | path.rlike(glob_regex(g))
    return out


def targets_file(path: Column, target: str) -> Column:
    """A file target names the whole path or a tail of it from a slash on; case-sensitive."""
    return (path == target) | path.endswith("/" + target)
