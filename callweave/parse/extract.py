"""The table function over files: content in, rows of the fact tables out."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.functions import expressions as X
from callweave.functions import languages as L
from callweave.model import FACTS, Facts
from callweave.parse import brace, python, ruby
from callweave.parse.rows import COLUMNS, Parsed


def extract(content: bytes, lang: str) -> Parsed:
    """Facts of one file; an unexpected failure leaves a warning and no facts."""
    if lang not in L.LANGUAGES:
        return Parsed(f"no parser for {lang}")
    try:
        if lang == "python":
            return python.parse(content)
        text = content.decode("utf-8", "replace")
        out = ruby.parse(text) if lang == "ruby" else brace.parse(text, lang)
        if len(text) != len(content):
            _to_bytes(out, content, text)
        return out
    except (IndexError, KeyError, RecursionError, ValueError) as e:
        return Parsed(f"extraction failed: {type(e).__name__}")


def _to_bytes(out: Parsed, content: bytes, text: str) -> None:
    """Turns character positions into byte positions of the file; a bad byte is one character."""
    at, offset = [0], 0
    for c in text:
        offset += 1 if c < "\x80" else 2 if c < "ࠀ" else 3 if c < "\U00010000" else 4
        at.append(offset)
    if offset != len(content):  # replaced bytes: count in the file as it is
        at, i = [0], 0
        for c in text:
            i += 1 if c == "�" and content[i : i + 3] != b"\xef\xbf\xbd" else len(c.encode())
            at.append(min(i, len(content)))
    out.moved(at.__getitem__)


PARSED = "path string, lang string, " + ", ".join(f"{name} array<struct<{', '.join(c.replace(' ', ':', 1) for c in ddl.split(', '))}>>" for name, ddl in FACTS.items() if name in COLUMNS) + ", warnings array<string>"


def parse_files(files: DataFrame) -> DataFrame:
    """(path, lang, content) -> one row per file with an array of rows for every fact table."""

    def run(batches):
        for batch in batches:
            out = []
            for path, lang, content in zip(batch["path"], batch["lang"], batch["content"]):
                content = bytes(content if content is not None else b"")
                parsed = extract(content, lang)
                out.append({"path": path, "lang": lang, **parsed.finished(path, lang, content), "warnings": parsed.warnings})
            yield pd.DataFrame(out, columns=["path", "lang", *COLUMNS, "warnings"])

    return files.select("path", "lang", "content").mapInPandas(run, PARSED)


def classified(hooks: DataFrame) -> DataFrame:
    """PHP listeners on hooks that a request can reach become entry points of that class."""
    entry = X.entry_class(F.col("hook"))
    reach = (F.col("lang") == "php") & (F.col("kind") == "listen") & F.col("hook_class").isin("action", "filter") & entry.isNotNull()
    return (
        hooks.withColumn("_entry", F.when(reach, entry))
        .withColumn("hook_class", F.coalesce("_entry", "hook_class"))
        .withColumn("entry_point", F.col("entry_point") | F.col("_entry").isNotNull())
        .withColumn("unauth", F.col("unauth") | F.coalesce(F.col("_entry").endswith("nopriv"), F.lit(False)))
        .drop("_entry")
    )


def facts_from(parsed: DataFrame, files: DataFrame | None = None) -> Facts:
    """Fact tables from the output of parse_files, which should be stored: each table reads it once."""
    tables = {t: parsed.selectExpr(f"inline({t})") for t in COLUMNS}
    tables["hooks"] = classified(tables["hooks"])
    if files is not None:
        tables["files"] = files
    return Facts(parsed.sparkSession, **tables)
