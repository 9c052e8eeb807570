"""The parsers as SQL table functions."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


@udtf(returnType="name string, kind string, container string, start_byte long, end_byte long")
class ParseSymbols:
    def eval(self, content: str, lang: str):
        from callweave.parse.extract import extract

        for s in extract((content or "").encode(), lang).rows["symbols"]:
            yield s["name"], s["kind"], s["container"], s["start_byte"], s["end_byte"]


@udtf(returnType="callee string, receiver string, at_byte long")
class ParseCalls:
    def eval(self, content: str, lang: str):
        from callweave.parse.extract import extract

        for r in extract((content or "").encode(), lang).rows["refs"]:
            yield r["callee"], r["receiver"], r["at"]


def register(spark: SparkSession) -> None:
    """parse_symbols(content, lang) and parse_calls(content, lang), for use in FROM, also LATERAL over a table."""
    spark.udtf.register("parse_symbols", ParseSymbols)
    spark.udtf.register("parse_calls", ParseCalls)
