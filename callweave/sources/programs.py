"""Programs made from rows, one per dialect, so that extraction can be checked at any scale without source code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.functions import languages as L
from callweave.sources.tables import read

#: What %C, %f, %g and %m stand for: a class, a method, a called function and a module, all by row.
PROGRAMS = {
    "python": "import %m.util\nclass %C:\n    def %f(self, x: %C):\n        y = %C()\n        self.%g(1)\n        y.%g()\n        return %g(x)\n",
    "javascript": "import u from './%m/util';\nclass %C {\n  %f(a) {\n    const y = new %C();\n    this.%g(1);\n    y.%g();\n    return %g(a);\n  }\n}\n",
    "typescript": "import u from './%m/util';\nclass %C {\n  %f(a: %C): number {\n    const y = new %C();\n    this.%g(1);\n    y.%g();\n    return %g(a);\n  }\n}\n",
    "tsx": "import u from './%m/util';\nfunction %f(a: %C) {\n  const y = new %C();\n  y.%g();\n  return %g(a);\n}\n",
    "php": "<?php\nclass %C {\n  function %f($a) {\n    $y = new %C();\n    $this->%g(1);\n    $y->%g();\n    %C::%g();\n    return %g($a);\n  }\n}\nadd_action('%m', '%g');\ndo_action('%m', 1);\n",
    "ruby": "require '%m/util'\nclass %C\n  include Help\n  def %f(a)\n    y = %C.new\n    self.%g(1)\n    y.%g(2)\n    %g(a)\n  end\nend\n",
    "go": 'package main\n\nimport "%m/util"\n\ntype %C struct{}\n\nfunc (r *%C) %f(a int) int {\n  y := %C{}\n  r.%g(1)\n  y.%g(2)\n  return %g(a)\n}\n',
}


def programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, lang, content): one program per part, its dialect by the part's size."""
    p = read(spark, sf_dir, "part")
    lang = F.element_at(F.array(*[F.lit(x) for x in L.LANGUAGES]), (F.col("p_size") % len(L.LANGUAGES)).cast("int") + 1)
    text = F.create_map(*[F.lit(x) for pair in PROGRAMS.items() for x in pair])[lang]
    values = {"%C": F.replace("p_brand", F.lit("#"), F.lit("")), "%f": F.replace("p_name", F.lit(" "), F.lit("_")), "%g": F.concat(F.lit("go"), F.col("p_partkey") % 97), "%m": F.concat(F.lit("mod"), F.col("p_size"))}
    for mark, value in values.items():
        text = F.replace(text, F.lit(mark), value)
    return p.select(F.concat(F.lit("p"), F.col("p_partkey")).alias("path"), lang.alias("lang"), text.cast("binary").alias("content"))
