"""Functions of one's own for expressions: SQL functions, which Spark takes into the plan, and table functions.

    define(spark, "net(price DOUBLE, discount DOUBLE) RETURNS DOUBLE RETURN price * (1 - discount)")
    Pipeline(lines).derive(net="net(l_extendedprice, l_discount)")

They last as long as the session; of definitions of one name the last one counts, so that an include may replace what
another one brought. A SQL function is an expression: no Python runs, and filters on it reach the files where its
parts do. What must see the records of a group one after another is a table function in Python, a class for pyspark's
`udtf` with eval() for each record and terminate() for the rest, which Spark deals the groups out for.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

NAME = re.compile(r"\s*([A-Za-z_]\w*)\s*\(")


def define(spark: SparkSession, *definitions: str) -> list[str]:
    """Takes definitions, `name(argument TYPE, ...) RETURNS type RETURN expression` or `... RETURNS TABLE (...) RETURN SELECT ...`, and tells their names."""
    names = []
    for text in definitions:
        named = NAME.match(text)
        if not named:
            raise ValueError(f"no function: {text.strip()[:60]!r}")
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {text}")
        names.append(named[1])
    return names


def include(spark: SparkSession, *paths: str) -> list[str]:
    """Takes the definitions in files, in the files' order: blank lines part them, lines that begin with `--` are remarks."""
    names = []
    for path in paths:
        text = spark.read.text(path, wholetext=True).first()
        for part in re.split(r"\n[ \t]*\n", "\n".join(x for x in (text.value if text else "").splitlines() if not x.lstrip().startswith("--"))):
            if part.strip():
                names += define(spark, part)
    return names


def by_groups(df: DataFrame, function, by: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """What a table function, made by pyspark's `udtf`, makes of df's records, group by group of by, each in order.

    A group is one task's work, but never in memory as a whole, unless the function keeps it.
    """
    table = df.asTable().partitionBy(*by)
    return function(table.orderBy(*order) if order else table)
