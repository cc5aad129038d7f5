"""SQL over named views with named parameters and checked column names."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_NAME = re.compile(r"[A-Za-z_]\w*\Z", re.ASCII)
#: Nodes of a parsed statement that do more than read.
_WRITES = re.compile(r"Insert|Create|Drop|Delete|Update|Merge|Alter|Truncate|Replace|Set|Add|Analyze|Load|Repair|Cache|Refresh|Command|Use|Describe|Show|Explain|Call", re.ASCII)


def statement_nodes(spark: SparkSession, sql: str) -> list[str]:
    """Names of the nodes of a statement's parsed plan, in order."""
    tree = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql).treeString()
    return [m[1] for line in tree.splitlines() if (m := re.match(r"[\s:+|-]*'?(\w+)", line))]


def ask(spark: SparkSession, sql: str, views: dict[str, DataFrame], columns: dict[str, str] | None = None, **values) -> DataFrame:
    """Rows of one SELECT over ``views``.

    Views are written {name}, values :name, and columns that the caller chooses
    IDENTIFIER(:name).  Values never become part of the text.  A chosen column
    must be a plain name that one of the views has; anything but a reading
    statement, an unknown view or a missing parameter is an error.
    """
    used = set(re.findall(r"\{(\w+)\}", sql))
    if lacking := sorted(used - set(views)):
        raise ValueError(f"unknown views: {', '.join(lacking)}")
    known = {c for name in used for c in views[name].columns}
    for key, column in (columns or {}).items():
        if not _NAME.match(column) or column not in known:
            raise ValueError(f"{key}: {column!r} is no column of {', '.join(sorted(used))}")
    if both := sorted(set(values) & set(columns or {})):
        raise ValueError(f"named twice: {', '.join(both)}")
    if writes := [n for n in statement_nodes(spark, re.sub(r"\{(\w+)\}", r"\1", sql)) if _WRITES.match(n)]:
        raise ValueError(f"only reading statements are run, not {writes[0]}")
    return spark.sql(sql, args=values | (columns or {}), **{name: views[name] for name in used})
