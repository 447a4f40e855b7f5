"""Read-only SQL over the tables of an index, bounded in rows."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from terrane.errors import InvalidQuery

MAX_ROWS = 1000

#: Plans that read; whatever else the parser makes of a text is refused.
_WRITES = re.compile(
    r"\b(?:Insert\w*|Create\w*|Replace\w*|Drop\w*|Alter\w*|Delete\w*|Update\w*|Merge\w*|Truncate\w*|Cache\w*|Uncache\w*|Refresh\w*|Load\w*|Set\w*Command|Reset\w*|Add\w*Command|"
    r"Overwrite\w*|Append\w*|Analyze\w*|Repair\w*|Unresolved\w*Command|Script\w*|CompoundBody|ExecuteImmediate\w*|Call|SetCommand|RunnableCommand)\b"
)
_READS = frozenset({"SELECT", "WITH", "EXPLAIN", "VALUES", "TABLE", "FROM", "SHOW", "DESCRIBE", "DESC"})


@dataclass(frozen=True)
class Result:
    """Rows of a query, at most as many as asked for, and whether there were more."""

    columns: list[str]
    rows: list[tuple]
    truncated: bool


def first_keyword(text: str) -> str:
    """The first word behind comments and brackets, in upper case."""
    at = 0
    while at < len(text):
        if text[at].isspace() or text[at] == "(":
            at += 1
        elif text.startswith("--", at):
            end = text.find("\n", at)
            at = len(text) if end < 0 else end + 1
        elif text.startswith("/*", at):
            end = text.find("*/", at + 2)
            if end < 0:
                return ""
            at = end + 2
        else:
            break
    m = re.match(r"[A-Za-z_]+", text[at:])
    return m.group().upper() if m else ""


def single_statement(text: str) -> str:
    """The text without a closing semicolon; a second statement is an error. Quotes and comments are known."""
    at, end = 0, None
    while at < len(text):
        c = text[at]
        two = text[at : at + 2]
        if c in "'\"`":
            close = at + 1
            while True:
                close = text.find(c, close)
                if close < 0:
                    raise InvalidQuery("an open quote")
                if c == "'" and text[close - 1] == "\\":
                    close += 1
                    continue
                if text[close + 1 : close + 2] == c:
                    close += 2
                    continue
                break
            if end is not None:
                raise InvalidQuery("more than one statement")
            at = close + 1
        elif two == "--":
            close = text.find("\n", at)
            at = len(text) if close < 0 else close + 1
        elif two == "/*":
            close = text.find("*/", at + 2)
            if close < 0:
                raise InvalidQuery("an open comment")
            at = close + 2
        elif c == ";":
            end = at if end is None else end
            at += 1
        else:
            if end is not None and not c.isspace():
                raise InvalidQuery("more than one statement")
            at += 1
    out = text if end is None else text[:end]
    if not out.strip():
        raise InvalidQuery("no statement")
    return out


def gated(spark: SparkSession, text: str) -> str:
    """The statement if it only reads, by its first word and by what the parser makes of it; else an error."""
    statement = single_statement(text)
    if first_keyword(statement) not in _READS:
        raise InvalidQuery("only statements that read are allowed")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(statement)
    except Exception as e:
        raise InvalidQuery(str(e).split("\n")[0]) from None
    names = [plan.getClass().getSimpleName(), *re.findall(r"^[\s:+|\-']*([A-Za-z]\w*)", plan.toString(), re.MULTILINE)]
    if any(_WRITES.fullmatch(n) for n in names):
        raise InvalidQuery("only statements that read are allowed")
    return statement


def query_frame(spark: SparkSession, text: str, args: Sequence | dict | None = None) -> DataFrame:
    """The result of a statement that reads, not bounded."""
    return spark.sql(gated(spark, text), args=args) if args else spark.sql(gated(spark, text))


def query(spark: SparkSession, text: str, args: Sequence | dict | None = None, max_rows: int = MAX_ROWS) -> Result:
    """Runs a statement that reads and returns at most ``max_rows`` rows; one more is fetched to tell whether there are any."""
    df = query_frame(spark, text, args)
    rows = [tuple(r) for r in df.limit(max_rows + 1).collect()]
    return Result(df.columns, rows[:max_rows], len(rows) > max_rows)
