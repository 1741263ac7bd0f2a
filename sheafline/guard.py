"""Guarded read-only SQL: a check of words, a check of the parsed plan, a row cap and a timeout."""

from __future__ import annotations

import re
import threading
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

# Words that write, attach or reach outside a query.
FORBIDDEN = re.compile(r"\b(insert|update|delete|drop|alter|create|replace|attach|detach|pragma|vacuum|reindex|analyze|trigger|commit|rollback|begin|savepoint|load_extension|truncate|merge)\b", re.I)
#: These words are harmless as functions.
AS_FUNCTION = re.compile(r"\b(replace|trim|likelihood|insert)\s*\(", re.I)
ROWS, MOST_ROWS, SECONDS = 200, 50_000, 20.0


class Refused(ValueError):
    """The statement is not a single read-only query."""


@dataclass
class Result:
    columns: list[str] = field(default_factory=list)
    rows: list[list] = field(default_factory=list)
    truncated: bool = False
    error: str = ""

    @property
    def ok(self) -> bool:
        return not self.error

    def to_markdown(self, most: int = 50) -> str:
        cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
        lines = ["| " + " | ".join(self.columns) + " |", "|" + "---|" * len(self.columns)]
        lines += ["| " + " | ".join(map(cell, r)) + " |" for r in self.rows[:most]]
        return "\n".join(lines)


#: Literals and quoted names, and comments; what begins first in the text holds, so a comment's
#: signs inside a literal are part of it, and a quote inside a comment opens nothing.
LITERAL = r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`"
TOKENS = re.compile(rf"(?P<literal>{LITERAL})|(?P<comment>/\*.*?\*/|--[^\n]*)", re.S)


def clean_statement(sql: str) -> str:
    """Without code fences, comments and closing semicolons."""
    s = re.sub(r"^```\w*\s*|\s*```$", "", (sql or "").strip(), flags=re.I)
    s = TOKENS.sub(lambda m: m.group(0) if m.group("literal") else " " if m.group(0).startswith("/*") else "", s)
    return s.strip().rstrip(";").strip()


def validate(spark: SparkSession, sql: str) -> str:
    """The statement ready to run; Refused if it is not one read-only query.

    Words are checked outside literals and quoted names, so a forbidden word inside a literal is
    fine.  Then Spark's own parser has to find a query: any command node is refused, at the root
    or inside.
    """
    s = clean_statement(sql)
    if not s:
        raise Refused("the statement is empty")
    if not re.match(r"(?i)\(*\s*(select|with)\b", s):
        raise Refused("only SELECT or WITH may start a statement")
    bare = re.sub(LITERAL, "''", s, flags=re.S)
    if ";" in bare:
        raise Refused("one statement at a time")
    bad = FORBIDDEN.search(AS_FUNCTION.sub("f(", bare))
    if bad:
        raise Refused(f"the word {bad.group(1).upper()} is not allowed")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(s)
    except Exception as e:
        raise Refused(f"it cannot be parsed: {str(e).splitlines()[0][:200]}") from None
    kinds = re.findall(r"(?m)^[\s:+'!-]*'?(\w+)", plan.treeString())
    for k in kinds:
        if k.endswith("Command") or k.startswith(("Insert", "Create", "Drop", "Delete", "Update", "Merge", "Alter", "Truncate", "Set")) and k not in ("SetOperation",):
            raise Refused(f"{k} is not a query")
    return s


def guarded(spark: SparkSession, sql: str) -> DataFrame:
    """The checked query as a DataFrame."""
    return spark.sql(validate(spark, sql))


def run_sql(spark: SparkSession, sql: str, limit: int = ROWS, timeout: float = SECONDS) -> Result:
    """Runs a checked query: at most `limit` rows (1 to 50,000), told whether more were there.

    The jobs carry a tag of their own and are cancelled after `timeout` seconds; the session
    stays usable.  Errors come back in the result and are not raised.
    """
    limit = max(1, min(int(limit), MOST_ROWS))
    sc, tag = spark.sparkContext, f"guard-{uuid.uuid4().hex}"
    late = threading.Event()

    def stop() -> None:
        late.set()
        sc.cancelJobsWithTag(tag)

    timer = threading.Timer(timeout, stop)
    try:
        df = guarded(spark, sql).limit(limit + 1)
        sc.addJobTag(tag)
        timer.start()
        rows = [list(r) for r in df.collect()]
        return Result(df.columns, rows[:limit], len(rows) > limit)
    except Refused as e:
        return Result(error=f"refused: {e}")
    except Exception as e:
        return Result(error=f"stopped after {timeout:g} s" if late.is_set() else str(e).splitlines()[0][:300])
    finally:
        timer.cancel()
        sc.removeJobTag(tag)
