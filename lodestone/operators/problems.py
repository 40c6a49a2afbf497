"""Problems as codes: what a foreign error is, whether it ends a run, and how it is shown."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.operators.state import RESUMABLE, OperationStopped
from lodestone.plans.expression import QueryError

# Parts of messages that say that the transport broke, not the record.
BROKEN = (
    "session with given id not found", "connection closed", "closed network connection", "websocket", "target closed", "browser has been closed", "connection reset", "broken pipe", "no target with given id",
)
# Codes of problems that may pass by themselves.
PASSING = (*RESUMABLE, "BROWSER_UNAVAILABLE", "SITE_UNAVAILABLE", "VERIFICATION_REPEATED")


def foreign_code(code: Column, message: Column, cancelled: Column | None = None) -> Column:
    """The code of a failure: its own, else by its message; anything unknown is OPERATION_FAILED."""
    low = F.lower(F.coalesce(message, F.lit("")))
    broken = F.lit(False)
    for part in BROKEN:
        broken = broken | F.contains(low, F.lit(part))
    stopped = F.coalesce(cancelled, F.lit(False)) if cancelled is not None else F.lit(False)
    return F.coalesce(F.nullif(code, F.lit("")), F.when(stopped, "CANCELLED").when(broken, "BROWSER_UNAVAILABLE").otherwise("OPERATION_FAILED"))


def passing(code: Column) -> Column:
    """Whether a problem may pass if it is tried again."""
    return F.coalesce(code.isin(*PASSING), F.lit(False))


def error_view(code: Column, message: Column) -> Column:
    """JSON of a problem as a client sees it: code, message, and retryable where it is."""
    return F.to_json(F.struct(F.struct(code.alias("code"), F.coalesce(message, F.lit("")).alias("message"), F.when(passing(code), True).alias("retryable")).alias("error")))


def problem_of(error: BaseException) -> dict:
    """The same view of an exception of this process, of Spark or of the system."""
    if isinstance(error, QueryError):
        code, message = error.code, str(error).removeprefix(f"{error.code}: ")
    elif isinstance(error, OperationStopped):
        code, message = str(error.args[0]), ""
    else:
        message = str(error)
        broken = isinstance(error, (ConnectionError, EOFError)) or any(part in message.lower() for part in BROKEN)
        code = "BROWSER_UNAVAILABLE" if broken else "OPERATION_FAILED"
    return {"error": {"code": code, "message": message} | ({"retryable": True} if code in PASSING else {})}


def shown(limit: int | None, default: int = 10) -> int:
    """How many rows are shown where a request names none."""
    return limit if limit and limit > 0 else default


def view_of(text: str) -> dict:
    """error_view() read again."""
    return json.loads(text)
