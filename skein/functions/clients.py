"""Calls to a costly or limited service, row by row: retries, waits, a stop at an exhausted quota."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

TRIES, WAIT, LIMITED_WAIT = 3, 2.0, 50.0


class QuotaExhausted(Exception):
    """A limit for the whole day, which no retry clears."""


def kind_of(error: BaseException) -> str:
    """stop, slow_down or retry."""
    text = str(error)
    if isinstance(error, QuotaExhausted) or "PerDay" in text:
        return "stop"
    return "slow_down" if getattr(error, "code", None) == 429 or "429" in text or "RESOURCE_EXHAUSTED" in text else "retry"


def wait_of(error: BaseException, wait: float = WAIT, limited: float = LIMITED_WAIT) -> float:
    """Seconds before the next try: the service's hint (attribute retry_delay such as "27s") plus one, else by kind."""
    hint = re.fullmatch(r"([0-9]+(?:\.[0-9]+)?)s", str(getattr(error, "retry_delay", "")))
    return float(hint[1]) + 1 if hint else limited if kind_of(error) == "slow_down" else wait


def with_retry(f: Callable, *args, tries: int = TRIES, wait: float = WAIT, limited: float = LIMITED_WAIT, sleep: Callable[[float], None] = time.sleep):
    """f(*args); up to ``tries`` times with waits between. The last error is raised, an exhausted quota at once."""
    for k in range(1, tries + 1):
        try:
            return f(*args)
        except Exception as e:
            if kind_of(e) == "stop":
                raise QuotaExhausted(str(e)) from e
            if k == tries:
                raise
            sleep(wait_of(e, wait, limited))
    raise ValueError("tries is 1 at least")


def called(rows: DataFrame, column: str, f: Callable[[str], object], result: str, lanes: int = 1, tries: int = TRIES, wait: float = WAIT, limited: float = LIMITED_WAIT) -> DataFrame:
    """rows with ``result`` ("name type") of f(column), and status and error.

    status: done, failed (all tries), not_attempted (after a quota was exhausted in the same lane). ``lanes`` is the number of
    concurrent callers, which a service's rate sets and not the size of the table. A failed row never fails the job;
    store the output before reading it twice."""
    name = result.split()[0]
    schema = ", ".join(f"`{c.name}` {c.dataType.simpleString()}" for c in rows.schema.fields)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stopped = None
        for pdf in frames:
            values, states, errors = [], [], []
            for x in pdf[column]:
                value, state, error = None, "not_attempted", stopped
                if stopped is None:
                    try:
                        value, state = with_retry(f, x, tries=tries, wait=wait, limited=limited), "done"
                    except QuotaExhausted as e:
                        stopped, state = str(e), "failed"
                        error = stopped
                    except Exception as e:  # one row's failure is its own
                        state, error = "failed", f"{type(e).__name__}: {e}"
                values.append(value)
                states.append(state)
                errors.append(error)
            yield pdf.assign(**{name: pd.Series(values, index=pdf.index, dtype=object), "status": states, "error": errors})

    return rows.repartition(lanes).mapInPandas(run, f"{schema}, {result}, status string, error string")
