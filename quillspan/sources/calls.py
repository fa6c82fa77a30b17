"""Calls to a service through an injected transport: requests built in Catalyst, answers taken apart in Catalyst."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (url, headers, body, timeout) -> text
Transport = Callable[[str, dict, str, float], str]


class Transient(Exception):
    """A failure worth another attempt."""


#: Answers of a server that may pass.
PASSING = (408, 409, 429, 500, 502, 503, 504)


def http(url: str, headers: dict, body: str | None, timeout: float) -> str:
    """The transport over HTTP: POST, or GET without a body. What may pass is :class:`Transient`, the rest an error."""
    request = urllib.request.Request(url, data=None if body is None else body.encode(), headers=headers)
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return answer.read().decode("utf-8")
    except urllib.error.HTTPError as e:
        said = f"HTTP {e.code}: {e.read().decode('utf-8', 'replace')[:2000]}"
        raise (Transient(said) if e.code in PASSING else ValueError(said)) from e
    except urllib.error.URLError as e:
        raise Transient(f"cannot reach {url}: {e.reason}") from e


def doubling(k: int) -> float:
    """2^k seconds."""
    return 2.0**k


def linear(k: int) -> float:
    """2 (k + 1) seconds, as for the pieces of a transfer (six attempts)."""
    return 2.0 * (k + 1)


def with_retries(
    send: Transport, attempts: int = 4, pause: Callable[[float], None] = time.sleep, wait: Callable[[int], float] = doubling
) -> Transport:
    """Up to ``attempts`` tries, ``wait(k)`` seconds after the k-th failure."""

    def run(url: str, headers: dict, body: str, timeout: float) -> str:
        for k in range(attempts):
            try:
                return send(url, headers, body, timeout)
            except Transient:
                if k == attempts - 1:
                    raise
                pause(wait(k))
        raise AssertionError

    return run


def asked(rows: DataFrame, body: Column, url: str, send: Transport, timeout: float = 60.0) -> DataFrame:
    """``rows`` + reply, error: one call per row, batch-wise; a failed call is a row with its error."""

    @F.pandas_udf("struct<reply:string,error:string>")
    def call(bodies: pd.Series) -> pd.DataFrame:
        out = []
        for b in bodies:
            try:
                out.append((send(url, {"content-type": "application/json"}, b, timeout), None))
            except Exception as e:  # noqa: BLE001  a verdict is data
                out.append((None, str(e) or type(e).__name__))
        return pd.DataFrame(out, columns=["reply", "error"])

    return rows.withColumn("_c", call(body)).select(*rows.columns, "_c.reply", "_c.error")
