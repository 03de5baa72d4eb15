"""Calls out of the plan: a function over rows with capped retries and a bound on calls at a time.

A model or a service that a plan needs is a function of a row. It is called in the
tasks, so at most ``concurrency`` calls a task are open at once and, with the
number of partitions, a known number over all; a call that fails is made again
after a pause that grows up to a cap. A row whose calls all fail keeps its error
and the rest of the batch goes on.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame

# Retries, first pause, longest pause and growth of a pause; calls and documents at a time.
RETRIES, FIRST_PAUSE, LONGEST_PAUSE, GROWTH = 3, 1.0, 10.0, 2.0
MODEL_CALLS, DOCUMENTS = 10, 3


def pauses(retries: int = RETRIES, first: float = FIRST_PAUSE, longest: float = LONGEST_PAUSE, growth: float = GROWTH) -> list[float]:
    """Seconds before each further call."""
    return [min(first * growth**i, max(first, longest)) if i else first for i in range(retries)]


def persistent(call: Callable, waits: list[float], transient: tuple[type[BaseException], ...] = (Exception,), sleep: Callable[[float], None] = time.sleep) -> Callable:
    """``call`` made again after each of ``waits`` while it fails with a transient error; the last error is raised."""

    def run(*args):
        for wait in waits:
            try:
                return call(*args)
            except transient:
                sleep(wait)
        return call(*args)

    return run


def called(rows: DataFrame, call: Callable[[dict], str | None], out: str = "answer", partitions: int | None = None, concurrency: int = MODEL_CALLS, waits: list[float] | None = None, transient: tuple[type[BaseException], ...] = (Exception,)) -> DataFrame:
    """``rows`` with the string that ``call`` gives for each (a row as a dictionary), and error, null where it came through.

    ``partitions`` bounds the tasks, and with ``concurrency`` the calls over all of them.
    """
    tried = persistent(call, pauses() if waits is None else waits, transient)

    def one(row: dict) -> tuple[str | None, str | None]:
        try:
            return tried(row), None
        except transient as e:
            return None, f"{type(e).__name__}: {e}"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(concurrency) as pool:
            for part in parts:
                answers = list(pool.map(one, part.to_dict("records")))
                yield part.assign(**{out: [a for a, _ in answers], "error": [e for _, e in answers]})

    dealt = rows if partitions is None else rows.repartition(partitions)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return dealt.mapInPandas(run, f"{fields}, `{out}` string, error string")


# What stands for the entities that a recogniser finds.
MARKS = {"PERSON": "[NAME]", "GPE": "[LOCATION]", "ORG": "[ORGANIZATION]"}


def masked(rows: DataFrame, recognise: Callable[[str], list[tuple[int, int, str]]], text: str = "text", marks: dict[str, str] = MARKS) -> DataFrame:
    """``rows`` with the spans (start, end, label) that a recogniser finds in their text replaced; spans that overlap an earlier one are left out, a text that it fails on stays."""

    def one(value: str | None) -> str | None:
        if not isinstance(value, str):
            return None
        try:
            spans = sorted((a, b, marks[k]) for a, b, k in recognise(value) if k in marks)
        except Exception:  # the recogniser is optional: its failure costs its marks alone
            return value
        out, at = [], 0
        for a, b, mark in spans:
            if a >= at:
                out += [value[at:a], mark]
                at = b
        return "".join([*out, value[at:]])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part.assign(**{text: part[text].map(one)})

    return rows.mapInPandas(run, rows.schema)
