"""Where the analytics meet models and media tools: one call per row, run in batches on executors.

An adapter is built once a task by its factory, so a model is loaded where it is
used. Retries happen inside; an error becomes the row's error instead of a lost task.
"""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame


class RetryableError(RuntimeError):
    """A failure that may pass; `after` is how long the other side asks to wait."""

    def __init__(self, message: str, after: float | None = None):
        super().__init__(message)
        self.after = after


class Adapter(Protocol):
    def __call__(self, row: dict) -> dict:
        """A JSON-like answer for one row."""


def with_retries(call: Callable[[dict], dict], row: dict, attempts: int = 2, base: float = 1.0, sleep: Callable[[float], None] = time.sleep, within: tuple[float, float] | None = None) -> tuple[dict, int]:
    """The answer and the number of attempts; only retryable errors are tried again, after doubling delays with jitter.

    The other side's wish makes a delay longer; where delays must lie `within` bounds, it takes the place of ours.
    """
    for attempt in range(1, attempts + 1):
        try:
            return call(row), attempt
        except RetryableError as e:
            if attempt == attempts:
                raise
            own = base * 2 ** (attempt - 1)
            if within:
                delay = min(within[1], max(within[0], own if e.after is None else e.after))
            else:
                delay = max(e.after or 0.0, own)
            sleep(delay + random.uniform(0, 0.25))
    raise ValueError("attempts must be 1 or more")


def answered(df: DataFrame, factory: Callable[[], Adapter], attempts: int = 2) -> DataFrame:
    """`df` with answer (JSON string), attempts and error for each row."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), "answer string, attempts int, error string"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = factory()
        for b in batches:
            out: list[tuple[str | None, int, str | None]] = []
            for row in b.to_dict("records"):
                try:
                    value, n = with_retries(call, row, attempts)
                    out.append((json.dumps(value, ensure_ascii=False, sort_keys=True), n, None))
                except Exception as e:  # kept with its row
                    out.append((None, attempts, f"{type(e).__name__}: {e}"))
            yield b.assign(answer=[o[0] for o in out], attempts=pd.array([o[1] for o in out], "int32"), error=[o[2] for o in out])

    return df.mapInPandas(run, schema)


class StubModel:
    """Confirms every clip's middle half, with the candidate's score: deterministic, for tests and dry runs."""

    def __call__(self, row: dict) -> dict:
        length = max(0.0, row["end"] - row["start"])
        return {"confidence": row["score"], "events": [{"event_start": round(length / 4, 3), "event_end": round(3 * length / 4, 3), "confidence": row["score"]}]}
