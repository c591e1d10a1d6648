"""Running a model over prompts: the pluggable responder seam.

``generate`` sends prompts to a picklable ``responder(list_of_messages) ->
list_of_outputs`` inside ``mapInArrow``, ``call_size`` of them at a time whatever the Arrow
batches are. A call that fails is bisected: its halves are asked each by itself, so the
good prompts around a bad one cost a few calls, not one each. A prompt that fails alone is
retried with exponential back-off unless the failure is permanent; then its output is null
and its status ``failed``, which scoring turns into the failure sentinel. A responder may
also return ``'content_filter_high'``.

After ``breaker`` failed calls in a row the task asks no more: what is left has status
``pending`` and a null output, belongs in no ledger, and is asked by the next run. A dead
back end so costs at most ``breaker`` calls a task, however many prompts wait.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Responder = Callable[[list], list]

# Retry policy of the reference's cloud back end.
MAX_ATTEMPTS = 50
BACKOFF_MIN, BACKOFF_MAX = 2.0, 10.0
#: Prompts of one call of the responder.
CALL_SIZE = 64


class PermanentError(Exception):
    """Raised by a responder where asking again would not help."""


def _ask(responder: Responder, prompts: list) -> list:
    out = list(responder(prompts))
    if len(out) != len(prompts):
        raise ValueError("responder returned a different number of outputs")
    return out


class Caller:
    """Calls of one task: bisection of failed calls, retries, and the count of failures in a
    row that opens the breaker."""

    def __init__(self, responder: Responder, max_attempts: int, backoff_min: float, backoff_max: float, breaker: int):
        self.responder, self.max_attempts = responder, max_attempts
        self.backoff_min, self.backoff_max, self.breaker = backoff_min, backoff_max, breaker
        self.failures = 0  # in a row, over all prompts of the task

    def _try(self, prompts: list) -> tuple[list | None, bool]:
        """(outputs, False), or (None, whether asking again can't help)."""
        try:
            out = _ask(self.responder, prompts)
        except Exception as e:  # noqa: BLE001 - whatever the back end raised may pass
            self.failures += 1
            return None, isinstance(e, PermanentError)
        self.failures = 0
        return out, False

    def ask(self, prompts: list) -> list[tuple[str | None, str]]:
        """(output, status) of each prompt."""
        if self.failures >= self.breaker:
            return [(None, "pending")] * len(prompts)
        out, permanent = self._try(prompts)
        if out is not None:
            return [(o, "ok") for o in out]
        if len(prompts) > 1:
            half = len(prompts) // 2
            return self.ask(prompts[:half]) + self.ask(prompts[half:])
        for attempt in range(1, self.max_attempts):
            if permanent:
                break
            if self.failures >= self.breaker:
                return [(None, "pending")]  # not this prompt's fault: the next run asks it
            time.sleep(min(self.backoff_max, self.backoff_min * (2 ** min(attempt - 1, 30))))
            out, permanent = self._try(prompts)
            if out is not None:
                return [(out[0], "ok")]
        return [(None, "failed")]


def generate(prompts: DataFrame, responder: Responder, key: str = "key", max_attempts: int = MAX_ATTEMPTS,
             backoff_min: float = BACKOFF_MIN, backoff_max: float = BACKOFF_MAX, call_size: int = CALL_SIZE,
             breaker: int | None = None) -> DataFrame:
    """(key, output, status) for every prompt row; ``messages`` is an array of (role, content).
    ``breaker`` is, unless given, twice the calls that a single bad prompt can fail (the
    bisections down to it and its attempts), so a stubborn prompt does not open it."""
    key_type = dict(prompts.dtypes)[key]
    limit = 2 * (call_size.bit_length() + max_attempts) if breaker is None else breaker

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caller = Caller(responder, max_attempts, backoff_min, backoff_max, limit)
        for batch in batches:
            for at in range(0, batch.num_rows, call_size):  # only one call's prompts are Python objects at a time
                some = batch.slice(at, call_size)
                outs = caller.ask([[{"role": m["role"], "content": m["content"]} for m in row] for row in some.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([some.column(0), *[pa.array([x[i] for x in outs], pa.string()) for i in (0, 1)]],
                                                 names=[key, "output", "status"])

    return prompts.select(key, "messages").mapInArrow(run, schema=f"{key} {key_type}, output string, status string")


def answered(answers: DataFrame) -> DataFrame:
    """Answers that a ledger may take: all but those of prompts that were not asked."""
    return answers.filter(F.col("status") != "pending")


def echo_responder(batch: list) -> list:
    """Deterministic stand-in model: answers with the last user message minus 'Input: '."""
    out = []
    for msgs in batch:
        last = msgs[-1]["content"]
        out.append(last[len("Input: "):] if last.startswith("Input: ") else last)
    return out


def user_one_responder(batch: list) -> list:
    """Deterministic stand-in model: answers 'u::' with 'u::1', whatever came before."""
    return [msgs[-1]["content"] + "1" for msgs in batch]
