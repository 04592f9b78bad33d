"""Calls to something outside: retries, usage and what a failure means.

Failures are rows of their own. Usage is carried in columns and summed as data,
so a task that runs twice is not counted twice.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.checkpoint import cut

#: Statuses after which asking again gives the same: bad key, no credit, no right, no such model.
FINAL_STATUS = (401, 402, 403, 404)


def ask_until(ask: Callable, given, tries: int = 5, pause: Callable[[int], float] = lambda n: min(2.0**n, 30.0), sleep: Callable[[float], None] = time.sleep):
    """(answer, None, attempts), or (None, error, attempts) once tries or hope are spent; a null answer is a failure too."""
    said = "no answer"
    for attempt in range(1, tries + 1):
        try:
            answer = ask(given)
            if answer is not None:
                return answer, None, attempt
        except Exception as error:  # noqa: BLE001  the outside world may fail in any way
            said = f"{type(error).__name__}: {error}"
            if getattr(error, "status_code", None) in FINAL_STATUS:
                return None, said, attempt
        if attempt < tries:
            sleep(pause(attempt))
    return None, said, tries


def complete(prompts: DataFrame, client, key: str = "id", tries: int = 5, pause: Callable[[int], float] = lambda n: min(2.0**n, 30.0)) -> DataFrame:
    """(key, answer, error, attempts, prompt_tokens, completion_tokens) of ``prompts`` (key, prompt).

    ``client(prompt)`` gives (text, prompt tokens, completion tokens).
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for k, prompt in frame[[key, "prompt"]].itertuples(index=False):
                got, error, attempts = ask_until(client, prompt, tries, pause)
                text, sent, received = got or (None, 0, 0)
                rows.append((k, text, error, attempts, sent, received))
            yield pd.DataFrame(rows, columns=[key, "answer", "error", "attempts", "prompt_tokens", "completion_tokens"])

    kind = dict(prompts.dtypes)[key]
    return prompts.select(key, "prompt").mapInPandas(run, f"{key} {kind}, answer string, error string, attempts int, prompt_tokens long, completion_tokens long")


def usage(answers: DataFrame, prompt_price: float = 0.0, completion_price: float = 0.0) -> DataFrame:
    """One row: calls, failures, tokens, and the cost at prices for a million tokens."""
    sent, received = (F.coalesce(F.sum(n), F.lit(0)) for n in ("prompt_tokens", "completion_tokens"))
    return answers.agg(
        F.count("*").alias("calls"), F.count("error").alias("failures"), sent.alias("prompt_tokens"), received.alias("completion_tokens"),
        ((sent * prompt_price + received * completion_price) / 1e6).alias("cost"),
    )


def binary_verdict(said: Column) -> Column:
    """The first 0 or 1 in an answer; 0 where there is none; null (never scored) where there is no answer."""
    digit = F.regexp_extract(said, "[01]", 0)
    return F.when(said.isNotNull(), F.when(digit == "1", 1).otherwise(0))


def retry_passes(items: DataFrame, process: Callable[[DataFrame, int], DataFrame], key: str, passes: int = 2) -> DataFrame:
    """Process all items, then those whose ``ok`` is not true again, ``passes`` times at most.

    ``process(items, pass)`` keeps ``key`` and adds ``ok``. Each pass is written,
    so no item is processed again for a later one; ``attempts`` says how often it was.
    """
    todo, done = items, None
    for n in range(passes + 1):
        tried = cut(process(todo, n).withColumn("attempts", F.lit(n + 1)))
        good = F.coalesce(F.col("ok"), F.lit(False))
        last = n == passes or tried.filter(~good).isEmpty()
        part = tried if last else tried.filter(good)
        done = part if done is None else done.unionByName(part)
        if last:
            break
        todo = items.join(tried.filter(~good).select(key), key, "left_semi")
    return done
