"""Calls of language models: several at a time in each partition, within a budget, with
other vendors to fall back on, and a log of what they used."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from queue import Empty, Queue

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from finsift.functions.columns import fenced
from finsift.functions.schema import ANSWERS, violations
from finsift.sources.config import NO_EXPLANATION, NO_FACTS

#: What answers one call: prompt name and text to the answer, or to the answer and the
#: tokens that the vendor counted for both.
Provider = Callable[[str, str], "str | tuple[str, int, int]"]
ANSWER = "cache_key string, response string, error string, vendor string, tries int, seconds double, prompt_tokens long, answer_tokens long"
_NAMES = [c.split()[0] for c in ANSWER.split(", ")]


def estimated_tokens(text: str) -> int:
    """A token for four letters, one for each wide letter."""
    wide = sum(ord(c) > 0x2E7F for c in text)
    return wide + -(-(len(text) - wide) // 4)


class Budget:
    """Times at which calls may begin: ``per_second`` of them at most, evenly spread."""

    def __init__(self, per_second: float | None):
        self.gap = 1 / per_second if per_second else 0.0
        self.lock, self.next = threading.Lock(), 0.0

    def take(self) -> None:
        if not self.gap:
            return
        with self.lock:
            at = max(self.next, time.monotonic())
            self.next = at + self.gap
        time.sleep(max(0.0, at - time.monotonic()))


def _within(timeout: float, call: Callable[[], object]):
    """A call's result; one that takes too long raises, and its thread, which nothing can
    stop, is left to end by itself without holding a place."""
    out: Queue = Queue(1)

    def run() -> None:
        try:
            out.put((call(), None))
        except Exception as e:  # noqa: BLE001 - the provider's own errors
            out.put((None, e))

    threading.Thread(target=run, daemon=True).start()
    try:
        got, error = out.get(timeout=timeout)
    except Empty:
        raise TimeoutError(f"no answer in {timeout} s") from None
    if error is not None:
        raise error
    return got


def _asked(vendors: list[tuple[str, Provider]], budget: Budget, tries: int, wait: float, timeout: float, check, key: str, name: str, text: str) -> tuple:
    began, n, error = time.monotonic(), 0, None
    for vendor, answer in vendors:
        for turn in range(tries):
            n += 1
            budget.take()
            try:
                got = _within(timeout, lambda: answer(name, text))  # noqa: B023 - awaited at once
                response, *used = got if isinstance(got, tuple) else (got,)
                if check is not None and not check(name, response):
                    raise ValueError("the answer has not the form asked for")
                prompt, said = used or (estimated_tokens(text or ""), estimated_tokens(response or ""))
                return key, response, None, vendor, n, time.monotonic() - began, prompt, said
            except Exception as e:  # noqa: BLE001 - the provider's own errors
                error = f"{type(e).__name__}: {e}"
            if turn < tries - 1:
                time.sleep(wait * 2**turn)
    return key, None, error, None, n, time.monotonic() - began, estimated_tokens(text or ""), 0


def ask(
    calls: DataFrame, provider: Callable[[], Provider | dict[str, Provider]], tries: int = 3, wait: float = 1.0, timeout: float = 60.0,
    check: Callable[[str, str], bool] | None = None, concurrency: int = 8, per_second: float | None = None, partitions: int | None = None,
) -> DataFrame:
    """(cache_key, response, error, vendor, tries, seconds, prompt_tokens, answer_tokens) of
    calls (cache_key, prompt_name, variables), by a provider that each partition makes once,
    or by several by name, of which each is asked where those before it keep failing.

    A partition has ``concurrency`` calls under way.  ``per_second`` bounds the calls that
    all of ``partitions`` together begin, which is then how many there are (else as many as
    ``calls`` has): each begins its share, so the bound holds however many run at once.  A
    call that fails, takes longer than ``timeout`` seconds or whose answer ``check`` (prompt
    name, answer) rejects is asked again after ``wait`` seconds, then twice as many, up to
    ``tries`` times for each vendor; one that keeps failing gives its last error.  Tokens
    are the vendor's count where it gives one, else estimates.  Write the answers to the
    cache before using them, since a task that is run again asks again.
    """
    calls = calls.select("cache_key", "prompt_name", "variables")
    if per_second and not partitions:
        partitions = int(calls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if partitions:
        calls = calls.repartition(partitions, "cache_key")
    share = per_second / partitions if per_second else None

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = provider()
        vendors = list(made.items()) if isinstance(made, dict) else [("default", made)]
        budget = Budget(share)
        with ThreadPoolExecutor(concurrency) as pool:
            for pdf in parts:
                rows = pool.map(lambda r: _asked(vendors, budget, tries, wait, timeout, check, *r), pdf.itertuples(index=False, name=None))
                yield pd.DataFrame(list(rows), columns=_NAMES)

    return calls.mapInPandas(run, ANSWER)


def well_formed(prompt: Column, response: Column) -> Column:
    """Whether an answer says that nothing was found or has its prompt's form."""
    out = F.lit(True)
    for name, schema in ANSWERS.items():
        out = F.when(prompt == name, F.size(violations(fenced(response), schema)) == 0).otherwise(out)
    return F.coalesce(F.trim(response).isin(NO_FACTS, NO_EXPLANATION) | out, F.lit(False))


def logged(answers: DataFrame, write: Callable[[DataFrame], None]) -> dict[str, int]:
    """What writing ``answers`` used: calls, errors, tries and tokens, counted on the way
    to where they are written, so that the log's sums are those of what is there."""
    seen = Observation()
    total = {"calls": F.count("*"), "errors": F.count("error"), "tries": F.sum("tries"), "prompt_tokens": F.sum("prompt_tokens"), "answer_tokens": F.sum("answer_tokens")}
    write(answers.observe(seen, *[F.coalesce(c.cast("long"), F.lit(0).cast("long")).alias(n) for n, c in total.items()]))
    return dict(seen.get)
