"""Model calls behind one boundary: batches of prompts to answers, with a policy for calls that fail."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assize.functions.text import EMBEDDED

#: What becomes of a row whose call fails to the end.
POLICIES = ("error_record", "none", "drop")
#: Fixed value: the answer and the reasoning of an error record.
ERROR = "Error"
#: Errors of the program itself: no second call mends them, and no policy hides them.
PROGRAMMING = (TypeError, NameError, AttributeError, ImportError, SyntaxError, AssertionError)
SCHEMA = "id string, response string, reasoning_content string"


class RateLimited(Exception):
    """A client's sign that a call may be tried again after a pause."""


def complete(prompts: DataFrame, make_client: Callable[[], Callable], *, policy: str = "error_record", attempts: int = 3, pause: float = 61.0, other_pause: float = 1.0, retry_all: bool = True, tasks: int | None = None, workers: int = 8, batch: int | None = None) -> DataFrame:
    """(id, response, reasoning_content) of ``prompts`` (id, prompt).

    ``make_client`` is called once in each task and gives a function from prompt to answer, or to answer and reasoning; each
    task has ``workers`` calls under way at once. With ``batch`` the function takes a list of up to so many prompts instead
    and gives a list of answers, one call after another. A failed call is tried ``attempts`` times, with ``pause`` seconds
    after RateLimited and ``other_pause`` after others; without ``retry_all`` others aren't tried again: they end the job
    under ``drop``, as errors of the program itself always do. Then ``error_record`` answers "Error" in both columns, ``none``
    null, and ``drop`` gives no row. Write the result before using it twice: calls aren't repeatable.
    """
    if policy not in POLICIES:
        raise ValueError(f"policy {policy!r} is none of {POLICIES}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()

        def call(asked: list) -> list[tuple | None]:
            for n in range(attempts):
                try:
                    got = client(asked) if batch else [client(asked[0])]
                    if len(got) != len(asked):
                        raise RuntimeError(f"{len(got)} answers to {len(asked)} prompts")
                    return [x if isinstance(x, tuple) else (x, None) for x in got]
                except RateLimited:
                    if n + 1 < attempts:
                        time.sleep(pause)
                except PROGRAMMING:
                    raise
                except Exception:
                    if not retry_all:
                        if policy == "drop":
                            raise
                        break
                    if n + 1 < attempts:
                        time.sleep(other_pause)
            return [None] * len(asked)

        with ThreadPoolExecutor(1 if batch else workers) as pool:
            for b in batches:
                asked = b["prompt"].tolist()
                parts = [asked[i : i + (batch or 1)] for i in range(0, len(asked), batch or 1)]
                answers = [x for part in pool.map(call, parts) for x in part]
                failed = (ERROR, ERROR) if policy == "error_record" else (None, None)
                out = [(i, *(failed if x is None else x)) for i, x in zip(b["id"], answers) if x is not None or policy != "drop"]
                yield pd.DataFrame(out, columns=["id", "response", "reasoning_content"])

    p = prompts.select(F.col("id").cast("string").alias("id"), "prompt")
    return (p.repartition(tasks) if tasks else p).mapInPandas(run, SCHEMA)


def embed(df: DataFrame, text: str, make_model: Callable[[], Callable], width: int, *, instruction: str | None = None, batch: int = 32, normalise: bool = True, name: str = "embedding") -> DataFrame:
    """Adds ``name``: the vectors that a model gives for ``text``; null texts have null vectors.

    ``make_model`` is called once in each task and gives a function from a list of at most ``batch`` texts to as many rows of
    ``width`` numbers. With ``instruction`` each text is put behind it as the query; vectors have length 1 unless told
    otherwise, zero vectors stay zero.
    """
    kinds = ", ".join(f"`{c}` {t}" for c, t in df.dtypes if c != name) + f", `{name}` array<float>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_model()
        for b in batches:
            texts = [(i, f"{EMBEDDED % instruction}{t}" if instruction else t) for i, t in enumerate(b[text]) if isinstance(t, str)]
            out: list = [None] * len(b)
            for k in range(0, len(texts), batch):
                part = texts[k : k + batch]
                v = np.asarray(model([t for _, t in part]), np.float32).reshape(len(part), -1)
                if v.shape[1] != width:
                    raise ValueError(f"the model gives {v.shape[1]} numbers, not {width}")
                if normalise:
                    v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
                for (i, _), x in zip(part, v):
                    out[i] = x
            yield b.drop(columns=[name], errors="ignore").assign(**{name: pd.Series(out, index=b.index, dtype=object)})

    return df.mapInPandas(run, kinds)


def pending(prompts: DataFrame, done: DataFrame) -> DataFrame:
    """Prompts without an answer yet."""
    return prompts.join(done.select(F.col("id").cast(dict(prompts.dtypes)["id"]).alias("id")).distinct(), "id", "left_anti")


def seeded(prompts: DataFrame, seeds: int = 5) -> DataFrame:
    """A row for each prompt and seed; the id is kept, seed is added."""
    return prompts.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))))


def stub_client() -> Callable[[str], tuple[str, None]]:
    """A client for offline use: its verdict is a hash of the prompt."""
    return lambda p: ('{"explanation": "stub", "score": %d}' % (1 + int(hashlib.md5((p or "").encode()).hexdigest()[:8], 16) % 5), None)
