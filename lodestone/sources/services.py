"""Calls to models, given as Python functions: retries, fallback, batches. Queries that are checked use none of them."""

from __future__ import annotations

import os
import re
import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from typing import TypeVar

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import materialize, ship

Result = TypeVar("Result")

# Limits of retries and sizes of requests.
ATTEMPTS, LONGEST_WAIT, USUAL_WAIT, BATCH = 3, 65.0, 20.0, 20
RETRY_AFTER = re.compile(r"retry in ([\d.]+)s", re.IGNORECASE)


class RateLimited(RuntimeError):
    """Still limited after all attempts."""


def setting(name: str, default: str) -> str:
    """An environment variable; an empty one counts as unset."""
    return (os.environ.get(name) or "").strip() or default


def limited(error: Exception) -> bool:
    return any(mark in str(error) for mark in ("429", "RESOURCE_EXHAUSTED"))


def wait_for(error: Exception) -> float:
    """Seconds to wait: what the error suggests and one more, else the usual time, but not above the longest."""
    match = RETRY_AFTER.search(str(error))
    return min(float(match[1]) + 1 if match else USUAL_WAIT, LONGEST_WAIT)


def retried(call: Callable[[], Result], sleep: Callable[[float], None] = time.sleep) -> Result:
    """call(), tried again while it is limited; other errors pass at once."""
    for attempt in range(ATTEMPTS):
        try:
            return call()
        except Exception as error:
            if not limited(error):
                raise
            if attempt + 1 == ATTEMPTS:
                raise RateLimited(f"limited in all of {ATTEMPTS} attempts") from error
            sleep(wait_for(error))
    raise AssertionError


def with_fallback(calls: Sequence[tuple[str, Callable[[], Result]]], sleep: Callable[[float], None] = time.sleep) -> tuple[str, Result]:
    """Name and result of the first of the named calls that isn't limited."""
    for k, (name, call) in enumerate(calls):
        try:
            return name, retried(call, sleep)
        except RateLimited:
            if k + 1 == len(calls):
                raise
    raise ValueError("no call was given")


class Quota:
    """Calls made so far apart that at most so many tasks together make no more than rate calls a second.

    Each task has its share of the rate and starts at its own moment, so that the calls of all are spread evenly. Attempts
    count as calls. Speculative copies of tasks would call besides, so leave speculation off for such a job.
    """

    def __init__(self, rate: float, tasks: int, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic):
        if not rate > 0 or tasks < 1:
            raise ValueError("rate and tasks must be above zero")
        self.rate, self.tasks, self.sleep, self.clock = rate, tasks, sleep, clock
        self.at: float | None = None

    def __call__(self, call: Callable[[], Result]) -> Result:
        def spaced() -> Result:
            now = self.clock()
            if self.at is None:
                context = TaskContext.get()
                self.at = now + (context.partitionId() % self.tasks if context else 0) / self.rate
            if self.at > now:
                self.sleep(self.at - now)
            self.at = max(self.at, now) + self.tasks / self.rate
            return call()

        return retried(spaced, self.sleep)


#: What a vector is for; models make different ones of documents and of questions to them.
DOCUMENTS, QUESTIONS = "RETRIEVAL_DOCUMENT", "RETRIEVAL_QUERY"


def embed(texts: DataFrame, embedder: Callable[..., list[Sequence[float]]], text: str = "content", size: int = BATCH, tries: Callable[..., object] = retried, task: str | None = None) -> DataFrame:
    """texts with embedding, array<float> of norm 1, from requests of so many texts; a failed request goes text by text.

    With a task, such as DOCUMENTS or QUESTIONS, it is given to the embedder besides each request's texts.
    """
    ship(texts.sparkSession)
    at = texts.columns.index(text)
    if task is not None:
        plain, embedder = embedder, lambda some: plain(some, task)

    def call(some: list[str]) -> list[Sequence[float]]:
        try:
            return tries(lambda: embedder(some))
        except Exception:
            return [tries(lambda one=one: embedder([one]))[0] for one in some]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(at).to_pylist()
            vectors = [v for k in range(0, len(values), size) for v in call(values[k : k + size])]
            m = np.array(vectors, np.float64).reshape(len(values), -1)
            n = np.linalg.norm(m, axis=1, keepdims=True)
            if (n == 0).any():
                raise ValueError("cannot normalise a zero vector")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list((m / n).astype(np.float32)), pa.list_(pa.float32()))], names=[*batch.schema.names, "embedding"])

    return texts.mapInArrow(run, texts.withColumn("embedding", F.array(F.lit(0.0).cast("float"))).schema)


class NotAll(RuntimeError):
    """Calls have failed; what the others returned is kept."""


KEPT = "_hash string, embedding array<float>, failed string, run string"


def embed_kept(texts: DataFrame, embedder: Callable[..., list[Sequence[float]]], path: str, text: str = "content", steps: int = 8, rate: float | None = None, tasks: int | None = None, size: int = BATCH, task: str | None = None) -> DataFrame:
    """texts with embedding as embed() gives it, from a table at path that keeps the vector of every text ever called for.

    Only different texts without a vector are called for, dealt to steps by a hash. A step is a job of its own, of so
    many tasks (by default the cluster's parallelism), which appends to the table; its tasks share the rate (calls a
    second, for the whole job). A call that fails costs no other: its texts are noted with the error, all else of the step is
    kept, and NotAll ends the run after that step. The next run with this path calls only for what is missing. A lost
    executor repeats at most the calls of its own tasks. A request that fails otherwise than by the limit goes text by text.

    Vectors of one path are of one embedder and task. Null texts have none; repeated ones share one; no rows give no rows.
    """
    spark = texts.sparkSession
    ship(spark)
    tasks = tasks or spark.sparkContext.defaultParallelism
    tries = retried if rate is None else Quota(rate, tasks)

    def made(some: list[str]) -> list[tuple[list[float] | None, str | None]]:
        try:
            vectors = tries(lambda: embedder(some) if task is None else embedder(some, task))
            if len(vectors) != len(some):
                raise ValueError(f"{len(vectors)} vectors for {len(some)} texts")
            out: list[tuple[list[float] | None, str | None]] = []
            for v in vectors:
                v = np.asarray(v, np.float64)
                n = np.linalg.norm(v)
                out.append(((v / n).astype(np.float32).tolist(), None) if n > 0 else (None, "cannot normalise a zero vector"))
            return out
        except Exception as error:
            if len(some) > 1 and not isinstance(error, RateLimited):
                return [x for one in some for x in made([one])]
            return [(None, str(error) or type(error).__name__)] * len(some)

    def kept() -> DataFrame:
        return spark.read.schema(KEPT).parquet(path)

    spark.createDataFrame([], KEPT).write.mode("ignore").parquet(path)
    hashed = texts.withColumn("_hash", F.sha2(text, 256))
    missing = hashed.where("_hash is not null").groupBy("_hash").agg(F.first(text).alias("_text"))
    missing = missing.join(kept().where("failed is null"), "_hash", "left_anti")
    todo = materialize(missing.withColumn("_step", F.pmod(F.xxhash64("_hash"), F.lit(steps)).cast("int")), partition_by="_step")
    for step in range(steps):
        name = uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], name: str = name) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(0, batch.num_rows, size):
                    part = batch.slice(k, size)
                    vectors, errors = zip(*made(part.column(1).to_pylist()), strict=True)
                    columns = [pa.array(vectors, pa.list_(pa.float32())), pa.array(errors, pa.string()), pa.array([name] * part.num_rows, pa.string())]
                    yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["_hash", "embedding", "failed", "run"])

        todo.where(F.col("_step") == step).select("_hash", "_text").repartition(tasks).mapInArrow(run, KEPT).write.mode("append").parquet(path)
        count, example = kept().where((F.col("run") == name) & F.col("failed").isNotNull()).agg(F.count("*"), F.first("failed")).first()
        if count:
            raise NotAll(f"{count} texts of step {step} of {steps} failed, one with: {example}")
    found = kept().where("failed is null").select("_hash", "embedding")
    return hashed.join(found, "_hash", "left").select(*texts.columns, "embedding")


def usable(models: Sequence[tuple[str, Callable[[str], str]]], prompt: str) -> tuple[str | None, list[tuple[str, str]]]:
    """The first of the named models that answers a trial prompt, and those before it with what was wrong; one call each."""
    failed: list[tuple[str, str]] = []
    for name, call in models:
        try:
            if (call(prompt) or "").strip():
                return name, failed
            failed.append((name, "empty answer"))
        except Exception as error:
            failed.append((name, (str(error).splitlines() or [type(error).__name__])[0]))
    return None, failed


def embedding_trial(embedder: Callable[..., list[Sequence[float]]], text: str, near: str, far: str, most_dims: int | None = None) -> dict[str, object]:
    """What an embedder is good for: dims, whether they fit, the cosines of text with a near and a far one, and whether they order rightly."""
    a, b, c = (np.asarray(v, np.float64) for v in (embedder([t])[0] for t in (text, near, far)))
    if not len(a) == len(b) == len(c):
        raise ValueError("vectors of different dimensions")
    norms = [float(np.linalg.norm(v)) for v in (a, b, c)]
    if 0.0 in norms:
        raise ValueError("cannot normalise a zero vector")
    to_near, to_far = float(a @ b) / (norms[0] * norms[1]), float(a @ c) / (norms[0] * norms[2])
    return {"dims": len(a), "fits": most_dims is None or len(a) <= most_dims, "near": to_near, "far": to_far, "ordered": to_near > to_far}


def hashed_embedder(dims: int = 64) -> Callable[..., list[list[float]]]:
    """A stand-in without a model: counts of hashed words and neighbouring pairs, the same on every machine and for every task."""
    from zlib import crc32

    def one(text: str) -> list[float]:
        words = re.findall(r"\w+", text.lower())
        v = [1e-3] * dims
        for token in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))]:
            v[crc32(token.encode()) % dims] += 1.0
        return v

    return lambda texts, task=None: [one(t) for t in texts]


def generate(prompts: DataFrame, models: Sequence[tuple[str, Callable[[str], str]]], prompt: str = "prompt") -> DataFrame:
    """prompts with response, model_used and llm_ms, from the first of the named models that isn't limited."""
    ship(prompts.sparkSession)
    at = prompts.columns.index(prompt)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value in batch.column(at).to_pylist():
                began = time.perf_counter()
                name, text = with_fallback([(name, lambda call=call, value=value: call(value)) for name, call in models])
                out.append((text, name, int((time.perf_counter() - began) * 1000)))
            columns = [pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "response", "model_used", "llm_ms"])

    return prompts.mapInArrow(run, prompts.withColumns({"response": F.lit(""), "model_used": F.lit(""), "llm_ms": F.lit(0)}).schema)
