"""Model services as protocols, called in batches where the rows are; offline stand-ins for each."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterable, Iterator
from typing import Protocol, TypeVar

import pandas as pd
from pyspark.sql import DataFrame

T = TypeVar("T")


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Reranker(Protocol):
    def score(self, query: str, documents: list[str]) -> list[float]: ...


class Llm(Protocol):
    def complete(self, prompt: str, schema: dict | None = None) -> str: ...


class Nli(Protocol):
    def entails(self, premise: str, hypotheses: list[str]) -> list[float]: ...


class Permanent(Exception):
    """A failure that no retry mends."""


def with_retry(call: Callable[[], T], attempts: int = 4, first_wait: float = 0.5, factor: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> T:
    """Call again after transient failures, waiting longer each time with some jitter."""
    wait = first_wait
    for k in range(attempts):
        try:
            return call()
        except Permanent:
            raise
        except Exception:
            if k + 1 == attempts:
                raise
            sleep(wait * (0.5 + random.random()))
            wait *= factor
    raise AssertionError("unreachable")


class HashEmbedder:
    """A deterministic stand-in: each word's hash adds to one component; length 1."""

    def __init__(self, dims: int = 8):
        self.dims = dims

    def embed(self, texts: list[str]) -> list[list[float]]:
        import xxhash

        out = []
        for text in texts:
            v = [0.0] * self.dims
            for w in text.lower().split():
                h = xxhash.xxh64_intdigest(w)
                v[h % self.dims] += 1.0 if h >> 63 else -1.0
            length = sum(x * x for x in v) ** 0.5
            out.append([x / length if length else 0.0 for x in v])
        return out


class OverlapReranker:
    """A deterministic stand-in: share of the query's distinct words that the document has."""

    def score(self, query: str, documents: list[str]) -> list[float]:
        wanted = set(query.lower().split())
        return [len(wanted & set(d.lower().split())) / max(1, len(wanted)) for d in documents]


def embed_column(rows: DataFrame, embedder: Embedder, column: str = "text", batch: int = 256) -> DataFrame:
    """Adds ``vector``; rows reach the service in batches from each partition."""
    from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch].copy()
                part["vector"] = with_retry(lambda p=part: embedder.embed(p[column].fillna("").tolist()))
                yield part

    return rows.mapInPandas(run, StructType([*rows.schema.fields, StructField("vector", ArrayType(FloatType()))]))


class ScriptedLlm:
    """A deterministic stand-in: the reply of the first key that the prompt holds, else ``default``."""

    def __init__(self, replies: dict[str, str], default: str = "{}"):
        self.replies, self.default = replies, default

    def complete(self, prompt: str, schema: dict | None = None) -> str:
        return next((reply for key, reply in self.replies.items() if key in prompt), self.default)


class ReadingLlm:
    """A deterministic stand-in that reflects on the JSON behind a prompt's first line: sufficient if a memory holds the
    question, in conflict if the first two begin alike and differ; it would search next for how the first one ends."""

    def complete(self, prompt: str, schema: dict | None = None) -> str:
        import json

        asked = json.loads(prompt.split("\n", 1)[1])
        memories, question = asked["memories"], asked.get("question")
        alike = len(memories) > 1 and memories[0][:20] == memories[1][:20] and memories[0] != memories[1]
        enough = question is not None and any(question in m for m in memories)
        return json.dumps({"sufficient": enough, "conflict": alike, "next_query": memories[0][-80:] if memories else None})


class OverlapNli:
    """A deterministic stand-in: share of a hypothesis' words that the premise has."""

    def entails(self, premise: str, hypotheses: list[str]) -> list[float]:
        have = set(premise.lower().split())
        return [len(have & set(h.lower().split())) / max(1, len(set(h.lower().split()))) for h in hypotheses]


def complete_column(rows: DataFrame, llm: Llm, column: str, out: str = "reply", at_once: int = 4) -> DataFrame:
    """Adds the model's reply to each prompt; ``at_once`` calls of a partition run together, replies keep their order.

    A call that fails for good gives null, so that the row can be refused rather than the job lost.
    """
    from concurrent.futures import ThreadPoolExecutor

    from pyspark.sql.types import StringType, StructField, StructType

    def ask(prompt: str | None) -> str | None:
        try:
            return with_retry(lambda: llm.complete(prompt or ""))
        except Permanent:
            return None

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(at_once) as pool:
            for frame in frames:
                yield frame.assign(**{out: pd.Series(list(pool.map(ask, frame[column])), index=frame.index, dtype=object)})

    return rows.mapInPandas(run, StructType([*rows.schema.fields, StructField(out, StringType())]))
