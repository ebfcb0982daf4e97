"""The model boundary: completions and embeddings behind one protocol."""

from __future__ import annotations

import hashlib
import json
import time
import urllib.request
from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import prompts
from ..functions import text as X

#: Waits before the second and third attempt, in seconds.
WAITS = (2.0, 4.0)
APOLOGY = "Sorry, the answer could not be produced."
#: How long an answer stays in the cache.
ANSWER_TTL_S = 3600


class ModelClient(Protocol):
    def complete(self, prompt: str) -> str: ...

    def embed(self, text: str) -> list[float]: ...


class StubModel:
    """Deterministic and offline: answers with a digest of the prompt."""

    def complete(self, prompt: str) -> str:
        return f"stub {hashlib.md5(prompt.encode()).hexdigest()}"

    def embed(self, text: str, dim: int = 64) -> list[float]:
        raw = hashlib.sha512(text.encode()).digest()
        vector = [raw[i % 64] / 127.5 - 1 for i in range(dim)]
        size = sum(x * x for x in vector) ** 0.5 or 1.0
        return [x / size for x in vector]


class HttpModel:
    """A completion server: prompts are posted as JSON, the first choice's text or the content comes back."""

    def __init__(self, base: str, model: str, max_tokens: int = 24, temperature: float = 0.1, stop: tuple[str, ...] = (), timeout: float = 5.0) -> None:
        self.base, self.timeout = base.rstrip("/"), timeout
        self.options = {"model": model, "max_tokens": max_tokens, "temperature": temperature, "stop": list(stop), "stream": False}

    def _post(self, path: str, body: dict) -> dict:
        request = urllib.request.Request(f"{self.base}/{path}", json.dumps(body).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.timeout) as reply:
            return json.load(reply)

    def complete(self, prompt: str) -> str:
        reply = self._post("completions", self.options | {"prompt": prompt})
        first = next(iter(reply.get("choices") or ()), None)
        return reply.get("content", "") if first is None else first["text"]

    def embed(self, text: str) -> list[float]:
        return self._post("embeddings", {"model": self.options["model"], "input": text})["data"][0]["embedding"]


def retried(call, value: str, waits: tuple[float, ...] = WAITS, sleep=time.sleep):
    """Up to three attempts; the last failure is raised."""
    for wait in (*waits, None):
        try:
            return call(value)
        except Exception:
            if wait is None:
                raise
            sleep(wait)


def with_replies(rows: DataFrame, client: ModelClient, prompt: str = "prompt", failed: str = APOLOGY, waits: tuple[float, ...] = WAITS) -> DataFrame:
    """Rows with reply and status; a failed call leaves ``failed`` and status ``error``."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            replies, states = [], []
            for text in batch.column(batch.schema.get_field_index(prompt)).to_pylist():
                try:
                    replies.append(retried(client.complete, text or "", waits))
                    states.append("ok")
                except Exception:
                    replies.append(failed)
                    states.append("error")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(replies, pa.string()), pa.array(states, pa.string())], [*batch.schema.names, "reply", "status"])

    return rows.mapInArrow(call, f"{kinds}, reply string, status string")


def with_embeddings(rows: DataFrame, client: ModelClient, text: str = "page_content") -> DataFrame:
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [retried(client.embed, t or "") for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(vectors, pa.list_(pa.float32()))], [*batch.schema.names, "embedding"])

    return rows.mapInArrow(call, f"{kinds}, embedding array<float>")


def answers(questions: DataFrame, client: ModelClient) -> DataFrame:
    return with_replies(questions.withColumn("prompt", prompts.plain(F.col("question"))), client)


def polished(texts: DataFrame, client: ModelClient) -> DataFrame:
    return with_replies(texts.withColumn("prompt", prompts.polish(F.col("text"))), client)


def extended(texts: DataFrame, client: ModelClient) -> DataFrame:
    return with_replies(texts.withColumn("prompt", prompts.extend(F.col("text"))), client)


def cached_answers(asked: DataFrame, cache: DataFrame, client: ModelClient, now: Column, ttl_s: int = ANSWER_TTL_S) -> tuple[DataFrame, DataFrame]:
    """Answers of ``asked`` (cache_key, prompt, ...), and the cache rows that they add.

    A key whose last entry in ``cache`` (key, op, ts, value, ttl_s) is a put that has not
    expired gives that value, status ``cached``. Every other key is asked once, however many
    rows it has; what has not failed goes into the cache.
    """
    last = cache.groupBy(F.col("key").alias("_key")).agg(F.max_by(F.struct("op", "ts", "value", "ttl_s"), "ts").alias("_last"))
    fresh = F.col("_last.ttl_s").isNull() | (now <= F.col("_last.ts") + F.make_dt_interval(secs=F.col("_last.ttl_s").cast("decimal(18,6)")))
    held = last.filter((F.col("_last.op") == "put") & fresh).select("_key", F.col("_last.value").alias("_value"))
    seen = asked.join(held, F.col("cache_key") == F.col("_key"), "left").drop("_key")
    new = with_replies(seen.filter("_value IS NULL").groupBy("cache_key").agg(F.min("prompt").alias("prompt")), client)
    told = new.select(F.col("cache_key").alias("_key"), F.col("reply").alias("_reply"), F.col("status").alias("_status"))
    rows = seen.join(told, F.col("cache_key") == F.col("_key"), "left")
    done = rows.withColumn("reply", F.coalesce("_value", "_reply")).withColumn("status", F.when(F.col("_value").isNotNull(), "cached").otherwise(F.col("_status")))
    puts = new.filter("status = 'ok'").select(F.col("cache_key").alias("key"), F.lit("put").alias("op"), now.alias("ts"), F.col("reply").alias("value"), F.lit(ttl_s).alias("ttl_s"))
    return done.drop("_key", "_value", "_reply", "_status"), puts


def completions(cursors: DataFrame, client: ModelClient, waits: tuple[float, ...] = WAITS) -> DataFrame:
    """Short completions at a cursor: the reply's first phrase; nothing for an empty prefix or a failed call."""
    asked = cursors.filter(F.col("prefix") != "").withColumn("prompt", prompts.complete(F.col("prefix"), F.col("suffix")))
    done = with_replies(asked, client, failed="", waits=waits).withColumn("completion", X.first_phrase(F.col("reply")))
    none = cursors.filter(F.coalesce(F.col("prefix") == "", F.lit(True))).withColumn("completion", F.lit(""))
    return done.unionByName(none, allowMissingColumns=True)
