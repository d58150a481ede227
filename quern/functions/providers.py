"""Language-model and embedding providers.

Deterministic ones are Columns and stay in the JVM.  Calls over HTTP run in
``mapInPandas`` with one client per partition, and are repeated only for replies
that allow it.  A task may run twice, so calls must be safe to repeat.
"""

from __future__ import annotations

import json
import random
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ProviderError(RuntimeError):
    """A call that failed for good."""


def byte_tokens(text: Column) -> Column:
    """The providers' estimate: one token per four bytes."""
    return F.floor(F.octet_length(F.coalesce(text, F.lit(""))) / 4).cast("int")


def echo(system: Column) -> Column:
    return F.coalesce(system, F.lit(""))


def hashed(request: Column) -> Column:
    """A reply that depends on the whole request: the first eight bytes of its sha-256."""
    return F.concat(F.lit("mock-"), F.substring(F.sha2(F.to_json(request), 256), 1, 16))


def context_echo(system: Column, length: int = 200) -> Column:
    """A preamble and the first characters from ``Context:`` on."""
    at = F.locate("Context:", system)
    return F.concat(F.lit("Based on the context: "), F.when(at > 0, F.substr(system, at, F.lit(length))).otherwise(F.lit("")))


def canned(text: str = "A short summary of the given descriptions.") -> Callable[[Column], Column]:
    return lambda _: F.lit(text)


# Names of the deterministic providers.
PROVIDERS: dict[str, Callable[[Column], Column]] = {"echo": echo, "mock": context_echo, "canned": canned()}


def pick(name: str) -> Callable[[Column], Column]:
    if name not in PROVIDERS:
        raise ValueError(f"unknown provider {name!r}")
    return PROVIDERS[name]


@dataclass(frozen=True)
class Endpoint:
    """Where and how to call: nothing is read from the environment."""

    base_url: str
    model: str
    api_key: str = ""
    timeout: float = 60.0
    max_attempts: int = 3
    first_delay: float = 0.2
    batch_size: int = 128


def delay(attempt: int, first: float = 0.2, spread: float = 0.2) -> float:
    """Seconds before the next attempt: tripled each time, a fifth up or down."""
    return first * 3 ** (attempt - 1) * (1 + random.uniform(-spread, spread))


def post(endpoint: Endpoint, path: str, body: dict) -> dict:
    """A JSON call; 429 and server errors are repeated, other failures raise at once."""
    for attempt in range(1, endpoint.max_attempts + 1):
        call = urllib.request.Request(endpoint.base_url.rstrip("/") + path, json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {endpoint.api_key}"})
        try:
            with urllib.request.urlopen(call, timeout=endpoint.timeout) as reply:
                return json.load(reply)
        except urllib.error.HTTPError as e:
            if e.code != 429 and e.code < 500 or attempt == endpoint.max_attempts:
                raise ProviderError(f"{path}: status {e.code}") from e
            time.sleep(delay(attempt, endpoint.first_delay))
        except (urllib.error.URLError, TimeoutError) as e:
            raise ProviderError(f"{path}: {e}") from e
    raise ProviderError(path)


def complete(requests: DataFrame, endpoint: Endpoint, key: str, system: str = "system", user: str = "user") -> DataFrame:
    """``key, text, input_tokens, output_tokens`` for each request."""
    def run(batches: Iterator) -> Iterator:
        for pdf in batches:
            out = []
            for k, s, u in zip(pdf[key], pdf[system], pdf[user]):
                messages = ([{"role": "system", "content": s}] if s else []) + [{"role": "user", "content": u}]
                reply = post(endpoint, "/chat/completions", {"model": endpoint.model, "messages": messages, "stream": False})
                if not reply.get("choices"):
                    raise ProviderError("no choices in the reply")
                usage = reply.get("usage", {})
                out.append((k, reply["choices"][0]["message"]["content"], usage.get("prompt_tokens", 0), usage.get("completion_tokens", 0)))
            yield type(pdf)(out, columns=[key, "text", "input_tokens", "output_tokens"])

    return requests.select(key, system, user).mapInPandas(run, f"`{key}` {dict(requests.dtypes)[key]}, text string, input_tokens int, output_tokens int")


def embed(texts: DataFrame, endpoint: Endpoint, key: str, text: str) -> DataFrame:
    """``key, vector``: embedded in batches, each reply put back in place by its index."""
    if endpoint.batch_size <= 0:
        raise ValueError("the batch size must be positive")

    def run(batches: Iterator) -> Iterator:
        for pdf in batches:
            vectors: list = []
            for at in range(0, len(pdf), endpoint.batch_size):
                part = pdf[text].iloc[at : at + endpoint.batch_size].tolist()
                data = post(endpoint, "/embeddings", {"model": endpoint.model, "input": part}).get("data", [])
                placed = {d["index"]: d["embedding"] for d in data}
                if sorted(placed) != list(range(len(part))):
                    raise ProviderError("the reply does not match the batch")
                vectors += [placed[i] for i in range(len(part))]
            yield type(pdf)({key: pdf[key].tolist(), "vector": vectors})

    return texts.select(key, text).mapInPandas(run, f"`{key}` {dict(texts.dtypes)[key]}, vector array<double>")
