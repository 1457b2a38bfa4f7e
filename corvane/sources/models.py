"""Models are plain callables; here are deterministic ones, HTTP ones, and the cache before them."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import string_hash

STOP_WORDS = frozenset("a an and are as at be by for from how in is it of on or that the this to was what when where which who why with".split())


def hashing_embedder(dimension: int = 1024) -> Callable[[Sequence[str]], list[list[float]]]:
    """Bags of words and word pairs, hashed into a unit vector."""

    def embed(texts: Sequence[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * dimension
            words = [w for w in re.split(r"[\W_]+", (text or "").lower()) if w and w not in STOP_WORDS]
            for w in words:
                v[string_hash(w) % dimension] += 1.0
            for a, b in zip(words, words[1:]):
                v[string_hash(f"{a}::{b}") % dimension] += 1.5
            n = sum(x * x for x in v) ** 0.5
            out.append([x / n for x in v] if n else v)
        return out

    return embed


def lookup_embedder(known: dict[str, Sequence[float]], default: Sequence[float]) -> Callable[[Sequence[str]], list]:
    return lambda texts: [list(known.get(t, default)) for t in texts]


def embed_column(rows: DataFrame, text_col: str, embed: Callable, out: str = "vector", batch: int = 32) -> DataFrame:
    """rows with vectors, embedded in batches; a model that returns another number of vectors is an error."""
    kept = [c for c in rows.columns if c != out]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, vectors = b[text_col].fillna("").tolist(), []
            for i in range(0, len(texts), batch):
                found = embed(texts[i : i + batch])
                if len(found) != len(texts[i : i + batch]):
                    raise ValueError("the model returned another number of vectors than it got texts")
                vectors += [[float(x) for x in v] for v in found]
            yield b.assign(**{out: vectors})

    base = rows.select(*kept)
    return base.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema) + f", `{out}` array<double>")


def cache_id(role: str, request: Column) -> Column:
    return F.concat(F.lit(f"default:{role}:"), F.sha2(request, 256))


def generate_cached(requests: DataFrame, cache: DataFrame, chat: Callable[[str], str], role: str = "extraction", text_col: str = "prompt") -> tuple[DataFrame, DataFrame]:
    """(requests with `response` and `cache_id`, new rows for the cache): only requests that it lacks reach the model, each once."""
    keyed = requests.withColumn("cache_id", cache_id(role, F.col(text_col)))
    missing = keyed.select(F.col("cache_id").alias("id"), F.col(text_col).alias("prompt")).dropDuplicates(["id"]).join(cache, "id", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "value": [chat(p) for p in b["prompt"]]})

    fresh = missing.mapInPandas(run, "id string, value string")
    known = cache.select("id", "value").unionByName(fresh)
    return keyed.join(known.select(F.col("id").alias("cache_id"), F.col("value").alias("response")), "cache_id", "left"), fresh


def canonical_request(system: str, user: str, history: Sequence[tuple[str, str]] = ()) -> str:
    return json.dumps({"history": [list(h) for h in history], "system": system, "user": user}, ensure_ascii=False, sort_keys=True)


def request_id(role: str, system: str, user: str, history: Sequence[tuple[str, str]] = ()) -> str:
    return f"default:{role}:" + hashlib.sha256(canonical_request(system, user, history).encode()).hexdigest()


class HttpChat:
    """A chat model behind an OpenAI-compatible endpoint: buffered by call, in pieces by stream."""

    def __init__(self, base_url: str, model: str, api_key: str = "", timeout: float = 60):
        self.base_url, self.model, self.api_key, self.timeout = base_url.rstrip("/"), model, api_key, timeout

    def _open(self, path: str, body: dict):
        from urllib.request import Request, urlopen

        head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.api_key}"} if self.api_key else {})
        return urlopen(Request(self.base_url + path, json.dumps(body).encode(), head), timeout=self.timeout)

    def _body(self, user: str, system: str, history, stream: bool) -> dict:
        said = [{"role": "system", "content": system}] if system else []
        said += [{"role": r, "content": c} for r, c in history] + [{"role": "user", "content": user}]
        return {"model": self.model, "messages": said, "stream": stream}

    def __call__(self, user: str, system: str = "", history: Sequence[tuple[str, str]] = ()) -> str:
        with self._open("/chat/completions", self._body(user, system, history, False)) as r:
            return json.load(r)["choices"][0]["message"]["content"]

    def stream(self, user: str, system: str = "", history: Sequence[tuple[str, str]] = ()) -> Iterator[str]:
        with self._open("/chat/completions", self._body(user, system, history, True)) as r:
            yield from server_sent_pieces(x.decode() for x in r)

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        with self._open("/embeddings", {"model": self.model, "input": list(texts)}) as r:
            return [d["embedding"] for d in sorted(json.load(r)["data"], key=lambda d: d["index"])]


def server_sent_pieces(lines: Iterator[str]) -> Iterator[str]:
    """The text pieces of a stream of server-sent events."""
    for line in lines:
        data = line.strip().removeprefix("data:").strip()
        if line.startswith("data:") and data and data != "[DONE]":
            piece = (json.loads(data).get("choices") or [{}])[0].get("delta", {}).get("content")
            if piece:
                yield piece
