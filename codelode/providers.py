"""Embedding providers: the one function of the engine that users plug in."""

from __future__ import annotations

import hashlib
import json
import math
import re
import time
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .sources.config import provider_order


class Provider(Protocol):
    """What an embedder offers. It is pickled to the workers, which call ``embed`` with batches of texts."""

    name: str
    model: str
    dimensions: int

    def embed(self, texts: list[str]) -> list[list[float] | None]: ...


@dataclass
class HashingProvider:
    """Words hashed to signed places, at length 1. Needs no model; the same text has the same vector everywhere."""

    dimensions: int = 384
    name: str = "embedded"
    model: str = "hashed-words"

    def embed(self, texts: list[str]) -> list[list[float] | None]:
        out = []
        for text in texts:
            v = [0.0] * self.dimensions
            for word in re.findall(r"[a-z0-9]+", text.lower()):
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                v[h % self.dimensions] += 1.0 if h >> 63 else -1.0
            length = math.sqrt(sum(x * x for x in v))
            out.append([x / length for x in v] if length else v)
        return out


@dataclass
class ConstantProvider:
    """The same vector for every text, for tests."""

    vector: tuple[float, ...] = (1.0, 2.0, 3.0)
    name: str = "constant"
    model: str = "constant"

    @property
    def dimensions(self) -> int:
        return len(self.vector)

    def embed(self, texts: list[str]) -> list[list[float] | None]:
        return [list(self.vector) for _ in texts]


#: Times that a server is asked, and seconds of waiting before the second time, doubled before each further one.
TRIES, WAIT_SECONDS = 3, 0.5


@dataclass
class RemoteProvider:
    """A server with the common ``/embeddings`` interface; a whole batch is one request, tried ``TRIES`` times."""

    base_url: str
    model: str
    dimensions: int = 0
    timeout_seconds: float = 30
    name: str = "remote"

    def endpoint(self) -> str:
        return self.base_url.rstrip("/") + "/embeddings"

    def _ask(self, texts: list[str]) -> list[list[float] | None]:
        body = json.dumps({"input": texts, "model": self.model}).encode()
        request = urllib.request.Request(self.endpoint(), body, {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.timeout_seconds) as reply:
            data = json.load(reply)["data"]
        found = {d.get("index", i): d["embedding"] for i, d in enumerate(data)}
        return [found.get(i) for i in range(len(texts))]

    def embed(self, texts: list[str]) -> list[list[float] | None]:
        """The vectors of the texts; raises if the server does not answer."""
        for k in range(TRIES):
            try:
                return self._ask(texts)
            except Exception:
                if k + 1 == TRIES:
                    raise
                time.sleep(WAIT_SECONDS * 2**k)
        raise AssertionError

    def probe(self) -> int:
        """The dimensions the server answers with; raises if it does not answer or answers with nothing."""
        vector = self.embed(["dimensions"])[0]
        if not vector:
            raise ValueError("the server answered without a vector")
        return len(vector)


@dataclass
class OnnxProvider:
    """A local model: token vectors averaged over the attention mask, at length 1. Needs model and tokenizer files."""

    model_path: str
    tokenizer_path: str
    model: str = "bge-small-en-v1.5"
    dimensions: int = 384
    sequence_length: int = 512
    name: str = "embedded"
    _loaded = None

    def _load(self):
        if self._loaded is None:
            import onnxruntime
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(self.tokenizer_path)
            tokenizer.enable_truncation(self.sequence_length)
            tokenizer.enable_padding()
            self._loaded = tokenizer, onnxruntime.InferenceSession(self.model_path)
        return self._loaded

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_loaded"}

    def embed(self, texts: list[str]) -> list[list[float] | None]:
        import numpy as np

        tokenizer, session = self._load()
        coded = tokenizer.encode_batch(texts)
        ids = np.array([c.ids for c in coded], dtype=np.int64)
        mask = np.array([c.attention_mask for c in coded], dtype=np.int64)
        feeds = {"input_ids": ids, "attention_mask": mask, "token_type_ids": np.zeros_like(ids)}
        wanted = {i.name for i in session.get_inputs()}
        hidden = session.run(None, {k: v for k, v in feeds.items() if k in wanted})[0]
        return pool(hidden, mask)


def pool(hidden, mask) -> list[list[float] | None]:
    """Masked mean of token vectors at length 1; None without tokens, unscaled if its length is 0."""
    import numpy as np

    out: list[list[float] | None] = []
    for tokens, on in zip(np.asarray(hidden, dtype=np.float64), np.asarray(mask)):
        if not on.any():
            out.append(None)
            continue
        mean = tokens[on.astype(bool)].mean(axis=0)
        length = float(np.sqrt((mean * mean).sum()))
        out.append((mean / length if length else mean).tolist())
    return out


def embed_column(provider: Provider, text: Column, batch: int = 64, strict: bool = False) -> Column:
    """The vectors of a text column, in Arrow batches; NULL where the text is.

    If a batch fails its texts are tried one by one, and those that fail have NULL, as a chunk without a vector is
    kept and found by its text; with ``strict`` the failure is raised instead.
    """

    def vectors_of(texts: list[str]) -> list:
        try:
            return provider.embed(texts)
        except Exception:
            if strict:
                raise
            return [None] if len(texts) == 1 else _one_by_one(texts)

    def _one_by_one(texts: list[str]) -> list:
        out: list = []
        for t in texts:
            out += vectors_of([t])
            if len(out) == 2 and out == [None, None]:  # the provider is down, not a text at fault
                return out + [None] * (len(texts) - 2)
        return out

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            out: list = []
            for i in range(0, len(part), batch):
                texts = part.iloc[i : i + batch].tolist()
                known = [t for t in texts if t is not None]
                found = iter(vectors_of(known) if known else [])
                out += [None if t is None else next(found) for t in texts]
            yield pd.Series(out, dtype=object)

    return run(text)


def make_provider(name: str, config: dict) -> Provider:
    """The provider of that name; raises if its files or settings are missing."""
    section = config.get(name) or {}
    if name == "remote":
        if not section.get("enabled") or not section.get("base_url"):
            raise ValueError("the remote provider is not enabled")
        remote = RemoteProvider(section["base_url"], section.get("model", ""), 0, section.get("timeout_seconds", 30))
        remote.dimensions = remote.probe()  # also tells whether the server is there
        return remote
    if name == "embedded":
        if section.get("model_path"):
            return OnnxProvider(section["model_path"], section["tokenizer_path"], section.get("model", ""), section.get("dimensions", 384), section.get("sequence_length", 512))
        if not section.get("enabled", True):
            raise ValueError("the embedded provider is not enabled")
        return HashingProvider(section.get("dimensions", 384))
    raise KeyError(name)


def resolve_provider(config: dict) -> Provider:
    """The first provider in order that can be made; unknown names are passed over; the last error is raised."""
    error: Exception = ValueError("no provider is configured")
    for name in provider_order(config):
        try:
            return make_provider(name, config)
        except KeyError:
            continue
        except Exception as e:
            error = e
    raise error


def provider_status(config: dict) -> list[dict]:
    """Each provider in order, and whether it can be made; a remote one's server is asked for a vector."""
    out = []
    for name in provider_order(config):
        try:
            p = make_provider(name, config)
            out.append({"provider": name, "ready": True, "model": p.model, "dimensions": p.dimensions, "detail": f"ready ({p.dimensions} dimensions)"})
        except Exception as e:
            out.append({"provider": name, "ready": False, "model": "", "dimensions": 0, "detail": str(e)})
    return out
