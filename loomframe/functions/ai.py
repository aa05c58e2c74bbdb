"""Model functions: a provider object embeds, classifies or answers, batch by batch in iterator UDFs.

A provider has ``embed_text(texts)``, ``embed_image(arrays)``,
``classify_text(texts, labels)``, ``classify_image(arrays, labels)`` and
``prompt(messages, system_message)``, each on lists. Providers are registered
by name; ``hashing`` is built in and needs no model or network: it embeds
words by hashed features and classifies by the label whose words are nearest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from .base import c, public

PROVIDERS: dict[str, object] = {}


class Hashing:
    """Signed hashed words, normalised."""

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def embed_text(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for t in texts:
            x = np.zeros(self.dimensions)
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                x[h % self.dimensions] += 1 if h >> 63 else -1
            n = np.linalg.norm(x)
            out.append(x / n if n else x)
        return out

    def embed_image(self, images: list[bytes]) -> list[np.ndarray]:
        return [np.histogram(np.frombuffer(b, np.uint8), self.dimensions, (0, 256))[0] / max(1, len(b)) for b in images]

    def classify_text(self, texts: list[str], labels: list[str]) -> list[str]:
        known = np.array(self.embed_text(labels))
        return [labels[int(np.argmax(known @ x))] for x in self.embed_text(texts)]

    def classify_image(self, images: list[bytes], labels: list[str]) -> list[str]:
        return [labels[int(x.argmax()) % len(labels)] for x in self.embed_image(images)]

    def prompt(self, messages: list[str], system_message: str | None = None) -> list[str]:
        return list(messages)


PROVIDERS["hashing"] = Hashing()


def register_provider(name: str, provider) -> None:
    PROVIDERS[name] = provider


def _provider(provider):
    if not isinstance(provider, str):
        return provider
    if provider not in PROVIDERS:
        raise ValueError(f"no provider {provider!r} is registered")
    return PROVIDERS[provider]


def _batched(f, kind: str):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            some = s.notna()
            out = pd.Series([None] * len(s), index=s.index, dtype="object")
            if some.any():
                out[some] = pd.Series(list(f(list(s[some]))), index=s.index[some], dtype="object")
            yield out

    return F.pandas_udf(run, kind)


@public
def embed_text(text, provider="hashing", **options):
    p = _provider(provider)
    return _batched(lambda x: p.embed_text(x, **options), "array<double>")(c(text))


@public
def embed_image(image, provider="hashing", **options):
    """Of the image's samples."""
    p = _provider(provider)
    return _batched(lambda x: p.embed_image(x, **options), "array<double>")(c(image).getField("data"))


@public
def classify_text(text, labels: list[str], provider="hashing", **options):
    p = _provider(provider)
    return _batched(lambda x: p.classify_text(x, labels, **options), "string")(c(text))


@public
def classify_image(image, labels: list[str], provider="hashing", **options):
    p = _provider(provider)
    return _batched(lambda x: p.classify_image(x, labels, **options), "string")(c(image).getField("data"))


@public
def prompt(messages, system_message: str | None = None, provider="hashing", **options):
    p = _provider(provider)
    return _batched(lambda x: p.prompt(x, system_message, **options), "string")(c(messages))


@public
def llm_generate(text, provider="hashing", **options):
    return prompt(text, provider=provider, **options)
