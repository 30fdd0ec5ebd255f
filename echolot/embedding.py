"""Vectors of texts: a protocol, a deterministic embedder, and an adapter for neural models."""

from __future__ import annotations

import hashlib
import logging
import re
import sys
from collections.abc import Callable
from importlib import metadata
from importlib.util import find_spec
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import profiles

log = logging.getLogger(__name__)


class SemanticBackendError(RuntimeError):
    """A model can't be loaded or run."""


class Embedder(Protocol):
    def __call__(self, texts: list[str], batch_size: int) -> np.ndarray:
        """A row of length 1 for each text."""


class TermFrequency:
    """Hashed counts of words: deterministic, needs no model, and is no stand-in for one; model thresholds mean nothing for it."""

    def __init__(self, size: int = 4096) -> None:
        self.size = size

    def __call__(self, texts: list[str], batch_size: int = 8) -> np.ndarray:
        out = np.zeros((len(texts), self.size))
        for i, t in enumerate(texts):
            for w in re.findall(r"[^\W_]+", t.lower()):
                out[i, int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest()) % self.size] += 1
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(length > 0, length, 1)


def versions() -> dict[str, str]:
    """What runs models here: the version of each package, or that it is missing."""
    found = {"python": sys.version.split()[0]}
    for package in ("torch", "transformers", "sentence-transformers", "deepspeed"):
        try:
            found[package] = metadata.version(package)
        except metadata.PackageNotFoundError:
            found[package] = "missing"
    return found


#: Versions that models of one family run with: from the first on, and before the second.
SUPPORTED = {"c2llm": {"transformers": ((4, 51), (5,)), "sentence-transformers": ((5,), (6,))}}


def preflight(model: str, found: dict[str, str] | None = None) -> None:
    """SemanticBackendError if the model's family needs packages that are missing or of other versions."""
    found, family = found or versions(), profiles.profile(model).family
    for package, (low, high) in SUPPORTED.get(family, {}).items():
        number = tuple(int(x) for x in re.findall(r"\d+", found[package])[:3])
        if not low <= number < high:
            raise SemanticBackendError(f"{package} {found[package]} doesn't run {family} models; it must be >={'.'.join(map(str, low))},<{'.'.join(map(str, high))}")
    if family == "c2llm" and found["deepspeed"] == "missing":
        raise ModuleNotFoundError("deepspeed is required for C2LLM models")


def truncated(text: str, tokenizer, max_tokens: int | None) -> str:
    """The text's first ``max_tokens`` tokens, or four times as many characters where they can't be decoded; all of it if it can't be counted."""
    if not tokenizer or not max_tokens:
        return text
    try:
        ids = tokenizer.encode(text, add_special_tokens=False)
    except Exception:
        log.debug("a text can't be tokenized and is used whole", exc_info=True)
        return text
    if len(ids) <= max_tokens:
        return text
    log.warning("a text of %d tokens is cut to %d", len(ids), max_tokens)
    try:
        return tokenizer.decode(ids[:max_tokens], skip_special_tokens=True)
    except Exception:
        return text[: 4 * max_tokens]


_loaded: dict[tuple, object] = {}
_OUT_OF_MEMORY = ("out of memory", "cuda oom", "mps backend out of memory")


class SentenceModel:
    """A sentence-transformers model, loaded once in each Python worker.

    A batch that doesn't fit in the accelerator's memory is halved down to one
    text, then run on the processor once; what still fails is raised.
    """

    def __init__(self, model: str, revision: str | None = None, trust_remote_code: bool | None = None) -> None:
        self.options = profiles.load_options(model, revision, trust_remote_code)

    def _model(self):
        key = tuple(self.options.values())
        if key not in _loaded:
            preflight(self.options["name"])
            try:
                from sentence_transformers import SentenceTransformer
            except ImportError as e:
                raise ModuleNotFoundError("semantic analysis needs sentence-transformers") from e
            try:
                _loaded[key] = SentenceTransformer(self.options["name"], revision=self.options["revision"], trust_remote_code=self.options["trust_remote_code"])
            except Exception as e:
                raise SemanticBackendError(self._said("can't be loaded", e)) from e
        return _loaded[key]

    def _said(self, what: str, e: Exception) -> str:
        return f"{self.options['name']} {what}: {e}. revision={self.options['revision']} trust_remote_code={self.options['trust_remote_code']} [{', '.join(f'{k}={v}' for k, v in versions().items())}]"

    def check(self) -> None:
        """Fails on the driver, before any job, where packages are missing or don't fit the model."""
        if find_spec("sentence_transformers") is None:
            raise ModuleNotFoundError("semantic analysis needs sentence-transformers")
        preflight(self.options["name"])

    def __call__(self, texts: list[str], batch_size: int = 8) -> np.ndarray:
        model = self._model()
        limit, tokenizer = getattr(model, "max_seq_length", None), getattr(model, "tokenizer", None)
        try:
            return encode_with_backoff(model.encode, [truncated(t, tokenizer, limit) for t in texts], batch_size)
        except SemanticBackendError as e:
            raise SemanticBackendError(self._said("can't encode", e)) from e


def encode_with_backoff(encode: Callable, texts: list[str], batch_size: int) -> np.ndarray:
    size, device = batch_size, None
    while True:
        options = {"batch_size": size, "normalize_embeddings": True, "show_progress_bar": False}
        try:
            try:
                return np.asarray(encode(texts, **options, **({"device": device} if device else {})))
            except TypeError:
                return np.asarray(encode(texts, **options))
        except RuntimeError as e:
            if not any(m in str(e).lower() for m in _OUT_OF_MEMORY):
                raise SemanticBackendError(str(e)) from e
            if size > 1:
                size //= 2
            elif device is None:
                device = "cpu"
            else:
                raise


def embedded(units: DataFrame, embedder: Embedder, prefix: str = "", batch_size: int = 8, keep: tuple[str, ...] = ("unit_id",)) -> DataFrame:
    """``keep`` and embedding of each unit: of the prefix and the stripped source."""
    fields = {f.name: f.dataType.simpleString() for f in units.schema}
    columns = list(keep)

    def run(batches):
        for b in batches:
            if len(b):
                v = embedder([prefix + (s or "").strip() for s in b["source"]], batch_size)
                yield pd.DataFrame({**{c: b[c] for c in columns}, "embedding": list(np.asarray(v, np.float64))})

    ddl = ", ".join(f"`{c}` {fields[c]}" for c in columns) + ", embedding array<double>"
    return units.select(*columns, F.col("source")).mapInPandas(run, ddl)
