"""Seams of models: injected callables, loaded once in each worker, whose failure is remembered and said.

A model is a factory without arguments that gives a callable. Nothing here fetches one: the defaults are deterministic
and need no files. A model that can't be loaded makes its feature missing, with a reason; it never makes a job fail.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

TEXT_DIMS, IMAGE_DIMS, AUDIO_DIMS, VOICE_DIMS = 384, 512, 768, 256

_loaded: dict[str, tuple[object, str | None]] = {}


@dataclass
class LazyModel:
    """A model by name: loaded at first use in a process; what failed once isn't tried again there."""

    name: str
    factory: Callable[[], Callable]

    def load(self) -> Callable | None:
        if self.name not in _loaded:
            try:
                _loaded[self.name] = (self.factory(), None)
            except Exception as e:  # an absent library or file is a reason, not an error
                _loaded[self.name] = (None, f"{self.name} unavailable: {e}"[:500])
        return _loaded[self.name][0]

    @property
    def available(self) -> bool:
        return self.load() is not None

    @property
    def unavailable_reason(self) -> str | None:
        self.load()
        return _loaded[self.name][1]

    def forget(self) -> None:
        _loaded.pop(self.name, None)


@dataclass
class Models:
    """The models of a session by the name of their feature; absent ones are missing, with a reason."""

    items: dict[str, LazyModel] = field(default_factory=dict)

    def register(self, feature: str, factory: Callable[[], Callable]) -> Models:
        self.items[feature] = LazyModel(feature, factory)
        return self

    def get(self, feature: str) -> tuple[Callable | None, str | None]:
        own = self.items.get(feature)
        return (None, f"no model for {feature}") if own is None else (own.load(), own.unavailable_reason)

    def availability(self) -> dict[str, str]:
        return {k: "ok" if m.available else m.unavailable_reason for k, m in sorted(self.items.items())}


def hashing_encoder(dims: int = TEXT_DIMS) -> Callable[[str], list[float] | None]:
    """Texts as signed hashes of their words, of unit length; a blank text has no vector. The same on every machine."""

    def embed(text: str | None) -> list[float] | None:
        words = re.findall(r"\w+", (text or "").lower())
        if not words:
            return None
        v = np.zeros(dims)
        for w in words:
            h = zlib.crc32(w.encode())
            v[h % dims] += 1.0 if h >> 16 & 1 else -1.0
        size = float(np.linalg.norm(v))
        return None if size == 0 else (v / size).astype(float).tolist()

    return embed


def dictionary_entities(kinds: dict[str, str]) -> Callable[[str], str]:
    """An extractor that names the given words where they stand, as a model's answer would."""
    import json

    def extract(text: str | None) -> str:
        low = (text or "").lower()
        return json.dumps({"entities": [{"name": w, "type": k} for w, k in kinds.items() if re.search(rf"\b{re.escape(w.lower())}\b", low)]})

    return extract


def word_judge() -> Callable[[str, str], str]:
    """A judge by rule: claims that share words and differ by a negation contradict one another, those that share most words corroborate."""
    import json

    no = {"not", "no", "never", "nobody", "nothing", "without"}

    def judge(a: str | None, b: str | None) -> str:
        x, y = (set(re.findall(r"\w+", (t or "").lower())) for t in (a, b))
        common = (x & y) - no
        share = len(common) / max(1, min(len(x - no), len(y - no)))
        relation = "unrelated" if share < 0.5 else "contradicts" if bool(x & no) != bool(y & no) else "corroborates"
        return json.dumps({"relation": relation, "confidence": round(min(1.0, share), 2), "explanation": f"{len(common)} words in common"})

    return judge


def embedding(text: Column, model: LazyModel, dims: int) -> Column:
    """Each text's vector; null for a blank text, without a model, and for a vector of another dimension."""

    @F.pandas_udf(ArrayType(FloatType(), True))
    def run(texts: pd.Series) -> pd.Series:
        own = model.load()
        got = [None if own is None or not (t or "").strip() else own(t) for t in texts]
        return pd.Series([None if v is None or len(v) != dims else [float(x) for x in v] for v in got], dtype="object")

    return run(text)


def answers(text: Column, model: LazyModel, longest: int = 4_000) -> Column:
    """A model's answer to each text (cut to ``longest`` characters); null for a blank text, without a model, or where it fails."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        own, out = model.load(), []
        for t in texts:
            try:
                out.append(None if own is None or not (t or "").strip() else own(t[:longest]))
            except Exception:  # a model's fault costs its own answer only
                out.append(None)
        return pd.Series(out, dtype="object")

    return run(text)
