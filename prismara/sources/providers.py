"""Model providers: whatever turns a file into an understanding or a vector, called by batches."""

from __future__ import annotations

import base64
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..functions import labels, vectors

# The models that built-in vectors are filed under.
PIXEL_MODEL, PLACEHOLDER_MODEL = "ffmpeg-gray-8x8-v1", "placeholder-v1"


class Provider(Protocol):
    """A model behind whatever transport. Both calls may raise; the file then gets what comes next, at last the placeholder."""

    name: str
    model: str

    def understand(self, row: dict) -> dict: ...

    def embed(self, row: dict) -> list[float]: ...


class Placeholder:
    """Deterministic answers without a model (see labels.placeholder_understanding, which needs no Python)."""

    name, model = "placeholder", PLACEHOLDER_MODEL

    def understand(self, row: dict) -> dict:
        kind = str(row.get("media_type") or "").strip().lower()
        tag, about = labels.PLACEHOLDER["video" if kind == "video" else "image"]
        name = str(row.get("file_path") or "").strip().rsplit("/", 1)[-1] or labels.UNNAMED
        candidates = [{"namespace": "content", "name": tag, "confidence": 0.70}, {"namespace": labels.PLACEHOLDER_SPACE, "name": labels.PLACEHOLDER_TAG, "confidence": 0.60}]
        return {
            "raw_tags": [tag, labels.PLACEHOLDER_TAG], "canonical_candidates": candidates, "summary": f"{name}，{about}，{labels.PLACEHOLDER_REST}", "sensitive_tags": [], "quality_hints": ["placeholder"],
            "structured_attributes": {"media_type": kind or "unknown", "is_sensitive": False}, "confidence": labels.PLACEHOLDER_CONFIDENCE,
        }

    def embed(self, row: dict) -> list[float]:
        value = int(row.get("phash") or "0", 16)
        return [float(value >> (63 - i) & 1) for i in range(64)]


class Pixels:
    """Vectors of the grey samples that a row brings (`gray`, 8 by 8); it understands nothing."""

    name, model = "pixel", PIXEL_MODEL

    def understand(self, row: dict) -> dict:
        raise LookupError("pixels say nothing")

    def embed(self, row: dict) -> list[float]:
        gray = row.get("gray")
        if gray is None or not len(gray):
            raise LookupError("no samples")
        return [round(int(x) / 255, 4) for x in gray[:64]]


@dataclass
class Chat:
    """A vision model behind a chat endpoint. `post(url, body)` is the transport and gives the answer's JSON; `images`
    reads a path as bytes. With `parts` an image is a part of the content, else a list beside it."""

    post: Callable[[str, dict], dict]
    url: str
    model: str
    prompt: str
    name: str = "chat"
    parts: bool = False
    images: Callable[[str], bytes] = lambda path: open(path, "rb").read()
    most: int = 6

    def body(self, row: dict) -> dict:
        paths = [x for x in (row.get("frame_paths") if row.get("media_type") == "video" else [row.get("file_path")]) or [] if x][: self.most]
        shown = [base64.b64encode(self.images(x)).decode() for x in paths]
        if self.parts:
            content: object = [{"type": "text", "text": self.prompt}, *({"type": "image_url", "image_url": {"url": f"data:image/jpeg;base64,{x}"}} for x in shown)]
            return {"model": self.model, "messages": [{"role": "user", "content": content}]}
        return {"model": self.model, "stream": False, "format": "json", "messages": [{"role": "user", "content": self.prompt, "images": shown}]}

    def understand(self, row: dict) -> dict:
        got = self.post(self.url, self.body(row))
        message = (got.get("choices") or [{}])[0].get("message") if self.parts else got.get("message")
        text = (message or {}).get("content") or ""
        if isinstance(text, list):
            text = "".join(x.get("text", "") for x in text if isinstance(x, dict))
        found = json.loads(text[text.find("{") : text.rfind("}") + 1])
        return found

    def embed(self, row: dict) -> list[float]:
        raise LookupError("a chat model has no vectors")


def first_of(row: dict, chain: list[Provider], call: str) -> tuple[Provider, object]:
    """The first provider whose call succeeds, with its answer; the last one must."""
    for by in chain[:-1]:
        try:
            return by, getattr(by, call)(row)
        except Exception:  # a provider's failure must not end the job
            continue
    return chain[-1], getattr(chain[-1], call)(row)


def _chain(provider: Callable[[], Provider] | list[Callable[[], Provider]]) -> list[Provider]:
    return [make() for make in (provider if isinstance(provider, list) else [provider])] + [Placeholder()]


def understand(df: DataFrame, provider: Callable[[], Provider] | list[Callable[[], Provider]] = Placeholder, keep: tuple[str, ...] = ("file_id", "media_type")) -> DataFrame:
    """keep, and the answer as JSON with the provider and model that gave it: of several providers the first that succeeds, else the placeholder."""
    schema = df.select(*keep).schema.add("provider", "string").add("model", "string").add("payload", "string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chain = _chain(provider)
        for batch in batches:
            rows = []
            for row in batch.to_dict("records"):
                by, answer = first_of(row, chain, "understand")
                rows.append((by.name, by.model, json.dumps(answer, ensure_ascii=False)))
            yield pd.concat([batch[[*keep]].reset_index(drop=True), pd.DataFrame(rows, columns=["provider", "model", "payload"])], axis=1)

    return df.mapInPandas(run, schema)


def embed(df: DataFrame, provider: Callable[[], Provider] | list[Callable[[], Provider]] = Placeholder, phash: str = "phash", keep: tuple[str, ...] = ("file_id",)) -> DataFrame:
    """keep, model_name and vector of rows with a perceptual hash: of several providers the first that succeeds, else the placeholder, which needs no Python."""
    rows = df.where(f"{phash} <> ''")
    if provider is Placeholder:
        return rows.select(*keep, F.lit(PLACEHOLDER_MODEL).alias("model_name"), vectors.phash_vector(F.col(phash)).alias("vector"))
    schema = df.select(*keep).schema.add("model_name", "string").add("vector", ArrayType(DoubleType()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chain = _chain(provider)
        for batch in batches:
            made = [(by.model, vector) for by, vector in (first_of(row, chain, "embed") for row in batch.to_dict("records"))]
            yield pd.concat([batch[[*keep]].reset_index(drop=True), pd.DataFrame(made, columns=["model_name", "vector"])], axis=1)

    return rows.mapInPandas(run, schema)


def semantic_model(provider: Column | None = None, model: Column | None = None) -> Column:
    """The name under which vectors of an understanding's tokens go: it names who gave the understanding."""
    said = lambda x: F.coalesce(F.nullif(F.trim(x), F.lit("")), F.lit("unknown")) if x is not None else F.lit("unknown")
    return F.concat(F.lit("semantic-"), said(provider), F.lit("-"), said(model), F.lit("-v1"))


def fallback_vectors(gray: Column, tokens: Column, phash: Column, provider: Column | None = None, model: Column | None = None) -> Column:
    """(model, vector) by the same chain as Columns: grey samples, else tokens of an understanding by a provider's model, else
    the perceptual hash."""
    made = [(F.lit(PIXEL_MODEL), vectors.pixel_vector(gray)), (semantic_model(provider, model), vectors.token_vector(tokens)), (F.lit(PLACEHOLDER_MODEL), F.when(phash.rlike("^[0-9a-fA-F]{16}$"), vectors.phash_vector(phash)))]
    return F.coalesce(*(F.when(v.isNotNull(), F.struct(m.alias("model"), v.alias("vector"))) for m, v in made))
