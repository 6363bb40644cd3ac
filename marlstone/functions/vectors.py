"""Vectors: cosine similarity, and the backends that embed texts."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import embed_tokens

DIMENSIONS = 256
EVEN_CODED = "bdfhjlnprtvxz02468"


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if lengths differ or a norm is 0."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) != F.size(b), 0.0).when(norms == 0, 0.0).otherwise(F.coalesce(F.try_divide(dot(a, b), norms), F.lit(0.0)))


def to_json(vector: Column) -> Column:
    return F.to_json(vector)


def from_json(text: Column) -> Column:
    return F.from_json(text, "array<double>")


def local_sign(text: Column) -> Column:
    """-1, 0 or 1: the local embedding is this times (1, -1, 1, -1, ...) / 16.

    A token counts 1 if it has an odd number of characters with odd codes, else -1; the sign of the sum over
    the first 4096 characters decides.
    """
    odd = lambda t: F.length(F.translate(t, EVEN_CODED, "")) % 2 == 1
    total = F.aggregate(embed_tokens(F.substring(text, 1, 4096)), F.lit(0), lambda s, t: s + F.when(odd(t), 1).otherwise(-1))
    return F.signum(total).cast("int")


def local_embedding(text: Column) -> Column:
    """The local embedding as 256 doubles; the sign is bound as a lambda's variable, so that it is computed once."""
    axes = F.sequence(F.lit(0), F.lit(DIMENSIONS - 1))
    return F.get(F.transform(F.array(local_sign(text)), lambda s: F.transform(axes, lambda d: s * F.when(d % 2 == 0, 0.0625).otherwise(-0.0625))), F.lit(0))


class EmbeddingBackend(Protocol):
    """How a search compares a chunk with its query; both give columns."""

    def embedded(self) -> Column:
        """Whether the chunk has an embedding."""

    def similarity(self) -> Column:
        """Cosine of the query and the chunk."""


class LocalBackend:
    """Compares signs of local embeddings; sign names a column that holds them, else they come from the text."""

    def __init__(self, query: str, text: Column | str = "content", sign: str | None = None):
        self.query, self.text, self.sign = query, F.col(text) if isinstance(text, str) else text, sign

    def embedded(self) -> Column:
        return F.col(self.sign).isNotNull() if self.sign else self.text.isNotNull()

    def similarity(self) -> Column:
        own = F.col(self.sign) if self.sign else local_sign(self.text)
        return (local_sign(F.lit(self.query)) * own).cast("double")


class VectorBackend:
    """Compares stored vectors with the query's."""

    def __init__(self, query_vector: list[float], column: str = "embedding"):
        self.vector, self.column = F.array(*[F.lit(float(x)) for x in query_vector]), column

    def embedded(self) -> Column:
        return F.col(self.column).isNotNull()

    def similarity(self) -> Column:
        return cosine(self.vector, F.col(self.column))


#: How many characters of a text the two kinds of services are given.
HOSTED_CHARS, SERVER_CHARS = 8000, 8192


def backend_name(explicit: str | None, has_key: bool) -> str:
    """Which embeddings to use: what is asked for, else a hosted service if there is a key for it, else local ones."""
    return explicit or ("hosted" if has_key else "local")


def backend_choice(explicit: Column, has_key: Column) -> Column:
    """backend_name of a row: what it asks for (null or empty: nothing), else by whether it has a key."""
    return F.coalesce(F.nullif(explicit, F.lit("")), F.when(has_key, "hosted").otherwise("local"))


def embedded_by(client: Callable[[list[str]], list[list[float] | None]], most_chars: int = SERVER_CHARS, batch: int = 64) -> Callable[[Column], Column]:
    """A Column function that embeds texts by a client of the caller's, which Arrow batches are handed to in parts.

    client is pickled and runs on the executors. What it gives as None, and null texts, are null vectors.
    """

    @F.arrow_udf("array<double>")
    def embed(texts: pa.Array) -> pa.Array:
        rows, out = texts.to_pylist(), [None] * len(texts)
        at = [i for i, t in enumerate(rows) if t is not None]
        for s in range(0, len(at), batch):
            part = at[s : s + batch]
            for i, v in zip(part, client([rows[i][:most_chars] for i in part]), strict=True):
                out[i] = None if v is None else [float(x) for x in v]
        return pa.array(out, pa.list_(pa.float64()))

    return embed


def hosted_by(client: Callable[[list[str]], list[list[float] | None]], batch: int = 64) -> Callable[[Column], Column]:
    """embedded_by with the limit of hosted services."""
    return embedded_by(client, HOSTED_CHARS, batch)
