"""Clients of embedding services over HTTP, to be handed to embedded_by, and a table that keeps what they have given.

A client is pickled and runs in tasks; batches of texts go to it. What was embedded once is kept by the hash of the model and the text, so a text is
sent again only if the last try failed.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import HOSTED_CHARS, SERVER_CHARS, embedded_by
from ..plans.materialize import materialized

#: Answers after which a call is tried again.
BUSY = (408, 429, 500, 502, 503, 504)


class ServiceError(Exception):
    """A service has not answered, or not with embeddings."""


@dataclass(frozen=True)
class Service:
    """An embedding service. kind: "hosted" takes many texts a call and a key, "server" one text a call."""

    url: str
    model: str
    kind: str = "hosted"
    key: str | None = None
    tries: int = 3
    wait: float = 0.5
    timeout: float = 30.0
    batch: int = 64

    @property
    def most_chars(self) -> int:
        return HOSTED_CHARS if self.kind == "hosted" else SERVER_CHARS

    def _post(self, path: str, body: dict) -> dict:
        head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        for left in reversed(range(self.tries)):
            try:
                with urllib.request.urlopen(urllib.request.Request(self.url.rstrip("/") + path, json.dumps(body).encode(), head), timeout=self.timeout) as answer:
                    return json.load(answer)
            except urllib.error.HTTPError as e:
                why = f"{e.code} {e.read(500).decode(errors='replace')}"
                if e.code not in BUSY or not left:
                    break
            except (OSError, ValueError) as e:
                why = str(e)
                if not left:
                    break
            time.sleep(self.wait * 2 ** (self.tries - 1 - left))
        raise ServiceError(f"embedding failed: {why}")

    def embed(self, texts: list[str]) -> list[list[float]]:
        """The vectors of texts; ServiceError if the service doesn't give them."""
        texts = [t[: self.most_chars] for t in texts]
        try:
            if self.kind == "hosted":
                data = self._post("/v1/embeddings", {"model": self.model, "input": texts})["data"]
                found = [x["embedding"] for x in sorted(data, key=lambda x: x.get("index", 0))]
            else:
                found = [self._post("/api/embeddings", {"model": self.model, "prompt": t})["embedding"] for t in texts]
        except (KeyError, TypeError) as e:
            raise ServiceError(f"embedding failed: no {e} in the answer") from e
        if len(found) != len(texts):
            raise ServiceError(f"embedding failed: {len(found)} vectors for {len(texts)} texts")
        return found

    def __call__(self, texts: list[str]) -> list[list[float] | None]:
        """Like embed, but None for texts that the service doesn't take; a batch that fails is sent text by text."""
        try:
            return self.embed(texts)
        except ServiceError:
            if len(texts) == 1:
                return [None]
        return [x for t in texts for x in self([t])]


def text_hash(text: Column, service: Service) -> Column:
    return F.sha2(F.concat(F.lit(f"{service.kind}:{service.model}:"), F.substring(text, 1, service.most_chars)), 256)


def new_vectors(texts: DataFrame, kept: DataFrame, service: Service, client: Callable | None = None) -> DataFrame:
    """hash, embedding of the different texts (text) that kept (hash) doesn't have; each is sent once. Null embeddings are failures. A written table."""
    wanted = texts.where("text is not null").select(text_hash(F.col("text"), service).alias("hash"), F.substring("text", 1, service.most_chars).alias("text"))
    wanted = wanted.groupBy("hash").agg(F.any_value("text").alias("text")).join(kept.select("hash"), "hash", "left_anti")
    embed = embedded_by(client or service, service.most_chars, service.batch)
    return materialized(wanted.select("hash", embed("text").alias("embedding")))


def with_vectors(rows: DataFrame, text: Column, kept: DataFrame, service: Service) -> DataFrame:
    """rows with embedding from kept (hash, embedding), null where it has none; a column embedding of rows is replaced."""
    own = rows.drop("embedding").withColumn("_hash", text_hash(text, service))
    return own.join(kept.select(F.col("hash").alias("_hash"), "embedding"), "_hash", "left").drop("_hash")
