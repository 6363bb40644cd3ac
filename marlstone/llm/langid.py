"""Language ID: a bidirectional gated recurrent network over bytes, trained here by backpropagation through time.

Texts are cut into windows of WINDOW bytes; in each, a forward and a backward pass label every byte, and a
document's probabilities are the mean over its bytes. It learns every language that has labels, from a bounded
sample: PER_LANG documents of each, fewer if there are more than MOST_LANGS languages but at least one, first by a hash of
doc_id, and of each at most PER_TEXT windows of TRAIN_WINDOW bytes, evenly spaced; these are cut where the texts are.
Prediction reads whole texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, first_by_hash, map_batches, row_slices, temporary, text_buffer, tidy, written

HIDDEN = 8
WINDOW = 96
PER_LANG = 400
MOST_LANGS = 64
STEPS, BATCH, LEARN_RATE = 250, 128, 0.02
TRAIN_WINDOW, PER_TEXT = 48, 24
FOLDS, HELD_OUT = 4, 2
SLICE = 384 << 10


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def _sigmoid(x):
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class Network:
    """Weights by name; direction f reads forwards, b backwards. Bytes enter through tables of 256 rows."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 3):
        rng = np.random.default_rng(seed)
        h, c = hidden, len(languages)
        self.languages, self.hidden = languages, h
        self.w = {}
        for d in "fb":
            self.w |= {f"{d}x": rng.normal(0, 0.3, (256, 3 * h)), f"{d}u": rng.normal(0, 0.3, (h, 2 * h)), f"{d}n": rng.normal(0, 0.3, (h, h))}
        self.w |= {"v": rng.normal(0, 0.3, (2 * h, c)), "c": np.zeros(c)}
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}

    def states(self, x: np.ndarray, d: str, keep: bool = False, active: np.ndarray | None = None):
        """x: (steps, rows) bytes. Hidden states (steps, rows, hidden); with keep, what backpropagation needs.

        active: how many of the first rows have a byte at each step; the others keep a state of zeros.
        """
        if active is not None:
            return self._active_states(x, d, active)
        h, w = self.hidden, self.w
        gates, new = w[f"{d}x"][:, : 2 * h].copy(), w[f"{d}x"][:, 2 * h :].copy()
        out = np.empty((*x.shape, h), np.float32)
        saved, s = [], np.zeros((x.shape[1], h), np.float32)
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            g = np.take(gates, x[t], axis=0)
            g += s @ w[f"{d}u"]
            g *= 0.5
            np.tanh(g, out=g)
            g *= 0.5
            g += 0.5
            r, z = g[:, :h], g[:, h:]
            rs = r * s
            n = np.take(new, x[t], axis=0)
            n += rs @ w[f"{d}n"]
            np.tanh(n, out=n)
            before = s
            s = n + z * (s - n)
            out[t] = s
            if keep:
                saved.append((t, before, r, z, n, rs))
        return (out, saved) if keep else out

    def _active_states(self, x: np.ndarray, d: str, active: np.ndarray) -> np.ndarray:
        h, w = self.hidden, self.w
        gates, new = w[f"{d}x"][:, : 2 * h].copy(), w[f"{d}x"][:, 2 * h :].copy()
        out = np.zeros((*x.shape, h), np.float32)
        state = np.zeros((x.shape[1], h), np.float32)
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            k = active[t]
            s, now = state[:k], x[t, :k]
            g = np.take(gates, now, axis=0)
            g += s @ w[f"{d}u"]
            g *= 0.5
            np.tanh(g, out=g)
            g *= 0.5
            g += 0.5
            n = np.take(new, now, axis=0)
            n += (g[:, :h] * s) @ w[f"{d}n"]
            np.tanh(n, out=n)
            s -= n
            s *= g[:, h:]
            s += n
            out[t, :k] = s
        return out

    def probabilities(self, x: np.ndarray, active: np.ndarray) -> np.ndarray:
        """(steps, rows, languages)."""
        y = self.states(x, "f", active=active) @ self.w["v"][: self.hidden]
        y += self.states(x, "b", active=active) @ self.w["v"][self.hidden :]
        y += self.w["c"]
        y -= y.max(axis=-1, keepdims=True)
        np.exp(y, out=y)
        y /= y.sum(axis=-1, keepdims=True)
        return y

    def gradients(self, x: np.ndarray, target: np.ndarray) -> tuple[float, dict]:
        """Loss and its gradients, by backpropagation through time; every byte of row i should be target[i]."""
        h, w = self.hidden, self.w
        steps, rows = x.shape
        run = {d: self.states(x, d, True) for d in "fb"}
        both = np.concatenate([run["f"][0], run["b"][0]], axis=-1)
        y = both @ w["v"] + w["c"]
        y -= y.max(axis=-1, keepdims=True)
        p = np.exp(y)
        p /= p.sum(axis=-1, keepdims=True)
        at = np.arange(rows)
        loss = -np.log(p[:, at, target] + 1e-9).mean()
        p[:, at, target] -= 1
        p /= steps * rows
        g = {k: np.zeros_like(v) for k, v in w.items()}
        g["v"] = np.tensordot(both, p, axes=([0, 1], [0, 1]))
        g["c"] = p.sum(axis=(0, 1))
        back = p @ w["v"].T
        for d, part in (("f", back[..., :h]), ("b", back[..., h:])):
            carry = np.zeros((rows, h), np.float32)
            for t, before, r, z, n, rs in reversed(run[d][1]):
                ds = part[t] + carry
                dn = ds * (1 - z) * (1 - n * n)
                dz = ds * (before - n) * z * (1 - z)
                drs = dn @ w[f"{d}n"].T
                dr = drs * before * r * (1 - r)
                dg = np.concatenate([dr, dz], axis=1)
                g[f"{d}n"] += rs.T @ dn
                g[f"{d}u"] += before.T @ dg
                np.add.at(g[f"{d}x"], x[t], np.concatenate([dg, dn], axis=1))
                carry = ds * z + drs * r + dg @ w[f"{d}u"].T
        return float(loss), g

    def train(self, texts: list[np.ndarray], labels: np.ndarray, steps: int = STEPS, seed: int = 5) -> float:
        """Adam on windows drawn from the texts, languages evenly."""
        rng = np.random.default_rng(seed)
        by_label = [[i for i in np.flatnonzero(labels == c) if len(texts[i])] for c in range(len(self.languages))]
        usable = [c for c, x in enumerate(by_label) if x]
        m, v = ({k: np.zeros_like(x) for k, x in self.w.items()} for _ in range(2))
        loss = 0.0
        for step in range(1, steps + 1 if usable else 1):
            target = rng.choice(usable, BATCH)
            x = np.full((TRAIN_WINDOW, BATCH), 32, np.uint8)
            for j, c in enumerate(target):
                t = texts[by_label[c][rng.integers(len(by_label[c]))]]
                s = rng.integers(max(1, len(t) - TRAIN_WINDOW + 1))
                part = t[s : s + TRAIN_WINDOW]
                x[: len(part), j] = part
            loss, g = self.gradients(x, target)
            rate = LEARN_RATE * (1 - 0.9 * step / steps)
            for k in self.w:
                m[k] += 0.1 * (g[k] - m[k])
                v[k] += 0.01 * (g[k] ** 2 - v[k])
                self.w[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        return loss

    def document_probabilities(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(rows, languages): means over all bytes of each row; zeros for empty rows."""
        lengths = np.diff(offsets)
        pieces = -(-lengths // WINDOW)
        row = np.repeat(np.arange(len(lengths)), pieces)
        first = np.repeat(np.concatenate([[0], np.cumsum(pieces)[:-1]]), pieces)
        begin = offsets[row] + (np.arange(len(row)) - first) * WINDOW
        size = np.minimum(WINDOW, offsets[row + 1] - begin)
        out = np.zeros((len(lengths), len(self.languages)))
        if not len(row):
            return out
        order = np.argsort(-size, kind="stable")
        begin, size, row = begin[order], size[order], row[order]
        for s in range(0, len(row), 2048):
            b, n, own = begin[s : s + 2048], size[s : s + 2048], row[s : s + 2048]
            steps = int(n.max())
            x = LOWER[buf[np.minimum(b[None, :] + np.arange(steps)[:, None], len(buf) - 1)]]
            inside = np.arange(steps)[:, None] < n[None, :]
            x[~inside] = 32
            p = self.probabilities(x, inside.sum(axis=1))
            p *= inside[..., None]
            np.add.at(out, own, p.sum(axis=0))
        return out / np.maximum(lengths, 1)[:, None]


def learn(docs: DataFrame, per_lang: int = PER_LANG, steps: int = STEPS) -> Network | None:
    with temporary(docs.sparkSession):
        rows = sampled(docs, per_lang)
    if not rows:
        return None
    languages = sorted({r[1] for r in rows})
    net = Network(languages)
    net.train([np.frombuffer(r[2], np.uint8) for r in rows], np.array([languages.index(r[1]) for r in rows]), steps)
    return net


def sampled(docs: DataFrame, per_lang: int) -> list[tuple[int, str, bytes]]:
    """Windows to learn from, in order: doc_id, lang, bytes."""
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull()).where(~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("doc_id"), "lang")
    known = written(known.distinct())
    each = max(1, min(per_lang, per_lang * MOST_LANGS // max(1, known.select("lang").distinct().count())))
    sample = first_by_hash(known, "lang", each)
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").alias("own"), "text").where("text is not null").join(F.broadcast(sample), "doc_id")  # per_lang * MOST_LANGS rows, or one a language
    chosen = chosen.where("own = lang").groupBy("doc_id", "lang").agg(F.min("text").alias("text"))  # one text of each

    def cut(batch):
        buf, offsets = text_buffer(batch.column(2))
        ids, langs, windows = [], [], []
        for i, (a, z) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
            n = min(PER_TEXT, -(-int(z - a) // TRAIN_WINDOW))
            for k in range(n):
                s = a + (z - a - TRAIN_WINDOW) * k // max(1, n - 1) if z - a > TRAIN_WINDOW else a
                ids.append(batch.column(0)[i].as_py())
                langs.append(batch.column(1)[i].as_py())
                windows.append(LOWER[buf[s : min(z, s + TRAIN_WINDOW)]].tobytes())
        return {"doc_id": pa.array(ids, pa.int64()), "lang": pa.array(langs, pa.string()), "window": pa.array(windows, pa.binary())}

    return sorted((r["doc_id"], r["lang"], bytes(r["window"])) for r in map_batches(chosen, cut, "doc_id long, lang string, window binary").collect())  # PER_TEXT windows a row


def has_letter(text: pa.Array) -> list[bool]:
    buf, offsets = text_buffer(text)
    out = []
    for i, (a, z) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        ascii_ = any(((LOWER[part] >= 97) & (LOWER[part] <= 122)).any() for s in range(a, z, SLICE) if len(part := buf[s : min(z, s + SLICE)]))
        out.append(ascii_ or any(map(str.isalpha, text[i].as_py() or "")))
    return out


def languages(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """Per row of docs (doc_id, text; lang to learn from): doc_id, held_out, lang_pred, score.

    A text that is null or has no letter is `und` with score 0, as is every text if no row has a lang to learn.
    A very long text is read whole, window by window. Ties go to the first language in code point order. Repeated
    rows are predicted each, also without a doc_id; of texts that share a doc_id and lang the first in order is learnt from. Extra columns
    are ignored, whatever their names; an empty table gives an empty result.
    """
    net = net or learn(docs)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    @F.arrow_udf("struct<lang:string,score:double>")
    def predict(text: pa.Array) -> pa.Array:
        net, names, scores = shared.value, [], []
        buf, offsets = text_buffer(text)
        letters = has_letter(text)
        for a, z in row_slices(offsets, SLICE):
            if net is None:
                names += ["und"] * (z - a)
                scores += [0.0] * (z - a)
                continue
            p = net.document_probabilities(buf[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a])
            for i, best in enumerate(p.argmax(axis=1)):
                names.append(net.languages[best] if letters[a + i] else "und")
                scores.append(min(1.0, float(p[i, best])) if letters[a + i] else 0.0)
        tidy()
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predict("text").alias("x"))
    return out.select("doc_id", "held_out", F.col("x.lang").alias("lang_pred"), F.col("x.score").alias("score"))
