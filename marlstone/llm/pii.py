"""Personal data: patterns find what to protect; corpus statistics find the terms that give it away.

Terms are runs of letters and digits near a base span. Over all documents, a term's pointwise mutual information with a
kind, or with any of them, relative to the information content of that kind, tells how much seeing the term discloses: ALPHA or more
means that the kind stands near the term in most documents that hold the term. Such terms, if near the kind in SUPPORT documents or more, are spans of
kind "term" wherever they stand in any document. How common a word is says nothing in a small corpus, so function words,
which are known, are never terms. Sanitising generalises base spans and removes terms.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, bit_filter, free_names, map_batches, mix64, row_slices, set_bits, temporary, text_buffer, word_hashes, word_slices, written

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
ANY = len(KINDS)
NEAR_WORDS = 4
ALPHA = 0.75
SUPPORT = 5
SLICE = 1 << 17

#: Function words of the languages of the texts (English, German, French, Spanish), which give nothing away.
FUNCTION_WORDS = """
a about after all also am an and are as at be because been but by can could did do does for from had has have he her him his how i if in
is it its me my no not now of on or our out she so some than that the their them then there they this to up us was we were what when
which who will with would you your
aber als auf aus bei das dass dem den der des die ein eine einem einen einer es hat ich ihr im ist mit nach nicht oder sich sie sind und
von war wie wir zu zum zur
au aux avec ce ces cette dans de du elle est et il ils je la le les leur mais ne nous ou par pas pour qui sa se ses son sont sur un une
vous
al como con del el en es esta este las lo los para pero por que se su sus una y
""".split()

#: ASCII signs separate terms.
TABLE = LOWER.copy()
TABLE[[b for b in range(128) if not chr(b).isalnum()]] = 32


def _term_hashes(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    return word_hashes(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]), TABLE)[0]


_FUNCTION = np.sort(_term_hashes(FUNCTION_WORDS))

_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(2 * d - 9 * (d > 4) for d in map(int, digits[-2::-2]))
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start; each pattern leftmost, not overlapping itself."""
    out, done = [], 0
    if "@" in text:
        for m in _AT.finditer(text):  # what comes before an @ is as long as it can be, from the last match on
            start = at = m.start()
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                out.append((0, start, m.end()))
                done = m.end()
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x[-9:]) <= 255 for x in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def joined(spans, names=KINDS) -> str:
    return ",".join(f"{names[k]}:{a}:{b}" for k, a, b in spans)


def code_points(buf: np.ndarray, places: np.ndarray, starts_at: int, points_at: int) -> np.ndarray:
    """Code points before ascending places in buf, counted on from a place of which they are known."""
    if not len(places):
        return places
    part = buf[starts_at : places[-1]]
    heads = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
    return points_at + heads[places - starts_at]


def terms_of(buf: np.ndarray):
    """Hash, start and end in code points of the terms of one text, slice by slice."""
    at, points = 0, 0
    for _, h, starts, ends in word_slices(buf, np.array([0, len(buf)]), TABLE):
        both = code_points(buf, np.stack([starts, ends], axis=1).reshape(-1), at, points)
        at, points = int(ends[-1]), int(both[-1])
        yield h, both[::2], both[1::2]


def known_words(h: np.ndarray) -> np.ndarray:
    return _FUNCTION[np.minimum(np.searchsorted(_FUNCTION, h), len(_FUNCTION) - 1)] == h


def touching(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int, int]]) -> np.ndarray:
    out = np.zeros(len(starts), bool)
    for _, a, b in spans:
        out[np.searchsorted(ends, a, side="right") : np.searchsorted(starts, b)] = True
    return out


def near_terms(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(kind, hash) of the terms within NEAR_WORDS of a span that touch none, without function words; each for its kind and for ANY."""
    buf = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    slices = list(terms_of(buf))
    if not slices:
        return []
    h, starts, ends = (np.concatenate(x) for x in zip(*slices, strict=True))
    free = ~touching(starts, ends, spans) & ~known_words(h)
    out = set()
    for kind, a, b in spans:
        i, j = int(np.searchsorted(ends, a, side="right")), int(np.searchsorted(starts, b))
        for w in (*range(max(0, i - NEAR_WORDS), i), *range(j, min(len(h), j + NEAR_WORDS))):
            if free[w]:
                out |= {(k, int(h[w].view(np.int64))) for k in (kind, ANY)}
    return sorted(out)


def each_text(text: pa.Array):
    """The texts one by one, so that few are held as strings."""
    for x in text:
        yield x.as_py() or ""


def near(docs: DataFrame) -> DataFrame:
    """A row for each kind and each term near it in each document; term null for the kind itself, kind null for the document."""

    def find(batch):
        kinds, terms, n = [], [], 0
        for text in each_text(batch.column(0)):
            n += 1
            if spans := base_spans(text):
                found = near_terms(text, spans)
                own = sorted({k for k, _, _ in spans} | {ANY})
                kinds += own + [k for k, _ in found]
                terms += [None] * len(own) + [t for _, t in found]
        return {"kind": pa.array([None, *kinds], pa.int32()), "term": pa.array([None, *terms], pa.int64()), "n": pa.array([n] + [1] * len(kinds), pa.int64())}

    return map_batches(docs.select("text"), find, "kind int, term long, n long")


def disclosing(docs: DataFrame, alpha: float, support: int) -> DataFrame:
    """term of the terms that give a kind away, each once."""
    counts = written(near(docs)).groupBy("kind", "term").agg(F.sum("n").alias("near"))
    totals = {r["kind"]: r["near"] for r in counts.where("term is null").collect()}  # a row a kind, and one
    documents = float(totals.get(None, 0))
    terms = counts.where(F.col("term").isNotNull() & (F.col("near") >= support))
    shared = docs.sparkSession.sparkContext.broadcast(bit_filter(terms.select(F.col("term").alias("key"))))

    def count(batch):
        """Documents of the batch that hold each term that the filter lets through."""
        found = [np.zeros(0, np.uint64)]
        buf, offsets = text_buffer(batch.column(0))
        for a, z in row_slices(offsets, SLICE):
            terms, rows = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            for row, h, _, _ in word_slices(buf[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a], TABLE, SLICE):
                keep = set_bits(h.view(np.int64), shared.value)
                terms, rows = np.concatenate([terms, h[keep]]), np.concatenate([rows, row[keep]])
                with np.errstate(over="ignore"):
                    _, once = np.unique(mix64(terms + mix64(rows.astype(np.uint64) + np.uint64(1))), return_index=True)  # of each row
                terms, rows = terms[once], rows[once]
            found.append(terms)
        u, n = np.unique(np.concatenate(found), return_counts=True)
        return {"term": pa.array(u.view(np.int64)), "n": pa.array(n.astype(np.int64))}

    held = map_batches(docs.select("text"), count, "term long, n long").groupBy("term").agg(F.sum("n").alias("total"))
    of_kind = F.lit(None).cast("double")
    for kind, n in totals.items():
        if kind is not None:
            of_kind = F.when(F.col("kind") == kind, F.lit(float(n))).otherwise(of_kind)
    scored = terms.join(held, "term").withColumn("of_kind", of_kind)
    information = F.log2(F.lit(documents) / F.col("of_kind"))
    pmi = F.log2(F.col("near") * F.lit(documents) / (F.col("total") * F.col("of_kind")))
    return scored.where(pmi >= alpha * information).select("term").distinct()


_PLACES = pa.list_(pa.struct([("term", pa.int64()), ("start", pa.int32()), ("end", pa.int32())]))


def places(buf: np.ndarray, offsets: np.ndarray, flags: np.ndarray, spans: list | None = None) -> list[list[dict]]:
    """By row: where terms that the filter lets through stand, but for those that touch a base span (spans by row)."""
    out = [[] for _ in offsets[1:]]
    for a, z in row_slices(offsets, SLICE):
        part, own = buf[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a]
        rows, hashes, begins, ends = ([np.zeros(0, t)] for t in (np.int64, np.uint64, np.int64, np.int64))
        for found in word_slices(part, own, TABLE, SLICE):
            keep = set_bits(found[1].view(np.int64), flags)
            for held, x in zip((rows, hashes, begins, ends), found, strict=True):
                held.append(x[keep])
        row, h, begin, end = map(np.concatenate, (rows, hashes, begins, ends))
        cut = np.searchsorted(row, np.arange(z - a + 1))
        for i in np.unique(row).tolist():  # few texts have any
            at = slice(cut[i], cut[i + 1])
            both = code_points(part, np.stack([begin[at], end[at]], axis=1).reshape(-1), int(own[i]), 0)
            first, last = both[::2], both[1::2]
            free = ~touching(first, last, spans[a + i] if spans else [])
            out[a + i] = [{"term": t, "start": s, "end": e} for t, s, e in zip(h[at][free].view(np.int64).tolist(), first[free].tolist(), last[free].tolist(), strict=True)]
    return out


def with_terms(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """rows (row, hits) with terms, the places in hits of the given terms, in order; null where there are none."""
    hits = rows.where(F.size("hits") > 0).select("row", F.explode("hits").alias("x")).select("row", "x.*").join(terms, "term")
    hits = hits.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("terms"))  # of one text
    none = rows.where("size(hits) <= 0 or hits is null").withColumn("terms", F.lit(None).cast("array<struct<start:int,end:int>>"))
    return none.unionByName(rows.where(F.size("hits") > 0).join(hits, "row", "left")).drop("hits")


def personal_spans(docs: DataFrame, alpha: float = ALPHA, support: int = SUPPORT) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_email, n_ip, n_card, n_phone, base, terms (array of start, end).

    A null text is empty and has no spans; a very long one is read whole. Repeated rows are judged each for itself and all count as
    documents in the corpus statistics. A term that gives a kind away is a span at each of its places in any text, unless the
    place touches a base span. A term of just the threshold is one. Extra columns are ignored, whatever their names; an
    empty table gives an empty result.
    """
    with temporary(docs.sparkSession) as keep:
        terms = keep(written(disclosing(docs, alpha, support)))
    shared = docs.sparkSession.sparkContext.broadcast(bit_filter(terms.select(F.col("term").alias("key"))))

    def find(batch):
        for s in range(0, batch.num_rows, 1024):
            part = batch.slice(s, 1024)
            spans = [base_spans(text) for text in each_text(part.column(1))]
            counts = [[sum(x[0] == k for x in own) for own in spans] for k in range(len(KINDS))]
            base = [joined(own) for own in spans]
            hits = places(*text_buffer(part.column(1)), shared.value, spans)
            yield {"doc_id": part.column(0)} | {f"n_{k}": pa.array(c, pa.int64()) for k, c in zip(KINDS, counts, strict=True)} | {"base": pa.array(base, pa.string()), "hits": pa.array(hits, _PLACES)}

    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base string, hits array<struct<term:long,start:int,end:int>>"
    rows = written(map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), find, schema).withColumn("row", F.monotonically_increasing_id()))
    return with_terms(rows, terms).drop("row")


def span_digests(docs: DataFrame) -> DataFrame:
    out = personal_spans(docs)
    terms = F.array_join(F.transform(F.coalesce("terms", F.array().cast("array<struct<start:int,end:int>>")), lambda x: F.concat(F.lit(f"{TERM}:"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string"))), ",")
    both = F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), F.when(terms != "", terms))
    return out.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(F.col("base"), 256).alias("base_sha256"), both.alias("spans"))


def sanitised_text(text: str, spans: list[tuple[str, int, int]]) -> str:
    """text with base spans generalised to [kind] and terms removed; of a span that overlaps an earlier one, the part after it."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda x: (x[1], -x[2])):
        if b > at:
            out += [text[at:a], "" if kind == TERM else f"[{kind}]"]
            at = b
    return "".join(out) + text[at:]


def sanitised(docs: DataFrame, alpha: float = ALPHA, support: int = SUPPORT) -> DataFrame:
    """docs with the text of each row sanitised: base spans generalised, and every place of a term that gives a kind away removed.

    A null text stays null. Rows without a doc_id and repeated rows are treated like others, each for itself; other columns are kept,
    whatever their names. Long texts, ties and empty tables as in personal_spans.
    """
    row, own, found = free_names(docs, "row", "own_row", "found")
    with temporary(docs.sparkSession) as keep:
        rows = keep(written(docs.withColumn(row, F.monotonically_increasing_id())))
        terms = keep(written(disclosing(rows, alpha, support)))
    shared = docs.sparkSession.sparkContext.broadcast(bit_filter(terms.select(F.col("term").alias("key"))))

    def hits(batch):
        at = places(*text_buffer(batch.column(1)), shared.value)
        keep = [i for i, x in enumerate(at) if x]
        return {"row": batch.column(0).take(pa.array(keep, pa.int64())), "hits": pa.array([at[i] for i in keep], _PLACES)}

    met = written(map_batches(rows.select(F.col(row).alias("row"), "text"), hits, "row long, hits array<struct<term:long,start:int,end:int>>"))
    met = written(with_terms(met, terms).where("terms is not null").select(F.col("row").alias(own), F.col("terms").alias(found)))

    def one(text, places):
        if text is None:
            return text
        return sanitised_text(text, [(KINDS[k], a, b) for k, a, b in base_spans(text)] + [(TERM, x["start"], x["end"]) for x in places or []])

    @F.arrow_udf("string")
    def clean(text: pa.Array, places: pa.Array) -> pa.Array:
        return pa.array((one(t.as_py(), p.as_py()) for t, p in zip(text, places, strict=True)), pa.string())

    return rows.join(met, F.col(row) == F.col(own), "left").withColumn("text", clean("text", F.col(found))).select(docs.columns)


def base_sha256(spans) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()
