"""License scans: MinHash bands over overlapping text windows retrieve templates, exact containment verifies.

Words are lower-cased runs of letters and digits of ASCII, shingles five words. Of a text only the shingles that stand in some template count for its
windows: each shingle is looked up once, so windows are made where there are such shingles, not all over the text.
Up to 64 words, a template belongs to the least scale that holds it; windows are of twice as many words and overlap by half, so that every
occurrence lies whole in a window. Longer texts of licenses are cut into windows of PIECE words, STEP apart, and documents into
windows of PIECE words too, APART: any excerpt of about PIECE words fills most of a window, which lies within STEP / 2 words of one
of the license.

Signatures are minima of one hash function. For texts they are those of BANDS ranges of it, ROWS to a band: two windows alike by j, by
Jaccard similarity, meet in some band with a probability of 1 - (1 - j ** ROWS) ** BANDS, that is 0.99 for j = 0.5. Short
templates share too little with a window for bands of two: there, each of the window's LEAST minima is a band of one row, and a window with
four fifths of the template is missed with a probability below (1 - j) ** LEAST; it is 0 for lines of up to eight words, as all their
windows' shingles are among the minima.

A match needs CONTAINED percent of a short template's shingles in one window, or, of a text, shingles for TEXT_CONTAINED percent of a
window's (of the text's, if these are fewer). Only DataFrame functions; templates are data, so that the plan is the same for any number of them.
"""

from __future__ import annotations

import pathlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE = 5
SCALES = (8, 16, 32, 64)
LEAST = 24
PIECE, STEP, APART = 32, 4, 8
BANDS, ROWS = 16, 2
FEWEST = 24  # shingles of a window that may lie in a text
CONTAINED, TEXT_CONTAINED = 80, 60
CUT, OVERLAP = 1 << 20, 1 << 13
FOLDER = pathlib.Path(__file__).parent / "licenses"

#: Lines and notices that say under which license a work is.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "mit": "Released under the MIT License.",
    "mit-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "bsd-3-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
}


def license_texts(folder: str | pathlib.Path = FOLDER) -> dict[str, str]:
    """The texts of licenses that come with the package, or those of another folder of the driver, by the names of their files."""
    return {p.stem if p.suffix == ".txt" else p.name: p.read_text(errors="replace") for p in sorted(pathlib.Path(folder).iterdir()) if p.is_file()}


def with_shingles(df: DataFrame, text: Column) -> DataFrame:
    """df with _h, the hashes of its words, and _s, those of its shingles in order.

    Both are generated, of arrays of one element: else the planner may put them in place of their names, and
    lambdas would compute them again for each element.
    """
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), "")
    df = df.withColumn("_h", F.explode(F.array(F.transform(words, lambda w: F.xxhash64(w)))))
    rolled = F.transform(F.slice("_h", F.lit(1), F.greatest(F.size("_h") - (SHINGLE - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get("_h", i + k) for k in range(1, SHINGLE)]))
    return df.withColumn("_s", F.explode(F.array(rolled)))


def windows_of(words: int, step: int, scale: int) -> Column:
    """Windows of so many words, so many apart: scale and their distinct shingles in order."""
    begins = F.sequence(F.lit(0), F.greatest(F.size("_s") - 1, F.lit(0)), F.lit(step))
    return F.transform(begins, lambda s: F.struct(F.lit(scale).alias("scale"), F.sort_array(F.array_distinct(F.slice("_s", s + 1, F.lit(words - SHINGLE + 1)))).alias("window")))


def with_keys(df: DataFrame) -> DataFrame:
    """A row for each band of each window: the columns of df with scale, window and the band's key."""
    df = df.select("*", "w.scale", "w.window").drop("w")
    w = F.col("window")
    bits = 64 - (BANDS.bit_length() - 1)
    band = lambda x: F.shiftright(x, bits)
    begins = lambda x, i: (i == 0) | (band(F.get(w, i - 1)) != band(x))
    pairs = F.transform(w, lambda x, i: F.when(begins(x, i) & (band(F.get(w, i + ROWS - 1)) == band(x)), F.xxhash64(x, *[F.get(w, i + k) for k in range(1, ROWS)])))
    keys = F.when(F.col("scale") == PIECE + 1, F.filter(pairs, lambda x: x.isNotNull())).otherwise(F.slice("window", F.lit(1), F.lit(LEAST)))
    return df.withColumn("key", F.explode(keys))


def templates_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """name, words, shingles of each template; as long as templates."""
    args = {f"{c}{i}": x for i, r in enumerate(sorted(templates.items())) for c, x in zip("nt", r, strict=True)}
    rows = spark.sql(f"SELECT * FROM VALUES {', '.join(f'(:n{i}, :t{i})' for i in range(len(templates)))} AS t(name, text)", args=args)
    t = with_shingles(rows, F.col("text"))
    return t.select("name", F.size("_h").alias("words"), "_s", F.array_distinct("_s").alias("shingles")).where(F.size("shingles") > 0)


def template_keys(table: DataFrame) -> DataFrame:
    """scale, key, name: a row for each band of each template's windows."""
    whole = F.when(F.col("words") <= SCALES[0], SCALES[0])
    for scale in SCALES[1:]:
        whole = whole.when(F.col("words") <= scale, scale)
    short = table.withColumn("scale", whole).where("scale is not null").select("name", F.struct("scale", F.sort_array("shingles").alias("window")).alias("w"))
    long_ = table.where(F.col("words") > SCALES[-1]).select("name", F.explode(windows_of(PIECE, STEP, PIECE + 1)).alias("w"))
    return with_keys(short.union(long_)).select("scale", "key", "name").distinct()


def segments(text: Column) -> Column:
    """A text, or one of more than CUT characters in pieces that overlap."""
    at = F.sequence(F.lit(0), F.length(text) - 1, F.lit(CUT))
    return F.when(F.length(text) > CUT, F.transform(at, lambda i: F.substring(text, i + 1, F.lit(CUT + OVERLAP)))).otherwise(F.array(text))


def hits_of(docs: DataFrame, table: DataFrame) -> DataFrame:
    """doc_id, row, segment, n (its shingles), at, shingle: where a shingle of a template stands in a segment of a row."""
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.posexplode(segments(F.coalesce(F.col("text"), F.lit("")))).alias("segment", "text"))
    held = with_shingles(held, F.col("text")).select("doc_id", "row", "segment", F.size("_s").alias("n"), F.posexplode("_s").alias("at", "shingle"))
    known = table.select(F.explode("shingles").alias("shingle")).distinct()
    return held.join(F.broadcast(known), "shingle")  # the shingles of the templates


def hit_windows(hits: DataFrame) -> DataFrame:
    """doc_id, row, segment, scale, n (shingles in it), window: of each window that has hits, these, once each and in order."""
    at = F.col("at")

    def of(words: int, step: int, scale: int) -> Column:
        span = words - SHINGLE + 1
        begins = F.sequence(F.greatest(F.floor((at - span) / step) + 1, F.lit(0)), F.floor(at / step))
        return F.transform(begins, lambda k: F.struct(F.lit(scale).alias("scale"), (k * step).alias("begin"), F.least(F.lit(span).cast("long"), F.col("n") - k * step).alias("n")))

    all_ = F.concat(*[of(2 * scale, scale, scale) for scale in SCALES], of(PIECE, APART, PIECE + 1))
    own = hits.select("doc_id", "row", "segment", "shingle", F.explode(all_).alias("w"))
    sets = own.groupBy("doc_id", "row", "segment", "w.scale", "w.begin", "w.n").agg(F.sort_array(F.collect_set("shingle")).alias("window"))  # of one window
    text = F.col("scale") == PIECE + 1
    return sets.where(~text | ((F.col("n") >= FEWEST) & (F.size("window") >= ROWS)))


def license_matches(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """doc_id, license, contained (the share in the best window) of each match.

    Nulls, empty and very long texts, ties, repeated rows and clashing names as in license_scan.
    """
    if not templates:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit("").alias("license"), F.lit(0.0).alias("contained")).limit(0)
    table = templates_table(docs.sparkSession, templates)
    windows = hit_windows(hits_of(docs, table))
    signed = with_keys(windows.select("doc_id", "n", F.struct("scale", "window").alias("w")))
    met = signed.join(F.broadcast(template_keys(table)), ["scale", "key"])  # LEAST or BANDS rows for each window of a template
    met = met.select("doc_id", "scale", "n", "window", "name").join(F.broadcast(table.select("name", "shingles")), "name")  # a row a template
    both = F.size(F.array_intersect("shingles", "window"))
    text = F.col("scale") == PIECE + 1
    met = met.withColumn("share", both / F.when(text, F.least(F.col("n"), F.size("shingles").cast("long"))).otherwise(F.size("shingles").cast("long")))
    enough = F.when(text, F.col("share") * 100 >= TEXT_CONTAINED).otherwise(F.col("share") * 100 >= CONTAINED)
    return met.where(enough).groupBy("doc_id", F.col("name").alias("license")).agg(F.max("share").alias("contained"))


def license_scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_licenses, licenses (names in order, comma-joined).

    A null or empty text, or one of fewer than five words, has none; a very long one is read whole, in pieces that overlap. Rows that
    share a doc_id are one document; a null doc_id has none. A share of just the threshold matches, and of windows that are
    tied any does. Extra columns are ignored, whatever their names; an empty table gives an empty result.
    """
    found = license_matches(docs, templates).groupBy("doc_id").agg(F.array_sort(F.collect_set("license")).alias("names"))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(found, "doc_id", "left")
    names = F.coalesce("names", F.array().cast("array<string>"))
    return out.select("doc_id", F.size(names).cast("long").alias("n_licenses"), F.array_join(names, ",").alias("licenses"))
