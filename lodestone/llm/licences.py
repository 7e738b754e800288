"""Licence scan by diagonal voting.

Every document gives the hashes of all its rolling k-word strings; Spark joins them to the places of the same
strings in the licence templates (a small table of fixed size, broadcast). A match votes for its diagonal,
document place minus template place. Votes are added up by diagonal, neighbouring diagonals (a few words put in
or left out) are merged, and a merged span is verified: the template words it covers, their share of the
template and the length of the span against the template's.

Besides, the places of four base phrases are counted as they stand.

Cases: a null text is empty and has no words; repeated rows, rows that share an id and rows without an id each get their
row, by their own text; very long texts are read whole; templates that match equally well all give their label; an empty
table gives no rows; columns other than the named ones are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import Words, chunks, mix

#: Base phrases and their labels, as the contract fixes them.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Notices that projects and pages commonly carry (fixed values), by label.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit", "released under the MIT license"),
    ("apache", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache", "licensed under the Apache license version 2.0"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "this work is licensed under the GNU General Public License version 3"),
    ("lgpl", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "licensed under CC BY NC 4.0"),
    ("cc-by-nc", "licensed under a Creative Commons Attribution NonCommercial 4.0 International License"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution ShareAlike 4.0 International License"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("mit", "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("boost", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the Software"),
    ("isc", "The software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness."),
    ("cc0", "has waived all copyright and related or neighboring rights to this work"),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License"),
    ("public-domain", "This is free and unencumbered software released into the public domain"),
    ("all-rights-reserved", "copyright all rights reserved"),
]

#: Words of a rolling string, the least share of a template that a span covers, words by which neighbouring diagonals may differ.
K, COVER, DRIFT = 4, 0.8, 3


def _grams(w: Words, k: int) -> np.ndarray:
    """The hash of the k words from each word on; 0 stands where the document ends before."""
    n = len(w.hash)
    out = np.zeros(n, np.uint64)
    if n >= k:
        h = w.hash[: n - k + 1].copy()
        for j in range(1, k):
            h = mix(h * np.uint64(31) + w.hash[j : n - k + 1 + j])
        out[: n - k + 1] = np.where(w.doc[: n - k + 1] == w.doc[k - 1 :], h | np.uint64(1), 0)
    return out


def _scan(grams: bool):
    phrases = [(Words(pa.array([p])).hash, label) for p, label in PHRASES.items()]

    def run(batches):
        for part in chunks(batches):
            w = Words(part.column("text"))
            if grams:
                out = pa.ListArray.from_arrays(pa.array(w.first.astype(np.int32)), pa.array(_grams(w, K).view(np.int64)))
                yield pa.record_batch([part.column("id"), part.column("key"), out], ["id", "key", "grams"])
                continue
            n = len(w.hash)
            starts, which = [], []
            for j, (p, _) in enumerate(phrases):
                if n < len(p):
                    continue
                at = np.flatnonzero(w.hash[: n - len(p) + 1] == p[0])
                for k in range(1, len(p)):
                    at = at[w.hash[at + k] == p[k]]
                at = at[w.doc[at] == w.doc[at + len(p) - 1]]
                starts.append(at)
                which.append(np.full(len(at), j))
            at, which = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, which))
            order = np.argsort(at, kind="stable")
            at, which = at[order], which[order]
            edge = np.searchsorted(w.doc[at], np.arange(len(w.n) + 1))
            count = np.diff(edge)
            first, last, labels = [], [], []
            for d, c in enumerate(count):
                own = slice(edge[d], edge[d + 1])
                first.append(int(at[own][0] - w.first[d]) if c else None)
                last.append(int(at[own][-1] - w.first[d]) if c else None)
                labels.append(sorted({phrases[j][1] for j in which[own]}))
            yield pa.record_batch([part.column("id"), part.column("key"), pa.array(w.n), pa.array(count), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(labels, pa.list_(pa.string()))], ["id", "key", "n_words", "n_base", "first_word", "last_word", "base"])

    return run


def template_places(spark, templates=TEMPLATES) -> DataFrame:
    """gram, template, label, place, size: the rolling strings of the templates."""
    rows = []
    for t, (label, text) in enumerate(templates):
        w = Words(pa.array([text]))
        rows += [(int(g), t, label, i, len(w.hash)) for i, g in enumerate(_grams(w, K).view(np.int64)) if g]
    return spark.createDataFrame(rows, "gram long, template int, label string, place int, size int")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("key"), text.alias("text"))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES) -> DataFrame:
    """Verified spans: id, key (a hash of the text), template, label, start, end (words), cover (share of the template's words); once for equal rows."""
    rows = _rows(docs, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()
    grams = rows.mapInArrow(_scan(True), f"id {kind}, key long, grams array<long>").select("id", "key", F.posexplode("grams").alias("at", "gram"))
    votes = grams.join(F.broadcast(template_places(docs.sparkSession, templates)), "gram")
    lines = votes.groupBy("id", "key", "template", "label", "size", (F.col("at") - F.col("place")).alias("diagonal")).agg(F.collect_set("place").alias("places"))
    along = Window.partitionBy("id", "key", "template").orderBy("diagonal")
    merged = (
        lines.withColumn("new", (F.col("diagonal") - F.lag("diagonal").over(along) > DRIFT).cast("int"))
        .withColumn("run", F.sum(F.coalesce("new", F.lit(0))).over(along))
        .groupBy("id", "key", "template", "label", "size", "run")
        .agg(
            F.min(F.col("diagonal") + F.array_min("places")).alias("start"),
            (F.max(F.col("diagonal") + F.array_max("places")) + K).alias("end"),
            F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"),
        )
    )
    words = F.size(F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + K - 1)))))
    return (
        merged.withColumn("cover", F.least(words / F.col("size"), F.lit(1.0)))
        .where((F.col("cover") >= COVER) & (F.col("end") - F.col("start") <= F.col("size") * 1.5 + DRIFT))
        .select("id", "key", "template", "label", "start", "end", "cover")
    )


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES) -> DataFrame:
    """One row for each document: base phrases, labels of both kinds and a score (the best span's share; a base phrase counts 0.5)."""
    rows = _rows(docs, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()
    base = rows.mapInArrow(_scan(False), f"id {kind}, key long, n_words long, n_base long, first_word long, last_word long, base array<string>")
    found = spans(docs, id_col, text_col, templates).groupBy(F.col("id").alias("_id"), F.col("key").alias("_key")).agg(F.collect_set("label").alias("more"), F.max("cover").alias("cover"), F.count("*").alias("n_spans"))
    none = F.array().cast("array<string>")
    return base.join(found, (F.col("key") == F.col("_key")) & F.col("id").eqNullSafe(F.col("_id")), "left").select(
        F.col("id").alias(id_col),
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("more", none))), ",").alias("labels"),
        F.greatest(F.coalesce("cover", F.lit(0.0)), F.when(F.col("n_base") > 0, 0.5).otherwise(0.0)).alias("score"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
    )
