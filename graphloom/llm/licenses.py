"""License scans by diagonal voting (operator 4).

All rolling hashes of GRAM words of a text are joined to the positions where
templates hold the same hash; the words themselves are compared too. A match
votes for its diagonal (position in the text less position in the template);
votes are counted by diagonal, and diagonals that lie within SLACK words of each
other are merged, so that a few words put in or left out do not part a template.
A merged span is verified by the share of the template's words that its matches,
word by word, cover. Templates may be phrases, sentences or whole licenses.

Before the join a bit table of the templates' hashes (64 KB; the templates are
a constant) thins out what leaves the scan. Texts of any length are read whole;
an empty one has no words. Nulls: a null text has no words, a
null doc_id stays. Repeated rows (same doc_id and text) give one row. Ties:
places and labels are sets, so none arise; of equal scores any is the greatest.
An empty table gives an empty one. Columns other than doc_id and text, whatever
their names, are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textkit as tk

GRAM = 3
#: Words by which diagonals of one span may differ from each to the next.
SLACK = 2
#: Least share of a template's words in a span that is labelled.
COVER = 0.75
FILTER_BITS = 1 << 19

#: Words of three whole licenses, their names and years left out.
_MIT = """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software
without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons
to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or
substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of
merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability
whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"""
_BSD_2 = """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source
code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice
this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by the copyright
holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular
purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages
including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability
whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such
damage"""
_ISC = """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this
permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties
of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss
of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"""

#: Phrases that are found only whole, word by word.
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]
#: Sentences of licenses and notices, and whole licenses, found with small changes too.
TEMPLATES = [
    (_MIT, "mit"),
    (_BSD_2, "bsd"),
    (_ISC, "isc"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("released under the mit license", "mit"),
    ("licensed under the apache license version 2 0 you may not use this file except in compliance with the license", "apache-2"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("creative commons attribution 4 0 international license", "cc-by"),
    ("to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "cc0"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("under the terms of the gnu lesser general public license as published by the free software foundation", "lgpl"),
    ("under the terms of the gnu affero general public license as published by the free software foundation", "agpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
]

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _hashed_words(text: str) -> tuple[list[str], np.ndarray]:
    data = tk.LOWER[np.frombuffer(text.encode(), np.uint8)]
    starts, ends, _ = tk.word_spans(data, np.array([0, len(data)]), tk.ALNUM)
    return [bytes(data[a:b]).decode() for a, b in zip(starts, ends, strict=True)], tk.span_hashes(data, starts, ends)


def _template_rows(phrases: list[tuple[str, str]], templates: list[tuple[str, str]]) -> list[tuple[int, str, int, int, str, int, bool]]:
    """(gram, its words, template, position, label, number of words, exact)"""
    out = []
    for t, (text, label) in enumerate([*phrases, *templates]):
        words, hashes = _hashed_words(text)
        if len(words) < GRAM:
            raise ValueError(f"a template takes {GRAM} words at least: {text!r}")
        out += [(int(g), " ".join(words[p : p + GRAM]), t, p, label, len(words), t < len(phrases)) for p, g in enumerate(tk.signed(tk.gram_hashes(hashes, GRAM)))]
    return out


def _scan(bits: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, bounds in tk.text_chunks(batch.column("text")):
                data = tk.LOWER[raw]
                starts, ends, first = tk.word_spans(data, bounds, tk.ALNUM)
                grams = tk.gram_hashes(tk.span_hashes(data, starts, ends), GRAM)
                at = tk.gram_starts(first, GRAM)
                g = grams[at]
                at = at[bits[g & np.uint64(FILTER_BITS - 1)]]
                row = np.searchsorted(first, at, side="right") - 1
                words = [" ".join([bytes(data[starts[x] : ends[x]]).decode("utf-8", "replace") for x in range(i, i + GRAM)]) for i in at]
                found = pa.StructArray.from_arrays([pa.array(tk.signed(grams[at])), pa.array(words, pa.string()), pa.array(at - first[row])], names=["gram", "words", "at"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), batch.column("text_key").slice(lo, hi - lo), pa.array(np.diff(first)), tk.list_array(found, np.bincount(row, minlength=hi - lo))],
                    names=["doc_id", "text_key", "n_words", "grams"],
                )

    return run


def license_spans(spark: SparkSession, docs: DataFrame, phrases: list[tuple[str, str]] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """Merged diagonals: doc_id, text_key, n_words, and (null where a document has none) label, exact, from_word, to_word, cover."""
    rows = _template_rows(phrases, templates)
    bits = np.zeros(FILTER_BITS, bool)
    bits[np.array([r[0] for r in rows]).view(np.uint64) & np.uint64(FILTER_BITS - 1)] = True
    places = F.broadcast(spark.createDataFrame(rows, "gram bigint, words string, template int, tpos int, label string, t_words int, exact boolean"))  # a constant
    grams = tk.keyed_texts(docs).mapInArrow(tk.released(_scan(bits)), "doc_id bigint, text_key bigint, n_words bigint, grams array<struct<gram:bigint,words:string,at:bigint>>")
    grams = grams.select("doc_id", "text_key", "n_words", F.explode_outer("grams").alias("g")).select("doc_id", "text_key", "n_words", "g.gram", "g.words", "g.at")
    voted = grams.join(places, ["gram", "words"], "left").groupBy("doc_id", "text_key", "template", (F.col("at") - F.col("tpos")).alias("diagonal")).agg(
        F.max("n_words").alias("n_words"), F.first("label").alias("label"), F.first("t_words").alias("t_words"), F.first("exact").alias("exact"),
        F.collect_set("tpos").alias("votes"), F.min("at").alias("from_word"), (F.max("at") + GRAM).alias("to_word"),
    )
    of = Window.partitionBy("doc_id", "text_key", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("exact"), F.lit(True)) | (F.col("diagonal") - F.lag("diagonal").over(of) > SLACK) | F.lag("diagonal").over(of).isNull()
    spans = voted.withColumn("span", F.sum(F.when(apart, 1).otherwise(0)).over(of)).groupBy("doc_id", "text_key", "template", "span").agg(
        F.max("n_words").alias("n_words"), F.first("label").alias("label"), F.first("t_words").alias("t_words"), F.first("exact").alias("exact"),
        F.flatten(F.collect_list("votes")).alias("votes"), F.min("from_word").alias("from_word"), F.max("to_word").alias("to_word"),
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("votes", lambda v: F.sequence(v, v + GRAM - 1)))))
    return spans.select("doc_id", "text_key", "n_words", "label", "exact", "from_word", "to_word", F.when(F.col("t_words").isNotNull(), covered / F.col("t_words")).alias("cover"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = license_spans(spark, tk.table(spark, sf_dir, "documents"))
    base = F.col("exact") & (F.col("cover") == 1)
    near = ~F.col("exact") & (F.col("cover") >= COVER)
    listed = lambda what: F.concat_ws(",", F.array_sort(F.collect_set(F.when(what, F.col("label")))))
    return spans.groupBy("doc_id", "text_key").agg(
        F.max("n_words").alias("n_words"), F.count(F.when(base, 1)).alias("n_base"), F.min(F.when(base, F.col("from_word"))).alias("first_word"), F.max(F.when(base, F.col("from_word"))).alias("last_word"),
        listed(base).alias("base_labels"), listed(base | near).alias("labels"), F.coalesce(F.max(F.when(base | near, F.col("cover"))), F.lit(0.0)).alias("score"),
    ).drop("text_key")


def brute_base(text: str | None) -> tuple[int, int, int | None, int | None, str]:
    """n_words, n_base, first_word, last_word, base_labels by plain search: for tests."""
    words = _WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
    hits = [(p, label) for phrase, label in PHRASES for p in range(len(words)) if words[p : p + len(phrase.split())] == phrase.split()]
    at = [p for p, _ in hits]
    return len(words), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))
