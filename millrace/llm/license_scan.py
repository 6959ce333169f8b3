"""License scans by diagonal voting, with Spark expressions only.

Every run of ``K`` words of a text is joined, by hash and then by its words, to the
places of the templates that hold the same run.  A place in the text less the place
in the template is a diagonal; runs that agree vote for theirs.  Neighbouring
diagonals of a template, at most its ``gap`` apart, are one span: a notice in which
a few words were put in or left out.  A span is verified by the share of the
template's runs in it and by its length, and then carries the template's label.

Templates are of two kinds.  Phrases and names must stand word for word, on one
diagonal (``gap`` 0, share 1).  Notices, some tens of words long, must have
``NOTICE_SHARE`` of their runs, and spans of at most twice their length count.

A row is known by its partition, id, two hashes and length of its text; rows that
agree in all of them get equal results and are counted, not told apart.  A marker
row of each keeps those without any vote.  Only markers and votes are shuffled,
once, never a text.  A text's votes meet in one task: at most a few for each word.

Words are runs of ASCII letters and digits and of everything beyond ASCII, with
A-Z lower-cased.  A null text is empty; texts without words have a row like any
other; repeated rows and ids each give a row.  An empty table gives none; other
columns play no part.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import bound

#: Words of a run.
K = 3
NOTICE_SHARE, NOTICE_GAP = 0.6, 3
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    label: str
    words: str  # lower-cased, one space between; K to K + 62 of them
    base: bool = False  # whether its places are counted
    share: float = 1.0  # of its runs that a span needs
    gap: int = 0  # between neighbouring diagonals of one span

    @property
    def runs(self) -> list[str]:
        words = self.words.split()
        return [" ".join(words[i : i + K]) for i in range(len(words) - K + 1)]


def notice(label: str, words: str) -> Template:
    return Template(label, words, share=NOTICE_SHARE, gap=NOTICE_GAP)


# Phrases whose places are counted, names of licenses, opening words of license notices.
TEMPLATES: tuple[Template, ...] = (
    Template("mit", "under the mit license", base=True),
    Template("apache-2", "apache license version 2", base=True),
    Template("cc-by-nc", "cc by nc", base=True),
    Template("gpl", "gnu general public license"),
    Template("gpl-2", "gnu general public license version 2"),
    Template("gpl-3", "gnu general public license version 3"),
    Template("lgpl", "gnu lesser general public license"),
    Template("agpl", "gnu affero general public license"),
    Template("mpl-2", "mozilla public license version 2"),
    Template("mpl-2", "mozilla public license v 2"),
    Template("bsd-2", "bsd 2 clause license"),
    Template("bsd-3", "bsd 3 clause license"),
    Template("cc-by", "creative commons attribution 4 0"),
    Template("cc-by-sa", "cc by sa"),
    Template("cc-by-sa", "creative commons attribution sharealike"),
    Template("cc-by-nc", "creative commons attribution noncommercial"),
    Template("cc0", "cc0 1 0"),
    notice("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    notice("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    notice("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    notice("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    notice("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    notice("mpl-2", "this source code form is subject to the terms of the mozilla public license"),
    notice("unlicense", "this is free and unencumbered software released into the public domain"),
)


def words_of(text: Column) -> Column:
    """The words of a text; the Kelvin sign, the one letter beyond ASCII that would become an ASCII one, is kept apart."""
    return F.regexp_extract_all(F.lower(F.replace(text, F.lit("K"), F.lit("Å"))), F.lit(WORD), F.lit(0))


def template_table(docs: DataFrame, templates: tuple[Template, ...]) -> DataFrame:
    """A row for each run of each template, and one for the marker of a text (template -1)."""
    if bad := [t.words for t in templates if not K <= len(t.words.split()) <= K + 62]:
        raise ValueError(f"templates of {K} to {K + 62} words are needed, not {bad}")
    rows = [("", -1, 0, 1, None, False, 0, 0.0, 0)]
    for number, t in enumerate(templates):
        rows += [(run, number, place, 1 << place, t.label, t.base, t.gap, t.share, len(t.runs)) for place, run in enumerate(t.runs)]
    table = docs.sparkSession.createDataFrame(rows, "t_run string, template int, place int, bit long, label string, base boolean, gap int, share double, runs int")
    return table.withColumn("t_hash", F.xxhash64("t_run"))


def scanned(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans (of the labels); one row per row of ``docs``."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), F.hash(text).alias("g"), F.length(text).alias("chars"), F.spark_partition_id().alias("part"), words_of(text).alias("words"))
    row = ["part", "doc_id", "h", "g", "chars", "n_words"]
    # the marker of the text first, then its runs
    runs = bound(F.col("words"), lambda w: F.concat(F.array(F.lit("")), F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - (K - 1), F.lit(0))), lambda x, i: F.concat_ws(" ", x, *(F.get(w, i + j) for j in range(1, K))))))
    rolled = rows.select(*row[:-1], F.size("words").alias("n_words"), F.posexplode(runs).alias("at", "run")).withColumn("hash", F.xxhash64("run"))
    table = template_table(docs, templates)
    voted = rolled.join(F.broadcast(table), (F.col("hash") == F.col("t_hash")) & (F.col("run") == F.col("t_run")))
    votes = voted.select(*row, "template", "label", "base", "gap", "share", "runs", (F.col("at") - 1).alias("at"), (F.col("at") - 1 - F.col("place")).alias("diagonal"), "bit")
    kind = ["template", "label", "base", "gap", "share", "runs"]
    # dealt by row once; all that follows groups within rows
    diagonals = votes.repartition(*row).groupBy(*row, *kind, "diagonal").agg(F.bit_or("bit").alias("bits"), F.min("at").alias("first"), F.max("at").alias("last"), F.count("*").alias("n"))
    along = Window.partitionBy(*row, *kind).orderBy("diagonal")
    opens = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(along) > F.col("gap")).cast("int"), F.lit(1))
    numbered = diagonals.withColumn("opens", opens).withColumn("span", F.sum("opens").over(along))
    spans = numbered.groupBy(*row, *kind, "span").agg(F.bit_or("bits").alias("bits"), F.min("first").alias("first"), (F.max("last") + K).alias("end"), F.max("n").alias("n"))
    found = F.bit_count("bits") / F.col("runs").cast("double")
    spans = spans.withColumn("marker", F.col("template") == -1).withColumn("found", F.when(~F.col("marker") & (F.col("end") - F.col("first") <= 2 * (F.col("runs") + K - 1)), found))
    labelled = F.col("found") >= F.col("share")
    is_base = F.col("base") & labelled
    by_row = spans.groupBy(*row).agg(
        F.max(F.when(F.col("marker"), F.col("n"))).alias("copies"),
        F.count_if(is_base).alias("n_base"),
        F.min(F.when(is_base, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(is_base, F.col("first"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(is_base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(labelled, F.col("label")))), ",").alias("labels"),
        F.coalesce(F.max("found"), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_list(F.when(labelled, F.struct("first", "end", "label")))).alias("spans"),
    )
    return by_row.select("doc_id", F.col("n_words").cast("long").alias("n_words"), "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).drop("copy")
