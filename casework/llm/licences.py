"""Licence scan: sparse TF-IDF cosine of headers and licence files to templates, inherited from the nearest ancestor directory.

A file's passages are its sentences with a licence cue; of a licence file (LICENSE, LICENCE, COPYING, NOTICE, any extension) its whole text is a passage too. A
term's weight is its count times ln((1 + N) / (1 + df)) + 1, df over all N texts. A passage's length is that of all its terms, so
words that no template has lower its cosine. A passage has the licence of the template with the highest cosine, `LEAST` or more; a file has
that of its best passage. Ties go to the licence, then to the passage, first in order.

Document frequencies are a distributed count of every term of every text. Passages take them by a broadcast of the `COMMON` terms of most texts
and a join for the rest, where no term has more than one in `COMMON` of all occurrences.

A directory has the licence of the licence file in it (of several, of the first path in order). Files without their own take
the licence of the nearest directory above that has one: distinct directories are exploded to their ancestors and joined by path, so
the join grows with directories, not with files.

Defined cases: null and empty texts have no passage, a null path is a file without directory, files of equal path are each a file,
an empty table gives an empty result.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casework.llm.common import stored, text_of

LEAST, COMMON = 0.55, 10_000
#: Licence and a sentence that states it. Fixed values.
TEMPLATES = (
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "This work is dedicated to the public domain under the Creative Commons CC0 1.0 Universal license."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3."),
    ("ISC", "Licensed under the ISC License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
)
CUE = r"(?i)licen[cs]|copyright|permission|redistribut|spdx"
TERM = r"[^\p{L}\p{N}.]+"
LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying|notice)[^/]*$"


def _terms(text: Column) -> Column:
    """Lower-case terms; a dot stays inside version numbers only."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), r"\.(?![0-9])", " "), TERM, " ")
    return F.filter(F.split(plain, " "), lambda t: t != "")


def template_terms(spark: SparkSession) -> DataFrame:
    """template, licence, term, tf; its size is fixed by `TEMPLATES`."""
    rows = spark.createDataFrame([(i, *t) for i, t in enumerate(TEMPLATES)], "template int, licence string, text string")
    return rows.select("template", "licence", F.explode(_terms(F.col("text"))).alias("term")).groupBy("template", "licence", "term").agg(
        F.count("*").alias("tf")
    )


def term_counts(files: DataFrame, text: str) -> DataFrame:
    """term, df: in how many texts each term of the files stands."""
    terms = files.select(F.explode(F.array_distinct(_terms(text_of(text)))).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("df"))


def passages(files: DataFrame, key: str, path: str, text: str) -> DataFrame:
    """id, path, passage, body: sentences with a cue, and a licence file's whole text (passage -1). Sentences end at a line end or a stop
    followed by white space."""
    body = text_of(text)
    rows = files.select(F.col(key).cast("long").alias("id"), F.col(path).cast("string").alias("path"), body.alias("text"))
    hit = rows.filter(F.col("text").rlike(CUE))
    each = hit.select("id", "path", F.posexplode(F.split("text", r"\n|(?<=[.!?;])\s")).alias("passage", "body")).filter(F.col("body").rlike(CUE))
    whole = hit.filter(F.col("path").rlike(LICENCE_FILE)).select("id", "path", F.lit(-1).alias("passage"), F.col("text").alias("body"))
    return each.union(whole)


def own_licences(files: DataFrame, key: str = "doc_id", path: str = "path", text: str = "text", least: float = LEAST) -> DataFrame:
    """id, path, licence, cosine: the files that state a licence themselves."""
    n = files.count()
    counts = stored(term_counts(files, text), "terms")
    idf = (F.log((n + 1) / (1 + F.coalesce("df", F.lit(0)))) + 1).alias("idf")
    weighted = template_terms(files.sparkSession).join(counts, "term", "left").withColumn("w", F.col("tf") * idf)
    norms = weighted.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    share = F.struct("template", "licence", (F.col("w") / F.col("norm")).alias("share"))
    unit = stored(weighted.join(norms, "template").groupBy("term").agg(F.collect_list(share).alias("shares")), "unit")
    row = ["id", "path", "passage", "d"]
    tf = passages(files, key, path, text).select("id", "path", "passage", F.xxhash64("body").alias("d"), F.explode(_terms(F.col("body"))).alias("term"))
    # Repeated rows multiply all weights of a passage alike, which no cosine notices.
    tf = stored(tf.groupBy(*row, "term").agg(F.count("*").alias("tf")), "passages")
    common = stored(counts.orderBy(F.col("df").desc(), "term").limit(COMMON), "common")
    rare = tf.join(F.broadcast(common), "term", "left_anti").join(counts, "term")
    known = tf.join(F.broadcast(common), "term").unionByName(rare).withColumn("w", F.col("tf") * idf)
    with_shares = known.join(F.broadcast(unit), "term", "left")
    length = F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length")
    held = F.collect_list(F.when(F.col("shares").isNotNull(), F.struct("w", "shares"))).alias("held")
    vectors = with_shares.groupBy(*row).agg(length, held)
    each = vectors.select(*row, "length", F.explode("held").alias("h")).select(*row, "length", F.col("h.w").alias("w"), F.inline("h.shares"))
    cosines = each.groupBy(*row, "template", "licence").agg(F.round(F.sum(F.col("w") * F.col("share")) / F.first("length"), 9).alias("cosine"))
    good = cosines.filter(F.col("cosine") >= least)
    best = good.groupBy("id", "path").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "licence", "passage")).alias("best"))
    return best.select("id", "path", F.col("best.licence").alias("licence"), (-F.col("best.c")).alias("cosine"))


def _directory(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def scan(files: DataFrame, key: str = "doc_id", path: str = "path", text: str = "text", least: float = LEAST) -> DataFrame:
    """id, path, own_licence, cosine, licence, inherited_from: one row per row of `files`; inherited_from is the directory that
    an inherited licence comes from, '' the root."""
    own = stored(own_licences(files, key, path, text, least), "own")
    named = own.filter(F.col("path").rlike(LICENCE_FILE)).groupBy(_directory(F.col("path")).alias("above")).agg(
        F.min(F.struct("path", "id", "licence")).alias("file")
    ).select("above", F.col("file.licence").alias("given"))
    slim = files.select(F.col(key).cast("long").alias("id"), F.col(path).cast("string").alias("path")).withColumn("directory", _directory(F.col("path")))
    parts = F.split("directory", "/")
    chain = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    directories = slim.select("directory").filter("directory is not null").distinct().select("directory", F.explode(F.array_distinct(chain)).alias("above"))
    nearest = directories.join(stored(named, "named"), "above").groupBy("directory").agg(
        F.max(F.struct(F.length("above").alias("depth"), "above", "given")).alias("found")
    ).select("directory", F.col("found.above").alias("above"), F.col("found.given").alias("given"))
    rows = slim.join(own.select(F.col("id").alias("own_id"), F.col("path").alias("own_path"), F.col("licence").alias("own_licence"), "cosine"),
                     F.col("id").eqNullSafe(F.col("own_id")) & F.col("path").eqNullSafe(F.col("own_path")), "left")
    rows = rows.join(stored(nearest, "nearest"), "directory", "left")
    return rows.select(
        "id", "path", "own_licence", "cosine", F.coalesce("own_licence", "given").alias("licence"),
        F.when(F.col("own_licence").isNull() & F.col("given").isNotNull(), F.col("above")).alias("inherited_from"),
    )
