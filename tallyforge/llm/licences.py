"""Licence scans: sparse TF-IDF cosine of header lines to templates, then inheritance from the nearest ancestor directory.

Column functions only. Header lines are lines of whole texts that use a licence word. They are reduced to the distinct
lines with their numbers before anything is compared, so a line that millions of files share is weighed once. Files without
a licence of their own take that of the nearest directory above them that has a licence file; directories are joined by
path, once per directory and not per file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tallyforge.session import cut

THRESHOLD = 0.6
#: What makes a line a header line.
HEADER = r"(?i)licen[cs]|copyright|spdx|redistribut|public domain"

# Header texts of common licences.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def _terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != "")


def _weights(spark: SparkSession, lines: DataFrame, templates: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(line, term, w) and (template, term, w): TF-IDF vectors of length one; line numbers n and templates are the corpus."""
    known = spark.createDataFrame(list(templates.items()), "template string, text string")
    of_lines = lines.select("line", "n", F.explode(_terms(F.col("line"))).alias("term")).groupBy("line", "n", "term").agg(
        F.count("*").alias("tf"))
    of_known = known.select("template", F.explode(_terms(F.col("text"))).alias("term")).groupBy("template", "term").agg(
        F.count("*").alias("tf"))
    seen = of_lines.select("term", "n").unionByName(of_known.select("term", F.lit(1).cast("long").alias("n")))
    total = lines.agg((F.coalesce(F.sum("n"), F.lit(0)) + len(templates)).alias("total"))
    idf = cut(seen.groupBy("term").agg(F.sum("n").alias("df")).join(F.broadcast(total)).select(
        "term", (F.log((F.col("total") + 1) / (F.col("df") + 1)) + 1).alias("idf")), "idf")

    def unit(df: DataFrame, key: str) -> DataFrame:
        raw = df.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
        return raw.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") ** 2).over(Window.partitionBy(key)))).select(key, "term", "w")

    return unit(of_lines, "line"), unit(of_known, "template")


def detect(lines: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(line, licence, cosine) for the distinct header lines (line, n) that reach ``threshold``; ties to the first name."""
    left, right = _weights(lines.sparkSession, lines, templates or TEMPLATES)
    right = right.withColumnRenamed("w", "tw")  # a few rows for each template
    cosine = left.join(F.broadcast(right), "term").groupBy("line", "template").agg(F.round(F.sum(F.col("w") * F.col("tw")), 9).alias("cosine"))
    first = F.min(F.struct((-F.col("cosine")).alias("c"), F.col("template").alias("t"))).alias("best")
    return cosine.filter(F.col("cosine") >= threshold).groupBy("line").agg(first).select(
        "line", F.col("best")["t"].alias("licence"), (-F.col("best")["c"]).alias("cosine"))


def _parent(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def scan(files: DataFrame, path_col: str = "path", text_col: str = "text", licence_file: Column | None = None,
         threshold: float = THRESHOLD) -> DataFrame:
    """(path, licence, cosine, inherited_from) for every file.

    ``licence_file`` tells the files that speak for their directory; by default those named like LICENSE, COPYING or NOTICE.
    A file's own licence is that of its best header line, ties to the earlier line; cosine is its similarity, and
    ``inherited_from`` the directory ("" is the root) if the licence is an ancestor's. Of several licence files in a
    directory the best cosine counts, ties to the smaller path. Files with neither have nulls; null and empty texts have no
    header; a null path has no ancestors. Repeated paths share what any of them has. No files: no rows.
    """
    path, text = F.col(f"`{path_col}`"), F.col(f"`{text_col}`")
    speaks = licence_file if licence_file is not None else path.rlike(r"(?i)(^|/)(licen[cs]e|copying|notice)[^/]*$")
    base = files.select(path.alias("path"), F.coalesce(speaks, F.lit(False)).alias("speaks"),
                        F.when(text.rlike(HEADER), text).alias("text"))
    paths = base.select("path")
    headers = base.filter("text is not null").select("path", "speaks", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    headers = cut(headers.withColumn("line", F.trim("line")).filter(F.col("line").rlike(HEADER)), "headers")
    lines = cut(headers.groupBy("line").agg(F.count("*").alias("n")), "lines")
    found = detect(lines, threshold=threshold)
    best = F.min(F.struct((-F.col("cosine")).alias("c"), "at", "licence")).alias("best")
    own = headers.join(found, "line").groupBy("path").agg(best, F.max("speaks").alias("speaks"))
    own = cut(own.select("path", "speaks", F.col("best")["licence"].alias("licence"), (-F.col("best")["c"]).alias("cosine")), "own")

    notice = own.filter("speaks and path is not null").groupBy(_parent(F.col("path")).alias("dir")).agg(
        F.min(F.struct((-F.col("cosine")).alias("c"), "path", "licence")).alias("best"))
    notice = notice.select("dir", F.col("best")["licence"].alias("dir_licence"), (-F.col("best")["c"]).alias("dir_cosine"))
    folders = paths.filter("path is not null").select(_parent(F.col("path")).alias("folder")).distinct()
    steps = F.split("folder", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(steps, 1, k), "/").alias("dir")))
    above = folders.select("folder", F.inline(F.when(F.col("folder") == "", F.slice(above, 1, 1)).otherwise(above)))
    nearest = above.join(notice, "dir").groupBy("folder").agg(F.max(F.struct("depth", "dir", "dir_licence", "dir_cosine")).alias("up"))
    nearest = nearest.select("folder", "up.dir", "up.dir_licence", "up.dir_cosine")
    out = paths.withColumn("folder", _parent(F.col("path"))).join(own.drop("speaks"), "path", "left").join(nearest, "folder", "left")
    mine = F.col("licence").isNotNull()
    return out.select(F.col("path").alias(path_col), F.coalesce("licence", "dir_licence").alias("licence"),
                      F.when(mine, F.col("cosine")).otherwise(F.col("dir_cosine")).alias("cosine"),
                      F.when(~mine, F.col("dir")).alias("inherited_from"))


def as_files(docs: DataFrame) -> DataFrame:
    """Documents as files (path, text, speaks): source, thousands, fifties; every fiftieth is its folder's licence file."""
    i, source = F.col("doc_id"), F.coalesce("source", F.lit("none"))
    thousand, fifty = F.floor(i / 1000).cast("string"), F.floor(i / 50).cast("string")
    name = F.concat(i.cast("string"), F.lit(".txt"))
    path = (F.when(i % 20000 == 0, F.concat_ws("/", source, name)).when(i % 1000 == 0, F.concat_ws("/", source, thousand, name))
            .otherwise(F.concat_ws("/", source, thousand, fifty, name)))
    return docs.select(F.when(i.isNotNull(), path).alias("path"), "text", (i % 50 == 0).alias("speaks"))
