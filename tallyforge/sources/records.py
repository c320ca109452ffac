"""CSV records in parallel: quoted line breaks, files that are not UTF-8, and every record's place in the input.

Lines are read in splits. Whether a line begins inside a quoted field depends on all lines before it, so the state is found
by a scan in two steps: each block of lines is followed from both possible states, then the blocks of a file are chained.
Only lines with a quote take part, and only in files where a line leaves a quote open; other files need no such step. Lines
of one record are gathered by a shuffle, all other lines stay where they are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyforge.operators.ranking import with_rank
from tallyforge.session import cut

CORRUPT = "_corrupt_record"
ROW_BITS = 33  # row part of monotonically_increasing_id
#: Blocks of lines whose table is sent to all tasks; a block is a split of the input, so it is small beside it.
SENT_BLOCKS = 200_000
_QUOTED = r'"(?:[^"]++|"")*+'
_FIELDS = rf'(?:[^",][^,]*+,|{_QUOTED}"[^,]*+,|,)*+'
#: A line that leaves a quoted field open: from outside, and from inside one.
OPENS = rf"^{_FIELDS}{_QUOTED}$"
STAYS = rf'^(?:[^"]++|"")*+(?:"[^,]*+,{_FIELDS}{_QUOTED})?$'
_FOLDED = "_file string, _block long, start int, stop int, close long, last long, opens array<long>, closes array<long>"
_SEGMENT = "_nth long, first long, last long, key_nth long, key_row long"


def _fold(pdf: pd.DataFrame) -> pd.DataFrame:
    """A block's lines with quotes, followed from outside and from inside a quoted field."""
    pdf = pdf.sort_values("_row")
    lines = list(zip(pdf["_row"].tolist(), pdf["opens"].tolist(), pdf["stays"].tolist()))
    out = []
    for start in (0, 1):
        inside, begun, close, opens, closes = bool(start), -1, -1, [], []
        for row, does_open, does_stay in lines:
            if not inside and does_open:
                inside, begun = True, row
            elif inside and not does_stay:
                inside = False
                if begun < 0:
                    close = row  # ends the record that came from the block before
                else:
                    opens.append(begun)
                    closes.append(row)
        out.append((pdf["_file"].iloc[0], pdf["_block"].iloc[0], start, int(inside), close, begun if inside else -1, opens, closes))
    return pd.DataFrame(out, columns=["_file", "_block", "start", "stop", "close", "last", "opens", "closes"])


def _chain(pdf: pd.DataFrame) -> pd.DataFrame:
    """The stretches of lines that make up the records of several lines, from the blocks of one file in order."""
    pdf = pdf.sort_values(["_nth", "start"])
    out, inside, key = [], 0, (-1, -1)
    for nth, rows in pdf.groupby("_nth", sort=True):
        lo, hi = int(rows["lo"].iloc[0]), int(rows["hi"].iloc[0])
        mine = rows[rows["start"] == inside]
        if not len(mine):  # no quotes in this block
            if inside:
                out.append((nth, lo, hi, *key))
            continue
        r = mine.iloc[0]
        if inside:
            out.append((nth, lo, int(r["close"]) if r["close"] >= 0 else hi, *key))
        out += [(nth, a, b, nth, a) for a, b in zip(r["opens"], r["closes"])]
        if r["last"] >= 0:
            key = nth, int(r["last"])
            out.append((nth, int(r["last"]), hi, *key))
        inside = int(r["stop"])
    return pd.DataFrame(np.array(out, np.int64).reshape(-1, 5), columns=["_nth", "first", "last", "key_nth", "key_row"])


def _members(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """(_nth, _row, key_nth, key_row) of the lines of records of several lines."""
    has = F.col("value").contains('"')
    in_question = blocks.groupBy("_file").agg(F.sum("openers").alias("n")).filter("n > 0").select("_file")
    quoted = lines.filter(has).join(in_question, "_file", "left_semi").select(
        "_file", "_block", "_row", F.col("value").rlike(OPENS).alias("opens"), F.col("value").rlike(STAYS).alias("stays"))
    folded = quoted.groupBy("_file", "_block").applyInPandas(_fold, _FOLDED)
    chained = blocks.join(in_question, "_file", "left_semi").join(folded, ["_file", "_block"], "left").select(
        "_file", "_nth", "lo", "hi", F.coalesce("start", F.lit(-1)).alias("start"), F.coalesce("stop", F.lit(-1)).alias("stop"),
        F.coalesce("close", F.lit(-1)).alias("close"), F.coalesce("last", F.lit(-1)).alias("last"), "opens", "closes")
    segments = chained.groupBy("_file").applyInPandas(_chain, _SEGMENT)
    return segments.select("_nth", F.explode(F.sequence("first", "last")).alias("_row"), "key_nth", "key_row")


def _header(spark: SparkSession, path: str, encoding: str) -> list[str]:
    """Names of the first line; one that is not in the given encoding is read as ISO-8859-1."""
    names = spark.read.option("header", True).option("encoding", encoding).csv(path).columns
    if any("�" in n for n in names):
        names = spark.read.option("header", True).option("encoding", "ISO-8859-1").csv(path).columns
    return names


def read_csv(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """All columns as text, with the record's place in the input as ``ingest_seq``.

    Quoted fields may hold line breaks and doubled quotes. A file with bytes that are not UTF-8 is read as ISO-8859-1. The
    place is (file, byte block, row in block) of the first line, packed into one number so that later steps can compare it
    without a global sort. An unclosed quote makes the rest of its file one record.
    """
    names = _header(spark, path, encoding)
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"))
    value = F.col("value")
    blocks = lines.groupBy("_file", "_block").agg(
        F.min("_row").alias("lo"), F.max("_row").alias("hi"), F.min(F.when(F.trim(value) != "", F.col("_row"))).alias("written"),
        F.expr("bool_and(is_valid_utf8(value))").alias("valid"),
        F.count_if(value.contains('"') & value.rlike(OPENS)).alias("openers"))
    blocks = cut(with_rank(cut(blocks, "csv-blocks").withColumn("_all", F.lit(0)), ["_all"], ["_file", "_block"], "_nth").drop("_all"), "csv-places")
    size, openers = blocks.agg(F.count("*"), F.coalesce(F.sum("openers"), F.lit(0))).first()
    whole = blocks.groupBy("_file").agg(F.expr("bool_and(valid)").alias("utf8"))
    placed = blocks.join(whole, "_file").select("_file", "_block", "_nth", "written", "utf8")
    lines_placed = lines.join(F.broadcast(placed) if size <= SENT_BLOCKS else placed, ["_file", "_block"])
    read_as = F.when(F.col("utf8") & F.lit(encoding.upper() in ("UTF-8", "UTF8")), value).otherwise(
        F.decode(value.cast("binary"), "ISO-8859-1" if encoding.upper() in ("UTF-8", "UTF8") else encoding))
    rows = lines_placed.filter((F.col("_block") != 0) | F.col("written").isNull() | (F.col("_row") != F.col("written"))).select(
        read_as.alias("record"), "_file", "_nth", "_row")
    if openers:
        tagged = rows.join(_members(lines, blocks), ["_nth", "_row"], "left")
        several = tagged.filter("key_nth is not null").groupBy("_file", "key_nth", "key_row").agg(
            F.array_sort(F.collect_list(F.struct("_nth", "_row", "record"))).alias("parts")).select(
            F.concat_ws("\n", F.transform("parts", lambda p: p["record"])).alias("record"), "_file", F.col("key_nth").alias("_nth"),
            F.col("key_row").alias("_row"))
        rows = tagged.filter("key_nth is null").select("record", "_file", "_nth", "_row").unionByName(several)
    kinds = ", ".join(f"`{n.replace('`', '``')}` string" for n in [*names, CORRUPT])
    parsed = F.from_csv("record", kinds, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "quote": '"', "escape": '"'})
    in_block = F.col("_row").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return rows.filter(F.trim("record") != "").select(
        parsed.alias("r"), F.col("_file").alias("source_file"),
        (F.shiftleft(F.col("_nth").cast("long"), ROW_BITS) + in_block).alias("ingest_seq")).select("r.*", "source_file", "ingest_seq")
