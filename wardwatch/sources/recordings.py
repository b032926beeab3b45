"""Respiratory recordings: file names and cycle annotation lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardwatch.sources.signals import parse_number

BLANKS = " \t\n\x0b\f\r"


def stem(path: Column) -> Column:
    """File name without folder and last extension."""
    return F.regexp_replace(F.regexp_replace(path, r"^.*/", ""), r"(?<=.)\.[^.]*$", "")


def recording_parts(files: DataFrame, path: str = "path") -> tuple[DataFrame, DataFrame]:
    """Names of exactly five ``_`` separated parts, and the rejected rest."""
    parts = F.split(stem(F.col(path)), "_")
    judged = files.withColumn("_p", parts)
    names = ["patient_id", "recording_index", "location", "mode", "equipment"]
    good = judged.filter(F.size("_p") == 5)
    return (
        good.select(*files.columns, *[F.get("_p", i).alias(n) for i, n in enumerate(names)]),
        judged.filter(F.size("_p") != 5).drop("_p"),
    )


def cycle_label(crackle: Column, wheeze: Column) -> Column:
    """Label of two text flags; anything but 0 and 1 is NULL."""
    c, w = crackle == "1", wheeze == "1"
    named = F.when(c & w, "both").when(c, "crackle").when(w, "wheeze").otherwise("normal")
    return F.when(crackle.isin("0", "1") & wheeze.isin("0", "1"), named)


def parse_cycle_lines(lines: DataFrame) -> DataFrame:
    """Cycles from ``(record_id, line_no, line)``: start, end, crackle and wheeze flags,
    tab separated. Bad lines disappear; ``cycle_index`` stays the line number."""
    cells = F.split(F.btrim("line", F.lit(BLANKS)), "\t")
    # generators, so that a line is split and a number parsed once, not anew for every condition
    split = lines.select("record_id", F.col("line_no").alias("cycle_index"), F.explode(F.array(cells)).alias("_f")).filter(F.size("_f") == 4)
    f = F.col("_f")
    named = split.withColumn("label", cycle_label(F.get(f, 2), F.get(f, 3))).filter(F.col("label").isNotNull())
    numbers = F.struct(parse_number(F.get(f, 0)).alias("start_s"), parse_number(F.get(f, 1)).alias("end_s"))
    parsed = named.select("record_id", "cycle_index", "label", F.inline(F.array(numbers)))
    return parsed.filter(F.col("start_s").isNotNull() & F.col("end_s").isNotNull()).select("record_id", "cycle_index", "start_s", "end_s", "label")
