"""Prescription documents as lines of text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardwatch.sources.signals import parse_number

# Labels the documents carry, in the order they are checked.
LABELS = {
    "Paciente": "patient_id",
    "Medicamento": "drug",
    "Dose": "dose_text",
    "Frequência": "frequency",
    "Data": "ts",
}


def parse_prescription_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records and failures from ``(doc_id, line_no, line)``.

    A line is ``label: value``; the last line of a label wins. The failure names the
    first missing label, or ``Dose`` when its number does not parse.
    """
    at = F.instr("line", ": ")
    label = F.when(at > 0, F.trim(F.substring("line", F.lit(1), at - 1)))
    number_of = F.array_position(F.array(*[F.lit(name) for name in LABELS]), label).cast("byte")
    # Lines go to their document once, as short as they are needed; grouping before the
    # shuffle would sort all of them, and send wide rows. A line without a label is kept
    # for the document alone.
    pairs = lines.select("doc_id", "line_no", F.explode(F.array(number_of)).alias("_label"), at.alias("_at"), "line").select(
        "doc_id",
        "_label",
        F.when(F.col("_label") > 0, F.col("line_no")).alias("line_no"),
        F.when(F.col("_label") > 0, F.trim(F.substring("line", F.col("_at") + 2, F.length("line")))).alias("value"),
    )
    wide = pairs.repartition("doc_id").groupBy("doc_id").agg(
        *[F.max_by("value", F.when(F.col("_label") == i, F.col("line_no"))).alias(name) for i, name in enumerate(LABELS.values(), 1)]
    )
    missing = F.coalesce(
        *[F.when(F.col(n).isNull() | (F.col(n) == ""), F.lit(label)) for label, n in LABELS.items()]
    )
    space = F.instr("dose_text", " ")
    number = F.when(space > 0, F.substring("dose_text", F.lit(1), space - 1)).otherwise(F.col("dose_text"))
    unit = F.when(space > 0, F.substring("dose_text", space + 1, F.length("dose_text"))).otherwise("")
    parsed = wide.select("*", missing.alias("_missing"), parse_number(number).alias("dose"), unit.alias("unit"), number.alias("_n"))
    ok = F.col("_missing").isNull() & F.col("dose").isNotNull()
    failed = parsed.filter(~ok).select(
        "doc_id",
        F.coalesce("_missing", F.lit("Dose")).alias("field"),
        F.when(F.col("_missing").isNotNull(), "field missing in the text")
        .otherwise(F.concat(F.lit("dose is not a number: "), F.col("_n")))
        .alias("reason"),
    )
    return parsed.filter(ok).select("doc_id", "patient_id", "drug", "dose", "unit", "frequency", "ts"), failed
