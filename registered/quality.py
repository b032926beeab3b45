"""Quality metrics on labelled documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from oracles.views import cte, stmt
from registered import Family
from wardwatch.bridge import views as V
from wardwatch.operators import quality as Q

fam = Family()
PRF = """tp, fp, fn, tp + fn AS support, round({z}tp / nullif(tp + fp, 0)::DOUBLE{e}, 6) AS precision, round({z}tp / nullif(tp + fn, 0)::DOUBLE{e}, 6) AS recall,
    round({z}CASE WHEN tp + fp > 0 AND tp + fn > 0 THEN 2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE * CASE WHEN tp = 0 THEN NULL ELSE 1 END END{e}, 6) AS f1"""


def rounded(df, *by):
    return df.select(*by, "tp", "fp", "fn", "support", *[F.round(c, 6).alias(c) for c in ["precision", "recall", "f1"]])


cte(
    "confusion",
    """SELECT detector, count(*) FILTER (y_true AND y_pred) AS tp, count(*) FILTER (NOT y_true AND y_pred) AS fp, count(*) FILTER (y_true AND NOT y_pred) AS fn
    FROM binary_rows GROUP BY 1""",
    "binary_rows",
)
cte(
    "toxic_confusion",
    """SELECT detector, count(*) FILTER (toxic AND y_pred) AS tp, count(*) FILTER (NOT toxic AND y_pred) AS fp, count(*) FILTER (toxic AND NOT y_pred) AS fn
    FROM binary_rows GROUP BY 1""",
    "binary_rows",
)


@fam.add("qua_binary_metrics", stmt(f"SELECT detector, {PRF.format(z='', e='')} FROM confusion", "confusion"))
def _binary(spark, sf):
    return rounded(Q.binary_metrics(V.binary(spark, sf), "y_true", "y_pred", ["detector"]), "detector")


@fam.add("qua_binary_metrics_toxic", stmt(f"SELECT detector, {PRF.format(z='', e='')} FROM toxic_confusion", "toxic_confusion"))
def _toxic(spark, sf):
    return rounded(Q.binary_metrics(V.binary(spark, sf), "toxic", "y_pred", ["detector"]), "detector")


@fam.add("qua_binary_metrics_zero", stmt(f"SELECT detector, {PRF.format(z='coalesce(', e=', 0)')} FROM toxic_confusion", "toxic_confusion"))
def _zero(spark, sf):
    return rounded(Q.zero_filled(Q.binary_metrics(V.binary(spark, sf), "toxic", "y_pred", ["detector"])), "detector")


@fam.add(
    "qua_one_vs_rest",
    f"""SELECT class, {PRF.format(z='', e='')} FROM (SELECT class, count(*) FILTER (t = class AND p = class) AS tp, count(*) FILTER (t <> class AND p = class) AS fp,
      count(*) FILTER (t = class AND p <> class) AS fn FROM (VALUES ('normal'), ('crackle'), ('wheeze'), ('both'), ('none')) AS c(class),
      (SELECT ['normal', 'crackle', 'wheeze', 'both'][l_linenumber % 4 + 1] AS t, ['normal', 'crackle', 'wheeze', 'both'][l_partkey % 4 + 1] AS p FROM lineitem) GROUP BY class)""",
)
def _ovr(spark, sf):
    names = F.array(*[F.lit(n) for n in ["normal", "crackle", "wheeze", "both"]])
    li = V.table(spark, sf, "lineitem").select(
        F.get(names, F.col("l_linenumber") % 4).alias("t"), F.get(names, (F.col("l_partkey") % 4).cast("int")).alias("p")
    )
    return rounded(Q.one_vs_rest(li, "t", "p", ["normal", "crackle", "wheeze", "both", "none"]), "class")


@fam.add("qua_prevalence", stmt("SELECT detector, round(avg(y_true::INT), 6) AS prevalence FROM binary_rows GROUP BY 1", "binary_rows"))
def _prevalence(spark, sf):
    return Q.prevalence(V.binary(spark, sf), "y_true", ["detector"]).withColumn("prevalence", F.round("prevalence", 6))
