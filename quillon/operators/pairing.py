"""Mate pairing by read name: the first and second classified read of a name are a pair, and so on."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def pairs(rows: DataFrame, name: str = "qname", order: tuple[str, ...] = ("ord",)) -> DataFrame:
    """rows (name, role, ...) with pair, and of it n and n_irr (members, and those whose role is IRR).

    A name's rows are consumed two by two in order; an odd last one is a pair of one.
    """
    names = Window.partitionBy(name)
    numbered = rows.withColumn("pair", F.floor((F.row_number().over(names.orderBy(*order)) - 1) / 2).cast("long"))
    both = Window.partitionBy(name, "pair")
    return numbered.withColumn("n", F.count("*").over(both)).withColumn("n_irr", F.count_if(F.col("role") == "IRR").over(both))


def confirmed(rows: DataFrame, name: str = "qname", order: tuple[str, ...] = ("ord",)) -> DataFrame:
    """IRR rows with a position whose pair is complete; outcome is paired or anchored."""
    found = pairs(rows, name, order).where("n = 2 and role = 'IRR' and start is not null")
    return found.withColumn("outcome", F.when(F.col("n_irr") == 2, "paired").otherwise("anchored"))
