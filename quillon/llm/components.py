"""Connected components of a link table, by hooking to the smallest neighbour and contracting.

Union-find without shared memory: each round every vertex points to its smallest neighbour if that is
smaller, pointers are shortened by one jump, and the links are rewritten to the pointed-to vertices.
Links inside one vertex vanish, so the table shrinks from round to round. Everything stays in tables of
the shared folder; the driver sees only whether links are left. Up to DRIVER_LINKS links, as many rows as a
broadcast may have, are joined up on the driver by the same hooking and contracting, without the rounds' many small tables.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from quillon.llm.common import forget, materialize


#: links of 16 bytes that the driver takes at most
DRIVER_LINKS = 500_000


def smallest_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ends of the links (a, b), in order, and the smallest end that each reaches."""
    ends, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(ends))
    while len(u):
        low = np.minimum(label[u], label[v])
        np.minimum.at(label, label[u], low)
        np.minimum.at(label, label[v], low)
        while (label[label] != label).any():
            label = label[label]
        apart = label[u] != label[v]
        u, v = u[apart], v[apart]
    return ends, ends[label]


def components(spark: SparkSession, links: DataFrame, most: int = DRIVER_LINKS) -> DataFrame:
    """(node, label) for every end of links (a, b): label is the smallest node that it reaches.

    Repeated links and links of a node with itself are fine; a null end is ignored; no links, no rows. More than
    most links are joined up in rounds.
    """
    both = links.where("a is not null and b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    first = materialize(spark, both.distinct(), "links")
    if first.count() <= most:
        rows = first.select(F.col("a").cast("long"), F.col("b").cast("long")).toArrow()
        forget(spark, first)
        node, label = smallest_reached(*(rows.column(c).to_numpy() for c in ("a", "b")))
        found = spark.createDataFrame(pa.table({"node": node, "label": label}), "node long, label long")
        kind = first.schema["a"].dataType
        return materialize(spark, found.coalesce(1).select(*[F.col(c).cast(kind).alias(c) for c in ("node", "label")]), "labels")
    labels = first.select(F.col("a").alias("node")).union(first.select("b")).distinct().select("node", F.col("node").alias("label"))
    edges, old = first.where("a < b"), [first]
    while not edges.isEmpty():
        ends = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        hooked = materialize(spark, ends.groupBy("u").agg(F.least("u", F.min("v")).alias("up")), "hooks")
        above = hooked.select(F.col("u").alias("up"), F.col("up").alias("top"))
        jumped = materialize(spark, hooked.join(above, "up", "left").select("u", F.coalesce("top", "up").alias("up")), "pointers")
        to_a = jumped.select(F.col("u").alias("a"), F.col("up").alias("pa"))
        to_b = jumped.select(F.col("u").alias("b"), F.col("up").alias("pb"))
        moved = edges.join(to_a, "a").join(to_b, "b").where("pa <> pb")
        fewer = materialize(spark, moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
        to = jumped.select(F.col("u").alias("label"), F.col("up").alias("next"))
        moved_labels = materialize(spark, labels.join(to, "label", "left").select("node", F.coalesce("next", "label").alias("label")), "labels")
        forget(spark, hooked, jumped, *old)  # what follows reads none of them
        edges, labels, old = fewer, moved_labels, [fewer, moved_labels]
    return labels
