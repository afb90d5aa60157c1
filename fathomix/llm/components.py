"""Connected components of a link table, by repeated contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Links that one task may hold, 16 bytes each; more are contracted by the cluster.
ONE_TASK = 2_000_000


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labels (id, comp) of the links (a, b) of one partition."""
    a, b = [], []
    for x in batches:
        a.append(x.column(0).to_numpy())
        b.append(x.column(1).to_numpy())
    if not a:
        return
    ids, at = np.unique(np.concatenate(a + b), return_inverse=True)
    half, up = len(at) // 2, np.arange(len(ids))
    u, v = at[:half], at[half:]
    while True:  # each vertex points to the smallest root seen over a link, then paths are halved
        ru, rv = up[u], up[v]
        low = np.minimum(ru, rv)
        new = up.copy()
        np.minimum.at(new, ru, low)
        np.minimum.at(new, rv, low)
        while (new[new] != new).any():
            new = new[new]
        if (new == up).all():
            break
        up = new
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[up])], names=["id", "comp"])


def components(links: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(id, comp): comp is the smallest id reachable over links (a, b); null ends are left out.

    Each round every vertex points to the smallest of itself and its neighbours, then the links
    are drawn between those.  Rounds grow with the logarithm of the longest chain.  Minima are
    taken map-side first, so a hub with very many links is no single task's load.  Each round's
    tables are written to the shared folder; nothing is collected.  Counted links up to
    ``one_task`` take a single task instead, which saves the rounds.
    """
    edges = materialise(links.filter("a != b").select("a", "b").distinct(), "links")
    if edges.count() <= one_task:
        return materialise(edges.coalesce(1).mapInArrow(forest, "id long, comp long"), "labels")
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        up = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("up"))
        up = materialise(up, "parents")
        if labels is None:
            labels = up.withColumnRenamed("up", "comp")
        else:
            step = up.withColumnRenamed("id", "comp")
            labels = labels.join(step, "comp", "left").select("id", F.coalesce("up", "comp").alias("comp"))
        labels = materialise(labels, "labels")
        ua, ub = up.select(F.col("id").alias("a"), F.col("up").alias("ua")), up.select(F.col("id").alias("b"), F.col("up").alias("ub"))
        edges = edges.join(ua, "a").join(ub, "b").select(F.col("ua").alias("a"), F.col("ub").alias("b")).filter("a != b").distinct()
        edges = materialise(edges, "links")
    if labels is None:
        a = edges.select(F.col("a").alias("id"))
        return a.select("id", F.col("id").alias("comp"))
    return labels
