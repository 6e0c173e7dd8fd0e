"""Connected components of a link table, by label propagation with pointer jumping.

Links and labels stay in tables; the driver sees only a count a round.  Each
round takes the least label among a node and its neighbours, then the label of
that label, so chains halve in length.  Minima combine before the shuffle, and
adaptive joins split a hub's links over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamdex.llm.common import discard, stored


def components(links: DataFrame) -> DataFrame:
    """(id, component) for each id in links (a, b); component is the least id reachable.  No links: no rows."""
    pairs = stored(links.where("a <> b").select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b").distinct(), "links")
    labels = stored(pairs.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("component")), "labels")
    while True:
        around = pairs.join(labels, pairs.b == labels.id).groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        stepped = labels.join(around, "id").select("id", F.least("component", "near").alias("to"), F.col("component").alias("was"))
        roots = labels.select(F.col("id").alias("to"), F.col("component").alias("root"))
        before, moved = labels, stored(stepped.join(roots, "to", "left").select("id", F.least("to", F.coalesce("root", "to")).alias("component"), "was"), "labels")
        discard(before)
        labels = moved.select("id", "component")
        if moved.where("component <> was").limit(1).count() == 0:
            discard(pairs)
            return labels
