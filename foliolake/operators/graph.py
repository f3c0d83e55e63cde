"""Object graphs: reachability, components, inherited values, copies by content."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _settled(spark) -> str:
    return spark.conf.get("spark.checkpoint.dir", None) or ""


def _cut(df: DataFrame) -> DataFrame:
    """Cuts lineage where the session names a folder for checkpoints."""
    folder = _settled(df.sparkSession)
    if not folder:
        return df.cache()
    df.sparkSession.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def reachable(edges: DataFrame, roots: DataFrame, doc: str = "doc_id", source: str = "src", target: str = "dst") -> DataFrame:
    """(doc, node) of all that roots (doc, node) reach; cycles are fine. One join a level, over the nodes that are new."""
    seen = _cut(roots.select(doc, "node").distinct())
    front = seen
    while True:
        step = front.join(edges.select(doc, F.col(source).alias("node"), F.col(target).alias("__t")), [doc, "node"]).select(doc, F.col("__t").alias("node")).distinct()
        front = _cut(step.join(seen, [doc, "node"], "left_anti"))
        if front.isEmpty():
            return seen
        seen = _cut(seen.unionByName(front))


def components(edges: DataFrame, keys: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """(keys, node, component): the least node each node is tied to, by least labels and the labels' own labels."""
    both = edges.select(*keys, F.col(a).alias("node"), F.col(b).alias("other"))
    both = _cut(both.unionByName(edges.select(*keys, F.col(b).alias("node"), F.col(a).alias("other"))).distinct())
    labels = _cut(both.groupBy(*keys, "node").agg(F.least(F.min("other"), F.first("node")).alias("component")))
    while True:
        other = labels.select(*keys, F.col("node").alias("other"), F.col("component").alias("__c"))
        near = both.join(other, [*keys, "other"]).groupBy(*keys, "node").agg(F.min("__c").alias("__m"))
        new = labels.join(near, [*keys, "node"]).select(*keys, "node", F.least("component", "__m").alias("component"))
        jump = new.select(*keys, F.col("node").alias("component"), F.col("component").alias("__j"))
        new = _cut(new.join(jump, [*keys, "component"], "left").select(*keys, "node", F.least("component", F.coalesce("__j", "component")).alias("component"), ))
        changed = new.join(labels, [*keys, "node", "component"], "left_anti")
        if changed.isEmpty():
            return new
        labels = new


def inherited(nodes: DataFrame, keys: list[str], node: str, parent: str, value: str, hops: int = 16) -> DataFrame:
    """(keys, node, value): a node's own value or the nearest ancestor's, at most ``hops`` up."""
    up = nodes.select(*keys, F.col(node).alias("__node"), F.col(parent).alias("__parent"), F.col(value).alias("__value"))
    out = up.select(*keys, F.col("__node").alias(node), F.col("__parent").alias("__at"), F.col("__value").alias(value))
    for _ in range(hops):
        if out.where(F.col(value).isNull() & F.col("__at").isNotNull()).isEmpty():
            break
        step = up.select(*keys, F.col("__node").alias("__at"), F.col("__parent").alias("__next"), F.col("__value").alias("__above"))
        out = _cut(out.join(step, [*keys, "__at"], "left").select(*keys, node, F.when(F.col(value).isNull(), F.col("__next")).alias("__at"), F.coalesce(value, "__above").alias(value)))
    return out.select(*keys, node, value)


def content_copies(objects: DataFrame, keys: list[str], node: str, content: str) -> DataFrame:
    """(keys, node, keeper): the least node with the same content, by SHA-256."""
    hashed = objects.select(*keys, node, F.sha2(F.col(content).cast("binary"), 256).alias("__h"))
    least = hashed.groupBy(*keys, "__h").agg(F.min(node).alias("keeper"))
    return hashed.join(least, [*keys, "__h"]).select(*keys, node, "keeper")
