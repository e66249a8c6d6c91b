"""Connected components of links, by labels that take the least neighbour and then jump to their label's label.

Defined cases: no links give no rows; repeated links and links of a node with itself change nothing; ids are not null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sparkloom.llm._shared import Scratch


def components(nodes: DataFrame, links: DataFrame, store: Scratch) -> DataFrame:
    """nodes(id), links(a, b) to (id, label): label is the least id of the node's component."""
    return nodes.join(linked_components(links, store), "id", "left").select("id", F.coalesce("label", "id").alias("label"))


def joined_components(labels: DataFrame, links: DataFrame, store: Scratch) -> DataFrame:
    """labels(id, label) of the nodes linked so far, after more links(a, b). Nodes without any link have no row.

    Only the components that the new links join are worked on; then each label is written once.
    """
    one, other = (labels.select(F.col("id").alias(end), F.col("label").alias(f"_{end}")) for end in ("a", "b"))
    ends = links.join(one, "a", "left").join(other, "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
    between = store.table(ends.where("a <> b").distinct(), "between")
    if between.isEmpty():
        return labels
    moved = linked_components(between, store)
    known = labels.join(moved.select(F.col("id").alias("label"), F.col("label").alias("_new")), "label", "left").select("id", F.coalesce("_new", "label").alias("label"))
    made = store.table(known.unionByName(moved.select("id", "label").join(labels, "id", "left_anti")), "components")
    store.drop(between, moved)
    return made


def linked_components(links: DataFrame, store: Scratch) -> DataFrame:
    """A stored table with id and label of the nodes that have links.

    Every round is written to the shared folder. Joins and sums are by node, so no component is gathered anywhere.
    """
    both = store.table(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = store.table(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("label").alias("near"))
        lowered = store.table(labels.join(near, labels["id"] == near["a"]).select("id", F.least("label", "near").alias("label"), F.col("label").alias("was")), "labels")
        jump = lowered.select(F.col("id").alias("to"), F.col("label").alias("further"))
        after = store.table(lowered.join(jump, lowered["label"] == jump["to"], "left").select("id", F.coalesce("further", "label").alias("label"), "was"), "labels")
        store.drop(labels, lowered)
        labels = after
        if after.where(F.col("label") != F.col("was")).isEmpty():
            break
    store.drop(both)
    return labels
