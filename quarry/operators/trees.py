"""Trees of nodes as nested JSON and as rows, level by level.

Down, the children of a level's nodes are exploded as variants; up, the objects of a level are gathered by their parent. A document's
tree is one value, so it should fit a row; the work of a level is spread over all documents.

Defined cases: null and malformed trees have no nodes; nodes without children have none in the JSON either; of a node's fields, only
its list of children is walked through; fields come in the order of their names; a node that isn't an object is left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stored import stored

#: The field that holds a node's children.
CHILDREN = "nodes"


def _gathered(rows: DataFrame, by: list[str], order: str, text: str) -> DataFrame:
    """Texts in order, joined by commas."""
    return rows.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), ",").alias("inside"))


def fields_of(trees: DataFrame, tree: str = "tree", key: str = "doc_id") -> DataFrame:
    """key, path (places among siblings, from 0), field and its value as JSON, of all nodes of JSON trees: a list of nodes, or one node."""
    spark = trees.sparkSession
    parsed = F.try_parse_json(tree)
    level = trees.select(key, F.array().cast("array<int>").alias("above"), F.when(F.schema_of_variant(parsed).startswith("OBJECT"), F.concat(F.lit("["), tree, F.lit("]"))).otherwise(F.col(tree)).alias("inside")).where(parsed.isNotNull())
    out = []
    while True:
        nodes = level.withColumn("_list", F.try_parse_json("inside")).lateralJoin(spark.tvf.variant_explode(F.col("_list").outer()))
        nodes = nodes.where("pos IS NOT NULL").select(key, F.concat("above", F.array("pos")).alias("path"), F.to_json("value").alias("node"))
        nodes = nodes.withColumn("_node", F.parse_json("node")).lateralJoin(spark.tvf.variant_explode(F.col("_node").outer()))
        fields = stored(nodes.where("key IS NOT NULL").select(key, "path", F.col("key").alias("field"), F.to_json("value").alias("value")), "tree-fields")
        out.append(fields.where(F.col("field") != CHILDREN))
        level = fields.where(F.col("field") == CHILDREN).select(key, F.col("path").alias("above"), F.col("value").alias("inside"))
        if level.isEmpty():
            return reduce(DataFrame.unionByName, out)


def trees_of(fields: DataFrame, key: str = "doc_id") -> DataFrame:
    """JSON trees (a list of nodes) of the rows of fields_of."""
    parts = fields.withColumn("_name", F.to_json(F.create_map("field", F.lit(0))))
    parts = parts.withColumn("part", F.concat(F.expr("substring(_name, 2, length(_name) - 3)"), "value"))
    objects = _gathered(parts, [key, "path"], "field", "part").withColumn("depth", F.size("path"))
    objects = stored(objects, "tree-objects")
    deepest = objects.agg(F.max("depth")).head()[0] or 0
    below = None
    for depth in range(deepest, 0, -1):
        here = objects.where(F.col("depth") == depth).select(key, "path", "inside")
        if below is not None:
            here = here.join(below, [key, "path"], "left").select(key, "path", F.concat_ws(",", "inside", F.when(F.col("children").isNotNull(), F.concat(F.lit(f'"{CHILDREN}":['), "children", F.lit("]")))).alias("inside"))
        nodes = here.select(key, F.slice("path", 1, depth - 1).alias("path"), F.element_at("path", -1).alias("place"), F.concat(F.lit("{"), "inside", F.lit("}")).alias("node"))
        below = stored(_gathered(nodes, [key, "path"], "place", "node").withColumnRenamed("inside", "children"), "tree-level")
    if below is None:
        return fields.select(key, F.lit(None).cast("string").alias("tree")).limit(0)
    return below.select(key, F.concat(F.lit("["), "children", F.lit("]")).alias("tree"))


def nested(nodes: DataFrame, fields: list[str], key: str = "doc_id") -> DataFrame:
    """JSON trees of nodes (key, position, parent, and depth from 1) with these fields, children in order of their positions."""
    nodes = stored(nodes.select(key, "position", "parent", "depth", F.to_json(F.struct(*fields)).alias("own")), "tree-nodes")
    deepest = nodes.agg(F.max("depth")).head()[0] or 0
    below = None
    for depth in range(deepest, 0, -1):
        here = nodes.where(F.col("depth") == depth)
        if below is not None:
            here = here.join(below.withColumnRenamed("parent", "position"), [key, "position"], "left")
            own = F.expr("substring(own, 1, length(own) - 1)")
            here = here.withColumn("own", F.when(F.col("inside").isNull(), F.col("own")).otherwise(F.concat(own, F.lit(f',"{CHILDREN}":['), "inside", F.lit("]}"))))
        below = stored(_gathered(here.select(key, "parent", "position", "own"), [key, "parent"], "position", "own"), "tree-level")
    if below is None:
        return nodes.select(key, F.lit(None).cast("string").alias("tree")).limit(0)
    return below.select(key, F.concat(F.lit("["), "inside", F.lit("]")).alias("tree"))


def without(trees: DataFrame, removed: list[str], tree: str = "tree", key: str = "doc_id") -> DataFrame:
    """The trees without some fields of their nodes, at every depth."""
    return trees_of(fields_of(trees, tree, key).where(~F.col("field").isin(*removed)), key)
