"""Entity search, k-hop neighbourhoods and page trees."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stored import place, stored


def grams(text, n: int = 3):
    """Distinct stretches of n characters, or the text itself if it is shorter."""
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n))))).otherwise(F.array(text))


def find_entities(names: DataFrame, asked: DataFrame, k: int = 5) -> DataFrame:
    """Names that contain an asked word, whatever the case, the first k of each. A word of one or two characters is found under itself, where the first k names are enough; longer ones meet names under their rarest three characters, then are looked for. Only lengths that are asked for are posted, once."""
    low = names.select(F.lower("name").alias("low"), "name").distinct()
    wanted = asked.select("asked", F.lower("asked").alias("word")).distinct().withColumn("n", F.least(F.length("word"), F.lit(3))).where("n > 0")
    lengths = sorted(r[0] for r in wanted.select("n").distinct().collect())  # three at most
    posts = lambda n: low.select("low", "name", F.explode(grams(F.col("low"), n)).alias("gram")).where(F.length("gram") == n)
    rank = lambda by: F.row_number().over(Window.partitionBy(by).orderBy("name"))
    found = []
    for n in lengths:
        words = wanted.where(F.col("n") == n)
        if n < 3:
            first = posts(n).withColumn("rank", rank("gram")).where(F.col("rank") <= k)
            found.append(words.join(first, F.col("gram") == F.col("word")).select("asked", "name"))
            continue
        posted = stored(posts(n), "name-grams")
        parts = words.withColumn("gram", F.explode(grams(F.col("word"))))
        often = posted.join(parts.select("gram").distinct(), "gram", "left_semi").groupBy("gram").count()
        rarest = parts.join(often, "gram", "left").groupBy("asked", "word").agg(F.min_by("gram", F.coalesce("count", F.lit(0))).alias("gram"))
        found.append(posted.join(rarest, "gram").where(F.col("low").contains(F.col("word"))).select("asked", "name"))
    if not found:
        return wanted.select("asked", F.col("word").alias("name"), F.lit(1).alias("rank")).limit(0)
    return reduce(DataFrame.unionByName, found).distinct().withColumn("rank", rank("asked")).where(F.col("rank") <= k)


def both_ways(triplets: DataFrame) -> DataFrame:
    """Triplets as undirected edges: one end, the other, and the triplet."""
    t = F.struct("subject", "predicate", "object")
    return triplets.select(F.col("subject").alias("node"), F.col("object").alias("other"), t.alias("triplet")).union(triplets.select("object", "subject", t))


#: Edges of a node that meet the frontier in one task, about.
HUB = 50_000


def k_hop(seeds: DataFrame, triplets: DataFrame, hops: int) -> DataFrame:
    """node and the fewest hops from a seed. Each hop joins the frontier alone with the edges, drops what has been reached, and is stored in a folder of its own below one table: a hop's plan is the same whatever has gone before. Edges of hubs are dealt into parts by their other end, and the frontier's hubs go to all of them."""
    spark, at = seeds.sparkSession, place(seeds.sparkSession, "hops")
    edges = both_ways(triplets).select("node", "other").distinct()
    degree = edges.groupBy("node").agg(F.ceil(F.count("*") / HUB).cast("int").alias("parts")).where("parts > 1")
    edges = edges.join(degree, "node", "left").na.fill(1, ["parts"])
    edges = stored(edges.select("node", "other", "parts", F.pmod(F.xxhash64("other"), F.col("parts")).cast("int").alias("part")), "edges")
    hubs = stored(edges.where("parts > 1").select("node", "parts").distinct(), "hubs")
    seeds.select("node").distinct().write.parquet(f"{at}/depth=0")
    kind = seeds.select("node", F.lit(0).alias("depth")).schema
    reached = lambda: spark.read.schema(kind).option("basePath", at).parquet(f"{at}/depth=*")
    for hop in range(1, hops + 1):
        frontier = reached().where(F.col("depth") == hop - 1).join(hubs, "node", "left").na.fill(1, ["parts"])
        frontier = frontier.select("node", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        step = frontier.join(edges, ["node", "part"]).select(F.col("other").alias("node")).distinct()
        step.join(reached().select("node"), "node", "left_anti").write.parquet(f"{at}/depth={hop}")
    return reached()


def within(nodes: DataFrame, triplets: DataFrame) -> DataFrame:
    """Triplets with both ends among the nodes."""
    n = nodes.select("node")
    return triplets.join(n, triplets.subject == n.node, "left_semi").join(n, triplets.object == n.node, "left_semi")


def page_numbers(ranges: DataFrame, column: str = "pages") -> DataFrame:
    """Distinct sorted page numbers of texts as '5-7, 12'; a range that runs backwards has none."""
    parts = F.transform(F.split(F.regexp_replace(column, r"[^0-9,\-]", ""), ","), lambda p: F.split(p, "-"))
    number = lambda x: F.expr("1") * x.try_cast("int")

    def pages(p):
        first, last = number(F.get(p, F.lit(0))), number(F.get(p, F.size(p) - 1))
        return F.when(first.isNotNull() & last.isNotNull() & (first <= last), F.sequence(first, F.greatest(first, last))).otherwise(F.array().cast("array<int>"))

    return ranges.withColumn("page_list", F.array_sort(F.array_distinct(F.flatten(F.transform(parts, pages)))))


def page_contents(asked: DataFrame, pages: DataFrame) -> DataFrame:
    """The asked pages' texts in order; pages that don't exist are left out."""
    rows = asked.select("doc_id", F.explode("page_list").alias("page")).join(pages, ["doc_id", "page"])
    lines = F.array_sort(F.collect_list(F.struct("page", F.concat(F.lit("--- Page "), F.col("page").cast("string"), F.lit(" ---\n"), F.col("content")).alias("text"))))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(lines, lambda x: x["text"]), "\n\n").alias("content"), F.count("*").alias("n_pages"))


def headings_of(docs: DataFrame) -> DataFrame:
    """Markdown headings of documents: doc_id, position (the line, from 1), level, title."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "heading"))
    level = F.length(F.regexp_extract("heading", r"^\s*(#{1,6})\s", 1))
    title = F.trim(F.regexp_replace("heading", r"^\s*#{1,6}\s+", ""))
    return lines.withColumn("level", level).where("level > 0").select("doc_id", (F.col("line") + 1).alias("position"), "level", title.alias("title"))


def tree_of(headings: DataFrame) -> DataFrame:
    """Parents of headings (doc_id, position, level): the last heading of a lower level before; and their depth. One window, no recursion."""
    w = Window.partitionBy("doc_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    last = F.array(*(F.max(F.when(F.col("level") == k, F.col("position"))).over(w) for k in range(1, 7)))
    before = F.filter(F.slice(F.col("last"), 1, F.col("level") - 1), lambda x: x.isNotNull())
    rows = headings.withColumn("last", last).withColumn("before", F.when(F.col("level") > 1, before).otherwise(F.array().cast("array<long>")))
    return rows.withColumns({"parent": F.array_max("before"), "depth": _depth(F.col("before"))}).drop("last", "before")


def _depth(before):
    """Number of ancestors and one: before holds, by level, the last heading of each lower level; one that stands before a later heading of a still lower level is none."""
    ancestors = F.filter(F.transform(before, lambda x, i: F.struct(x.alias("x"), F.coalesce(F.array_max(F.slice(before, 1, i)), F.lit(-1)).alias("lower"))), lambda p: p["x"] > p["lower"])
    return F.size(ancestors) + 1


def neighbours(seeds: DataFrame, triplets: DataFrame, hops: int, siblings: int = 10) -> DataFrame:
    """Triplets met on the way from each seed, whatever the case: a node shows its first few triplets, and each hop goes on from twice as many new nodes at most, in order of their names."""
    low = triplets.select(F.lower("subject").alias("s"), "predicate", F.lower("object").alias("o"), "subject", "object")
    ends = low.select(F.col("s").alias("node"), "*").unionByName(low.where("s != o").select(F.col("o").alias("node"), "*"))
    shown = ends.withColumn("n", F.row_number().over(Window.partitionBy("node").orderBy("s", "predicate", "o", "subject", "object"))).where(F.col("n") <= siblings).drop("n")
    shown = stored(shown.select("node", "s", "predicate", "o", "subject", "object"), "shown")
    seen = stored(seeds.select("seed", F.lower("seed").alias("node")).distinct(), "seen")
    frontier, met = seen, []
    for _ in range(hops):
        found = stored(frontier.join(shown, "node").select("seed", "s", "predicate", "o", "subject", "object"), "met")
        met.append(found)
        step = stored(found.select("seed", F.explode(F.array("s", "o")).alias("node")).distinct().join(seen, ["seed", "node"], "left_anti"), "step")
        seen = stored(seen.unionByName(step), "seen")
        frontier = step.withColumn("n", F.row_number().over(Window.partitionBy("seed").orderBy("node"))).where(F.col("n") <= 2 * siblings).drop("n")
    first = F.min_by(F.struct("subject", "object"), F.struct("subject", "object"))
    return reduce(DataFrame.unionByName, met).groupBy("seed", "s", "predicate", "o").agg(first.alias("t")).select("seed", "t.subject", "predicate", "t.object")


def first_seen(rows: DataFrame, by: list[str], key: list[str], order: list) -> DataFrame:
    """Rows in order, each key's first one."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by, *key).orderBy(*order))).where("_n = 1").drop("_n")


def entities_of(found: DataFrame, query: str, limit: int = 5) -> DataFrame:
    """Subjects and objects of found triplets (query, rank, subject, object) in order of their first appearance."""
    both = found.select(query, "rank", F.posexplode(F.array("subject", "object")).alias("side", "entity")).where("entity != ''")
    once = first_seen(both, [query], ["entity"], ["rank", "side"])
    place = F.row_number().over(Window.partitionBy(query).orderBy("rank", "side"))
    return once.withColumn("place", place).where(F.col("place") <= limit).select(query, "place", "entity")


def all_pages(nodes: DataFrame, most: int = 20) -> DataFrame:
    """Where no model says which pages to read: the span of the first pages that the nodes (doc_id, start_index, end_index) of a tree cover, or the first five."""
    pages = F.when((F.col("start_index") > 0) & (F.col("end_index") >= F.col("start_index")), F.sequence("start_index", "end_index")).otherwise(F.array().cast("array<int>"))
    first = nodes.groupBy("doc_id").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(pages)))), 1, most).alias("p"))
    low, high = F.get("p", F.lit(0)).cast("string"), F.get("p", F.size("p") - 1).cast("string")
    return first.select("doc_id", F.when(F.size("p") == 0, "1-5").when(F.size("p") == 1, low).otherwise(F.concat(low, F.lit("-"), high)).alias("pages"), F.lit(0.3).alias("confidence"))


def tree_summary(nodes: DataFrame) -> DataFrame:
    """Nodes and depth of each document's tree (doc_id, position, level, depth)."""
    return nodes.groupBy("doc_id").agg(F.count("*").alias("n_nodes"), F.max("depth").alias("depth"), F.count(F.when(F.col("parent").isNull(), 1)).alias("n_roots"))


def page_cache(nodes: DataFrame) -> DataFrame:
    """Texts of a tree's nodes (doc_id, position, text) as numbered pages in order, without blank ones."""
    rows = nodes.where(F.length(F.trim("text")) > 0)
    return rows.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("position")).alias("page"), "position", F.col("text").alias("content"))
