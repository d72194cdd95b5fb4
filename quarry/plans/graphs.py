"""Entities, neighbourhoods and page trees: triplets come from who trades with whom and lies where."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import search as S
from ..operators import tables as B
from .base import query, read
from .retrieval import CENTROIDS, COSINE


def triplets(spark, sf_dir):
    """Nations in regions and suppliers in nations."""
    nation, region, supplier = (read(spark, sf_dir, t) for t in ("nation", "region", "supplier"))
    a = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("subject"), F.lit("in").alias("predicate"), F.col("r_name").alias("object"))
    b = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_name").alias("subject"), F.lit("from").alias("predicate"), F.col("n_name").alias("object"))
    return a.union(b)


TRIPLETS = """t AS (SELECT n_name AS subject, 'in' AS predicate, r_name AS object FROM nation JOIN region ON n_regionkey = r_regionkey
    UNION ALL SELECT s_name, 'from', n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


@query("""SELECT asked, name, rank FROM (SELECT r_name AS asked, name, row_number() OVER (PARTITION BY r_name ORDER BY name) AS rank FROM region JOIN (SELECT DISTINCT c_name || ' ' || r2.r_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region r2 ON n_regionkey = r2.r_regionkey) ON contains(lower(name), lower(r_name))) WHERE rank <= 5""")
def entity_search(spark, sf_dir):
    customer, nation, region = (read(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    names = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat_ws(" ", "c_name", "r_name").alias("name")).distinct()
    return G.find_entities(names, region.select(F.col("r_name").alias("asked")), 5)


HOPS = f"""{TRIPLETS}, e AS (SELECT subject AS a, object AS b FROM t UNION SELECT object, subject FROM t),
    h AS (SELECT DISTINCT r_name AS node, 0 AS depth FROM region UNION SELECT b, depth + 1 FROM h JOIN e ON node = a WHERE depth < 2),
    n AS (SELECT node, min(depth) AS depth FROM h GROUP BY node)"""


@query(f"WITH RECURSIVE {HOPS} SELECT * FROM n")
def khop(spark, sf_dir):
    seeds = read(spark, sf_dir, "region").select(F.col("r_name").alias("node"))
    return G.k_hop(seeds, triplets(spark, sf_dir), 2)


@query(f"WITH RECURSIVE {HOPS} SELECT DISTINCT 'Relation: ' || subject || ' -> ' || predicate || ' -> ' || object AS content FROM t WHERE subject IN (SELECT node FROM n) AND object IN (SELECT node FROM n)")
def graph_retrieval(spark, sf_dir):
    edges = triplets(spark, sf_dir)
    seeds = read(spark, sf_dir, "region").select(F.col("r_name").alias("node"))
    found = G.within(G.k_hop(seeds, edges, 2), edges)
    return found.select(F.concat(F.lit("Relation: "), F.concat_ws(" -> ", "subject", "predicate", "object")).alias("content")).distinct()


@query(f"WITH {TRIPLETS} SELECT DISTINCT name FROM (SELECT subject AS name FROM t UNION ALL SELECT object FROM t)")
def triplet_entities(spark, sf_dir):
    return B.entities(triplets(spark, sf_dir))


@query(f"""WITH {TRIPLETS}, old AS (SELECT DISTINCT subject, predicate, object FROM t WHERE predicate = 'in' OR subject LIKE '%1'),
    new AS (SELECT DISTINCT lower(subject) AS subject, predicate, object FROM t)
    SELECT * FROM old UNION ALL SELECT * FROM new n WHERE NOT EXISTS (SELECT 1 FROM old o WHERE lower(o.subject) = n.subject AND o.predicate = n.predicate AND lower(o.object) = lower(n.object))""")
def add_triplets(spark, sf_dir):
    """A load brings all triplets, its subjects in small letters, to some that are known."""
    t = triplets(spark, sf_dir)
    new = t.withColumn("subject", F.lower("subject"))
    return B.add_triplets(t.where("predicate = 'in' OR subject LIKE '%1'"), new.unionByName(new)).select("subject", "predicate", "object")


RANGES = "CAST(p_size AS VARCHAR) || '-' || CAST(p_size + p_partkey % 4 AS VARCHAR) || ', ' || CAST(p_size + 2 AS VARCHAR) || CASE WHEN p_partkey % 5 = 0 THEN ', 9-7' ELSE '' END"


@query(f"""WITH r AS (SELECT p_partkey, range(p_size, p_size + p_partkey % 4 + 1) AS x, p_size + 2 AS y FROM part)
    SELECT p_partkey, array_to_string(list_sort(list_distinct(list_append(x, y))), ',') AS pages FROM r""")
def page_ranges(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select("p_partkey", F.expr(RANGES.replace("VARCHAR", "STRING")).alias("pages"))
    return G.page_numbers(rows).select("p_partkey", F.array_join(F.transform("page_list", lambda x: x.cast("string")), ",").alias("pages"))


@query("""WITH p AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS page, unnest(string_split(text, chr(10))) AS content FROM documents)
    SELECT doc_id, string_agg('--- Page ' || page || ' ---' || chr(10) || content, chr(10) || chr(10) ORDER BY page) AS content, count(*) AS n_pages FROM p WHERE page IN (1, 2, 4) GROUP BY doc_id""")
def tree_pages(spark, sf_dir):
    """Lines stand for pages; every document is asked for pages 1-2 and 4."""
    docs = read(spark, sf_dir, "documents")
    pages = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("page", "content")).withColumn("page", F.col("page") + 1)
    asked = G.page_numbers(docs.select("doc_id", F.lit("1-2, 4").alias("pages")))
    return G.page_contents(asked, pages)


HEADS = "h AS (SELECT conv_id AS doc_id, turn AS position, CAST(1 + turn % 3 AS INTEGER) AS level FROM conversations)"
PARENTS = f"""{HEADS}, p AS (SELECT doc_id, position, level, (SELECT max(g.position) FROM h g WHERE g.doc_id = h.doc_id AND g.position < h.position AND g.level < h.level) AS parent FROM h),
    d AS (SELECT doc_id, position, level, parent, 1 AS depth FROM p WHERE parent IS NULL UNION ALL SELECT p.doc_id, p.position, p.level, p.parent, d.depth + 1 FROM p JOIN d ON p.doc_id = d.doc_id AND p.parent = d.position)"""


def headings(spark, sf_dir):
    """Turns stand for headings whose levels go round."""
    return read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("position"), (1 + F.col("turn") % 3).cast("int").alias("level"), "text")


@query(f"WITH RECURSIVE {PARENTS} SELECT doc_id, position, level, parent, depth FROM d")
def tree_parents(spark, sf_dir):
    return G.tree_of(headings(spark, sf_dir)).drop("text")


@query(f"WITH RECURSIVE {PARENTS} SELECT doc_id, count(*) AS n_nodes, max(depth) AS depth, count(*) FILTER (parent IS NULL) AS n_roots FROM d GROUP BY doc_id")
def tree_depth(spark, sf_dir):
    return G.tree_summary(G.tree_of(headings(spark, sf_dir)))


@query(f"""WITH {HEADS.replace("AS level", "AS level, text")} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY position) AS page, position, text AS content FROM h WHERE length(trim(text)) > 0""")
def tree_page_cache(spark, sf_dir):
    return G.page_cache(headings(spark, sf_dir))


@query(f"""WITH n AS (SELECT conv_id AS doc_id, CASE WHEN turn % 4 = 3 THEN 0 ELSE turn * 2 END AS a, turn * 2 + turn % 3 AS b FROM conversations),
    p AS (SELECT doc_id, list_sort(list_distinct(flatten(list(CASE WHEN a > 0 AND b >= a THEN range(a, b + 1) ELSE [] END))))[1:20] AS p FROM n GROUP BY doc_id)
    SELECT doc_id, CASE WHEN len(p) = 0 THEN '1-5' WHEN len(p) = 1 THEN CAST(p[1] AS VARCHAR) ELSE p[1] || '-' || p[len(p)] END AS pages, 0.3::DOUBLE AS confidence FROM p""")
def tree_all_pages(spark, sf_dir):
    """Turns stand for nodes that cover some pages; every fourth covers none."""
    start = F.when(F.col("turn") % 4 == 3, 0).otherwise(F.col("turn") * 2).cast("int")
    rows = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), start.alias("start_index"), (F.col("turn") * 2 + F.col("turn") % 3).cast("int").alias("end_index"))
    return G.all_pages(rows)


@query(r"""WITH m AS (SELECT doc_id, '# ' || replace(text, '. ', '.' || chr(10) || '## ') AS text FROM documents),
    l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS position FROM m)
    SELECT doc_id, position, CAST(length(regexp_extract(line, '^\s*(#{1,6})\s', 1)) AS INTEGER) AS level, trim(regexp_replace(line, '^\s*#{1,6}\s+', '')) AS title FROM l WHERE regexp_matches(line, '^\s*#{1,6}\s')""")
def markdown_headings(spark, sf_dir):
    """Headings of documents; a sentence's start stands for one."""
    text = F.concat(F.lit("# "), F.replace("text", F.lit(". "), F.lit(".\n## ")))
    return G.headings_of(read(spark, sf_dir, "documents").select("doc_id", text.alias("text")))


@query(f"""WITH {TRIPLETS}, e AS (SELECT DISTINCT lower(subject) AS s, predicate, lower(object) AS o, subject, object FROM t),
    n AS (SELECT s AS node, * FROM e UNION ALL SELECT o AS node, * FROM e WHERE s <> o),
    w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY s, predicate, o, subject, object) AS k FROM n) WHERE k <= 10),
    z AS (SELECT DISTINCT r_name AS seed FROM region),
    a AS (SELECT seed, s, predicate, o, subject, object FROM z JOIN w ON node = lower(seed)),
    f AS (SELECT * FROM (SELECT seed, node, row_number() OVER (PARTITION BY seed ORDER BY node) AS k FROM (SELECT DISTINCT seed, unnest([s, o]) AS node FROM a) WHERE node <> lower(seed)) WHERE k <= 20),
    b AS (SELECT seed, s, predicate, o, subject, object FROM f JOIN w USING (node))
    SELECT DISTINCT seed, subject, predicate, object FROM (SELECT * FROM a UNION ALL SELECT * FROM b)""")
def graph_capped(spark, sf_dir):
    """Two hops from each region over the triplets' first ten a node."""
    return G.neighbours(read(spark, sf_dir, "region").select(F.col("r_name").alias("seed")), triplets(spark, sf_dir).distinct(), 2)


@query(f"""WITH {CENTROIDS}, r AS (SELECT label, vec_id, s_name, n_name, row_number() OVER (PARTITION BY label ORDER BY {COSINE} DESC, vec_id) AS rank FROM pairs JOIN supplier ON s_suppkey = vec_id JOIN nation ON s_nationkey = n_nationkey), k AS (SELECT * FROM r WHERE rank <= 5),
    u AS (SELECT label, rank, unnest([0, 1]) AS side, unnest([s_name, n_name]) AS entity FROM k),
    o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label, entity ORDER BY rank, side) AS n FROM u) WHERE n = 1)
    SELECT label, place, entity FROM (SELECT label, entity, row_number() OVER (PARTITION BY label ORDER BY rank, side) AS place FROM o) WHERE place <= 5""")
def entity_vector(spark, sf_dir):
    """Entities of the triplets nearest to a tenant's query; a supplier's triplet has the vector of its number."""
    vectors, supplier, nation = (read(spark, sf_dir, t) for t in ("embeddings", "supplier", "nation"))
    named = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("vec_id"), F.col("s_name").alias("subject"), F.col("n_name").alias("object"))
    near = S.similar(S.centroids(vectors, "label"), vectors.join(named, "vec_id", "left_semi"), "label", 5)
    return G.entities_of(near.join(named, "vec_id").select("label", "rank", "subject", "object"), "label")
