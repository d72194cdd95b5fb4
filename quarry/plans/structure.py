"""Layouts, nested trees, table functions and observed stages over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunks as C
from ..operators import graph as G
from ..operators import tablefns, trees
from ..sources import layout as L
from ..sources.stored import stored
from ..streaming.observed import Stages
from .base import query, read
from .graphs import PARENTS, headings
from .texts import CLEANED, WORDS

# every text between two tags is a box: twelve to a page, in two columns
BOXES = r"""t AS (SELECT page_id AS doc_id, list_filter(list_transform(string_split(regexp_replace(html, '<[^>]*>', chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS parts FROM pages),
    u AS (SELECT doc_id, unnest(parts) AS raw, generate_subscripts(parts, 1) - 1 AS i FROM t),
    b AS (SELECT doc_id, i // 12 + 1 AS page, CASE WHEN i % 2 = 0 THEN 300 ELSE 50 END AS x0, (i % 12 // 2) * 150 AS y0, i AS block, raw, (i % 12 // 2) * 150 < 64 OR (i % 12 // 2) * 150 > 736 AS edge FROM u)"""
HEADER = r"length(content) < 100 AND regexp_matches(content, '\p{Lu}') AND (NOT regexp_matches(content, '\p{Ll}') OR NOT regexp_matches(content, '(^|[^\p{L}])\p{Ll}|\p{L}\p{Lu}'))"


def boxes(spark, sf_dir):
    parts = F.filter(F.transform(F.split(F.regexp_replace("html", "<[^>]*>", "\x01"), "\x01"), lambda x: L.stripped(x)), lambda x: x != "")
    rows = read(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.posexplode(parts).alias("block", "content"))
    slot = F.floor((F.col("block") % 12) / 2)
    return rows.withColumns({"page": F.floor(F.col("block") / 12) + 1, "height": F.lit(800), "x0": F.when(F.col("block") % 2 == 0, 300).otherwise(50), "y0": slot * 150})


@query(rf"""WITH {BOXES}, often AS (SELECT doc_id, raw FROM b WHERE edge GROUP BY doc_id, raw HAVING count(*) > 1),
    c AS (SELECT *, trim(regexp_replace(regexp_replace(raw, '(\w)-\s*\n\s*(\w)', '\1\2', 'g'), '\s+', ' ', 'g')) AS content FROM b),
    k AS (SELECT * FROM c WHERE NOT regexp_matches(content, '(?i)^\d+$|^Page \d+$|^Page \d+ of \d+$|CONFIDENTIAL|DO NOT DISCLOSE|INTERNAL USE ONLY') AND NOT (edge AND EXISTS (SELECT 1 FROM often o WHERE o.doc_id = c.doc_id AND o.raw = c.content)))
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page, y0, x0, block) - 1 AS position, page, CASE WHEN {HEADER} THEN 'header' ELSE 'paragraph' END AS element_type, content FROM k""")
def page_layout(spark, sf_dir):
    """Elements of laid-out pages; the texts between a web page's tags stand for boxes."""
    return L.elements(boxes(spark, sf_dir))


@query(f"""WITH RECURSIVE {PARENTS}, s AS (SELECT d.doc_id, d.position, d.parent, d.level, d.depth, row_number() OVER (PARTITION BY d.doc_id, d.parent ORDER BY d.position) - 1 AS place FROM d),
    x AS (SELECT doc_id, position, level, CAST(place AS VARCHAR) AS path FROM s WHERE parent IS NULL UNION ALL SELECT s.doc_id, s.position, s.level, x.path || '.' || s.place FROM s JOIN x ON x.doc_id = s.doc_id AND x.position = s.parent),
    f AS (SELECT doc_id, path, position, level, text FROM x JOIN (SELECT conv_id AS doc_id, turn AS position, text FROM conversations) USING (doc_id, position))
    SELECT doc_id, path, 'level' AS field, CAST(level AS VARCHAR) AS value FROM f UNION ALL SELECT doc_id, path, 'position', CAST(position AS VARCHAR) FROM f UNION ALL SELECT doc_id, path, 'n_chars', CAST(length(text) AS VARCHAR) FROM f""")
def tree_without_text(spark, sf_dir):
    """Trees of headings as nested JSON, without their texts, walked through again: each node's fields by its path."""
    nodes = G.tree_of(headings(spark, sf_dir)).withColumn("n_chars", F.length("text"))
    json = trees.nested(nodes, ["position", "level", "n_chars", "text"])
    rows = trees.fields_of(trees.without(json, ["text"]))
    return rows.select("doc_id", F.array_join(F.transform("path", lambda p: p.cast("string")), ".").alias("path"), "field", "value")


HEAD = "'[Document: ' || source || '] [Section: ' || lang || ' > ' || (doc_id % 7) || ']' || chr(10)"


@query(f"""WITH w AS (SELECT doc_id, {WORDS} AS words, {HEAD} AS head FROM documents),
    s AS (SELECT doc_id, words, head, unnest(range(0, greatest(len(words) - 49, 0) + 1, 336)) AS start FROM w WHERE len(words) > 0)
    SELECT doc_id, CAST(start // 336 AS INTEGER) AS chunk_index, start, len(words[start + 1:start + 384]) AS n_words, CAST(floor(len(words[start + 1:start + 384]) * 1.3) AS INTEGER) AS token_count,
    md5(head || array_to_string(words[start + 1:start + 384], ' ')) AS content_md5 FROM s""")
def chunk_prefixed(spark, sf_dir):
    """Chunks behind title and headings, as the dispatch passes them on; a document's source and language stand for these."""
    path = F.array("lang", (F.col("doc_id") % 7).cast("string"))
    rows = C.chunked(read(spark, sf_dir, "documents"), "fixed", title=F.col("source"), headings=path)
    return rows.withColumn("content_md5", F.md5("content")).drop("content")


@query(f"""WITH w AS (SELECT doc_id, {WORDS} AS words, {HEAD} AS head FROM documents),
    s AS (SELECT doc_id, words, head, unnest(range(0, greatest(len(words) - 49, 0) + 1, 336)) AS start FROM w WHERE len(words) > 0)
    SELECT doc_id, start // 336 AS chunk_index, CAST(floor(len(words[start + 1:start + 384]) * 1.3) AS INTEGER) AS token_count, md5(head || array_to_string(words[start + 1:start + 384], ' ')) AS content_md5 FROM s""")
def chunk_function(spark, sf_dir):
    """The same by a table function in SQL."""
    tablefns.register(spark)
    read(spark, sf_dir, "documents").createOrReplaceTempView("chunk_documents")
    return spark.sql("""SELECT d.doc_id, c.chunk_index, c.token_count, md5(c.content) AS content_md5
        FROM chunk_documents d, LATERAL chunk(text => d.text, strategy => 'fixed', title => d.source, headings => array(d.lang, CAST(d.doc_id % 7 AS STRING))) c""")


@query(f"""WITH {CLEANED} SELECT 'original' AS stage, count(*) AS n_rows, count(*) - count(original) AS n_nulls, sum(length(original)) AS n_chars FROM b
    UNION ALL SELECT 'white space', count(*), count(*) - count(white), sum(length(white)) FROM a
    UNION ALL SELECT 'furniture', count(*), count(*) - count(text), sum(length(text)) FROM b
    UNION ALL SELECT 'personal data', count(*), count(*) - count(clean), sum(length(clean)) FROM b""")
def observed_cleaning(spark, sf_dir):
    """What each stage of the cleaning holds, observed while the cleaned texts are written."""
    stages = Stages()
    rows = stages.mark(read(spark, sf_dir, "documents").select("doc_id", "text"), "original", "text")
    rows = stages.mark(rows.withColumn("text", T.clean_whitespace(T.plain_marks(F.col("text")))), "white space", "text")
    rows = stages.mark(rows.withColumn("text", F.array_join(T.kept_lines("text"), "\n")), "furniture", "text")
    rows = stages.mark(rows.withColumn("text", F.regexp_replace(T.redact(F.col("text")), r"^\s+|\s+$", "")), "personal data", "text")
    stored(rows, "cleaned")
    return stages.rows(spark)
