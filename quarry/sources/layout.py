"""Elements of laid-out pages: boxes of text by their place, without page furniture."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .parsers import element_class

#: Share of a page's height, at its top and its bottom, where furniture stands.
BAND = 0.08
# fixed values: ligatures as letters
LIGATURES = {"ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}
# fixed values: what is furniture wherever it stands
FURNITURE = (r"^\d+$", r"^Page \d+$", r"^Page \d+ of \d+$", "CONFIDENTIAL", "DO NOT DISCLOSE", "INTERNAL USE ONLY")


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|(?U)\s+$", "")


def plain(text: Column) -> Column:
    """Ligatures as letters, words without hyphens at line ends, single spaces."""
    text = reduce(lambda t, x: F.replace(t, F.lit(x[0]), F.lit(x[1])), LIGATURES.items(), text)
    text = F.regexp_replace(text, r"(?U)(\w)-\s*\n\s*(\w)", "$1$2")
    return stripped(F.regexp_replace(text, r"(?U)\s+", " "))


def at_edge(y: Column, height: Column) -> Column:
    return (y < height * BAND) | (y > height * (1 - BAND))


def elements(boxes: DataFrame) -> DataFrame:
    """doc_id, position, page, element_type, content of boxes (doc_id, page, height, x0, y0, block, content), in reading order: by page, from top to bottom, then from left to right. A first pass counts the texts at the edges of a document's pages; those that stand there more than once go, and so does what is furniture by its words. Null and blank boxes have no element."""
    rows = boxes.withColumn("raw", stripped(F.col("content"))).where("raw != ''").withColumn("edge", at_edge(F.col("y0"), F.col("height")))
    often = rows.where("edge").groupBy("doc_id", "raw").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", F.col("raw").alias("content"), F.lit(True).alias("edge"))
    rows = rows.withColumn("content", plain(F.col("raw"))).where(~F.col("content").rlike("(?i)" + "|".join(FURNITURE)) & (F.col("content") != ""))
    kept = rows.join(often, ["doc_id", "content", "edge"], "left_anti")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "y0", "x0", "block")) - 1
    return kept.select("doc_id", place.alias("position"), "page", element_class(F.col("content")).alias("element_type"), "content")


def titles(found: DataFrame, name: Column) -> DataFrame:
    """doc_id and title of documents' elements: the first header, else the name."""
    first = F.min(F.when(F.col("element_type") == "header", F.struct("position", "content")))
    return found.groupBy("doc_id").agg(first.alias("first")).select("doc_id", F.coalesce("first.content", name).alias("title"))
