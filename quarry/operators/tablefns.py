"""Chunkers as table functions for SQL.

chunk(text, strategy, title, headings) goes beside a table by LATERAL and gives the chunks of each text by the strategy, behind the
prefix of title and headings; its columns depend on the strategy. gather(TABLE(sentences) PARTITION BY doc_id ORDER BY position)
gathers a document's sentences into spans as they come. An unknown strategy is recursive, and five headings at most are passed on.
Defined cases: null texts are empty; null titles and headings give no prefix.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from . import chunks as C

#: Headings that a chunker gets, at most.
HEADINGS = 5
PLACES = StructType().add("chunk_index", IntegerType()).add("start_char", IntegerType()).add("end_char", IntegerType())
#: Columns of each strategy's chunks.
COLUMNS = {
    "fixed": StructType().add("chunk_index", IntegerType()).add("start", IntegerType()).add("n_words", IntegerType()),
    "recursive": PLACES,
    "structure_aware": StructType([*PLACES.fields]).add("section", StringType()),
    "hierarchical": StructType([*PLACES.fields]).add("level", StringType()).add("parent_index", IntegerType()).add("breadcrumb", StringType()),
    "late": StructType().add("chunk_index", IntegerType()).add("n_words", IntegerType()),
}


def prefix(title: str | None, headings: list[str] | None) -> str:
    path = " > ".join((headings or [])[:HEADINGS])
    return " ".join(f"[{name}: {value}]" for name, value in (("Document", title), ("Section", path)) if value)


def behind(head: str, content: str) -> str:
    return f"{head}\n{content}" if head else content


def chunks_of(text: str, strategy: str, title: str | None, headings: list[str] | None):
    """Rows of a strategy's columns, tokens and content."""
    head = prefix(title, headings)
    if strategy == "fixed":
        words = text.split()
        starts = range(0, max(len(words) - C.OVERLAP - 1, 0) + 1, C.SIZE - C.OVERLAP) if words else ()
        for i, a in enumerate(starts):
            part = words[a : a + C.SIZE]
            yield i, a, len(part), int(len(part) * 1.3), behind(head, " ".join(part))
    elif strategy == "structure_aware":
        for i, (path, a, b, n, content) in enumerate(C.structured(text, title or "")):
            yield i, a, b, path, n, content
    elif strategy == "hierarchical":
        for i, (level, parent, crumb, a, b, content) in enumerate(C.nested(text, title or "")):
            yield i, a, b, level, parent, crumb, (b - a) // 4, content
    elif strategy == "late":
        for i, (n, content) in enumerate(C.spans(text)):
            yield i, n, int(n * 1.3), behind(head, content)
    else:
        for i, (a, b, n, content) in enumerate(C.placed(text)):
            yield i, a, b, n, behind(head, content)


@dataclass
class Chosen(AnalyzeResult):
    strategy: str = "recursive"


class Chunk:
    def __init__(self, chosen: Chosen):
        self.strategy = chosen.strategy

    @staticmethod
    def analyze(text: AnalyzeArgument, strategy: AnalyzeArgument | None = None, title: AnalyzeArgument | None = None, headings: AnalyzeArgument | None = None) -> Chosen:
        if strategy is not None and not strategy.isConstantExpression:
            raise ValueError("the strategy must be a constant: a chunk's columns depend on it")
        name = strategy.value if strategy is not None and strategy.value in COLUMNS else "recursive"
        return Chosen(StructType([*COLUMNS[name].fields]).add("token_count", IntegerType()).add("content", StringType()), strategy=name)

    def eval(self, text, strategy=None, title=None, headings=None):
        yield from chunks_of(text or "", self.strategy, title, headings)


class Gather:
    """Spans of 256 words and more of sentences in order; a rest of fewer than 64 goes."""

    def __init__(self):
        self.doc, self.held, self.n, self.spans = None, [], 0, 0

    def _span(self):
        row = (self.doc, self.spans, self.n, " ".join(self.held))
        self.held, n = [], self.n
        self.n, self.spans = 0, self.spans + (n >= 64)
        return row if n >= 64 else None

    def eval(self, row):
        self.doc = row["doc_id"]
        self.held.append(row["sentence"])
        self.n += len(row["sentence"].split())
        if self.n >= 256 and (found := self._span()):
            yield found

    def terminate(self):
        if self.held and (found := self._span()):
            yield found


def register(spark: SparkSession) -> None:
    """chunk and gather, by these names in SQL."""
    spark.udtf.register("chunk", udtf(Chunk))
    spark.udtf.register("gather", udtf(Gather, returnType="doc_id long, chunk_index int, n_words int, content string"))
