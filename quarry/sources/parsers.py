"""Parsers from raw content to elements and text, as columns and Arrow batches, and their registry by content type."""

from __future__ import annotations

import csv
import io
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.chunks import by_bytes

# fixed value: between the first and last row of a batch
DASH = "\u2013"

# fixed values: content types by file ending
ENDINGS = {"pdf": "application/pdf", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "doc": "application/msword", "html": "text/html", "htm": "text/html", "md": "text/markdown", "txt": "text/plain", "csv": "text/csv", "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "json": "application/json"}

# fixed value: what SQL's trim takes off, the characters of Unicode's category Zs
SPACES = " \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000"


def trimmed(text: Column) -> Column:
    """Text without the spaces at its ends. F.trim itself can't be handed to F.transform: it would take an element's index for the characters to take off."""
    return F.trim(text, F.lit(SPACES))


def content_type(declared: Column, name: Column) -> Column:
    """A known declared type, else that of the file's ending, else plain text."""
    table = F.create_map(*(F.lit(x) for kv in ENDINGS.items() for x in kv))
    ending = F.lower(F.regexp_extract(name, r"\.(\w+)$", 1))
    return F.coalesce(F.when(declared.isin(*ENDINGS.values()), declared), F.try_element_at(table, ending), F.lit("text/plain"))


def paragraphs(docs: DataFrame) -> DataFrame:
    """Plain text: paragraphs between blank lines."""
    rows = docs.select("doc_id", F.posexplode(F.filter(F.transform(F.split("text", "\n\n"), trimmed), lambda p: p != "")).alias("position", "content"))
    return rows.withColumn("element_type", F.lit("paragraph"))


def markdown(docs: DataFrame) -> DataFrame:
    """Markdown: each non-empty line is a header or a paragraph."""
    lines = F.filter(F.transform(F.split("text", "\n"), trimmed), lambda x: x != "")
    rows = docs.select("doc_id", F.posexplode(lines).alias("position", "line"))
    header = F.col("line").startswith("#")
    return rows.select("doc_id", "position", F.when(header, "header").otherwise("paragraph").alias("element_type"), F.when(header, F.regexp_replace("line", "^[# ]+", "")).otherwise(F.col("line")).alias("content"))


class _Elements(HTMLParser):
    """Headers, paragraphs, list items and table cells of a page, without scripts and styles."""

    KINDS = {**{f"h{i}": "header" for i in range(1, 7)}, "p": "paragraph", "li": "list_item", "td": "table", "th": "table", "title": "header"}

    def __init__(self):
        super().__init__()
        self.out: list[tuple[str, str]] = []
        self.kind, self.held, self.hidden = "paragraph", [], 0

    def flush(self):
        text = " ".join("".join(self.held).split())
        if text:
            self.out.append((self.kind, text))
        self.held, self.kind = [], "paragraph"

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.hidden += 1
        elif tag in self.KINDS or tag in ("div", "br", "tr", "ul", "table", "nav", "body"):
            self.flush()
            self.kind = self.KINDS.get(tag, "paragraph")

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif tag in self.KINDS or tag in ("div", "tr", "ul", "table", "nav", "body"):
            self.flush()

    def handle_data(self, data):
        if not self.hidden:
            self.held.append(data)


def html(pages: DataFrame) -> DataFrame:
    """page_id, position, element_type, content of raw pages."""

    def run(batches):
        for batch in (part for whole in batches for part in by_bytes(whole, 1)):
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parser = _Elements()
                parser.feed(text or "")
                parser.close()
                parser.flush()
                rows += [(i, k, kind, content) for k, (kind, content) in enumerate(parser.out)]
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["page_id", "position", "element_type", "content"])

    return pages.select("page_id", "html").mapInArrow(run, "page_id long, position int, element_type string, content string")


def element_class(text: Column) -> Column:
    """Class of a text block: short text in capitals, or whose words all begin with one and go on without, is a header."""
    title = text.rlike(r"\p{Lu}") & ~text.rlike(r"(^|[^\p{L}])\p{Ll}|\p{L}\p{Lu}")
    capitals = text.rlike(r"\p{Lu}") & ~text.rlike(r"\p{Ll}")
    return F.when((F.length(text) < 100) & (capitals | title), "header").when(text.contains("\t") | text.contains("   "), "table").otherwise("paragraph")


def repeated_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks without page furniture: texts at the edge of a page that stand on several pages of their document. Counts come first, then an anti-join."""
    often = blocks.where("at_edge").groupBy("doc_id", "content").agg(F.countDistinct("page").alias("pages")).where("pages > 1").select("doc_id", "content", F.lit(True).alias("at_edge"))
    return blocks.join(often, ["doc_id", "content", "at_edge"], "left_anti")


def markdown_tables(df: DataFrame, order: str, batch: int = 1000) -> DataFrame:
    """Rows as markdown tables of batch rows each: title, header, rule and rows, with pipes escaped. Batches number the rows in order within ranges of the key."""
    cell = lambda c: F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|"))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *(cell(c) for c in df.columns)), F.lit(" |"))
    rows = df.select(F.col(order).alias("_order"), line.alias("_line")).withColumn("_range", F.floor(F.col("_order") / (batch * 8)))
    sizes = rows.groupBy("_range").count().withColumn("_before", F.coalesce(F.sum("count").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    numbered = rows.withColumn("_in", F.row_number().over(Window.partitionBy("_range").orderBy("_order", "_line"))).join(sizes, "_range").withColumn("_n", F.col("_before") + F.col("_in") - 1)
    header = "| " + " | ".join(df.columns) + " |\n| " + " | ".join("---" for _ in df.columns) + " |"
    body = F.array_sort(F.collect_list(F.struct("_n", "_line")))
    parts = numbered.groupBy(F.floor(F.col("_n") / batch).alias("batch")).agg(body.alias("body"), (F.min("_n") + 1).alias("a"), (F.max("_n") + 1).alias("b"))
    content = F.concat(F.lit("## Rows "), F.col("a").cast("string"), F.lit(DASH), F.col("b").cast("string"), F.lit("\n\n" + header + "\n"), F.array_join(F.transform("body", lambda x: x["_line"]), "\n"))
    return parts.select("batch", content.alias("content"))


def csv_texts(files: DataFrame, batch: int = 1000) -> DataFrame:
    """doc_id, batch, n_rows, delimiter, content of delimited texts as markdown tables: the delimiter is guessed from the first 2000 characters, short rows are padded, and batch -1 is the summary."""

    def table(header: list[str], rows: list[list[str]]) -> str:
        lines = [[c.replace("|", "\\|") for c in (r + [""] * len(header))[: len(header)]] for r in rows]
        return "\n".join("| " + " | ".join(x) + " |" for x in [header, ["---"] * len(header), *lines])

    def read(text: str) -> list[tuple]:
        try:
            mark = csv.Sniffer().sniff(text[:2000], delimiters=",\t;|").delimiter
        except csv.Error:
            mark = ","
        rows = list(csv.reader(io.StringIO(text), delimiter=mark))
        if not rows:
            return []
        header, rest = rows[0], rows[1:]
        starts = range(0, len(rest), batch)
        summary = f"# CSV Data Summary\n\n- **Total Rows:** {len(rest)}\n- **Columns ({len(header)}):** {', '.join(header)}\n- **Chunks:** {len(starts)} (batch size: {batch})\n\n"
        parts = [(i // batch, f"## Rows {i + 1}{DASH}{min(i + batch, len(rest))}\n\n{table(header, rest[i : i + batch])}") for i in starts]
        return [(k, len(rest), mark, content) for k, content in [(-1, summary), *parts]]

    def run(batches):
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string())
        for whole in batches:
            for i in range(whole.num_rows):
                one = whole.slice(i, 1)
                found = [(one.column(0)[0].as_py(), *r) for r in read(one.column(1)[0].as_py() or "")]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, t in enumerate(kinds)], names=["doc_id", "batch", "n_rows", "delimiter", "content"])

    return files.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, batch int, n_rows long, delimiter string, content string")


#: Parser of each content type; the last registration wins.
PARSERS = {"text/plain": paragraphs, "text/markdown": markdown, "text/html": html}


def register(kind: str, parser) -> None:
    PARSERS[kind] = parser


def parser(kind: str):
    if kind not in PARSERS:
        raise ValueError(f"no parser for {kind}")
    return PARSERS[kind]
