"""Parsers of texts against their SQL, on texts whose ends trimming could change."""

import duckdb
import pytest

from quarry.plans.registry import ORACLES
from quarry.sources import parsers as P

# digits at the ends, as many as there are positions; blank lines; other white space than blanks; headers without a text
TEXTS = [
    "0 first 0\n1 second 1\n\n2 third 2\n# 3",
    "0\n\n1\n\n2\n\n00\n\n10",
    "  # head  \n   \n\u00a0\u3000body\u2003 \n\n \u1680 \n\n\u202f#\u00a0x\u205f\n#\n\n##  ",
    "\ttab\t\n\n\r\nline\r\n\u200bzero width\u200b\n\n\n\n\u2007",
    "",
    " ",
    "\n\n\n",
    None,
]


@pytest.fixture
def both(spark):
    """Rows of a parser and of a query's SQL over these texts."""
    rows = list(enumerate(TEXTS))
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)

    def run(parser, name):
        got, want = parser(spark.createDataFrame(rows, "doc_id long, text string")), con.sql(ORACLES[name])
        return sorted(map(tuple, got.select(*want.columns).collect())), sorted(want.fetchall())

    return run


def test_markdown_lines_are_trimmed_as_in_sql(both):
    got, want = both(P.markdown, "markdown_elements")
    assert got == want
    assert (0, 0, "paragraph", "0 first 0") in got


def test_paragraphs_are_trimmed_as_in_sql(both):
    got, want = both(P.paragraphs, "text_paragraphs")
    assert got == want
    assert [r[1:3] for r in got if r[0] == 1] == [("0", 0), ("00", 3), ("1", 1), ("10", 4), ("2", 2)]
