"""Column functions over text: words, cleaning, personal data, rails."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import lists

C = Column | str


def strings(words) -> Column:
    return F.array(*map(F.lit, words))


def split_words(text: C) -> Column:
    """Runs of what isn't white space."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def sparse_tokens(text: C, stop=None) -> Column:
    """Lower-case alphanumeric runs of the whole text, without stop words and numbers."""
    stop = strings(lists.SPARSE_STOP) if stop is None else stop
    return F.filter(F.split(F.lower(text), r"(?U)\W+"), lambda t: (t != "") & ~F.array_contains(stop, t) & ~t.rlike(r"^\d+$"))


def sparse_words(docs: DataFrame, *keys: str) -> DataFrame:
    """The keys and each sparse token of the whole text, in a row of its own; stop words go row by row, by a hash lookup."""
    words = docs.select(*keys, F.explode(F.split(F.lower("text"), r"(?U)\W+")).alias("token"))
    return words.where(~F.col("token").isin("", *lists.SPARSE_STOP) & ~F.col("token").rlike(r"^\d+$"))


def stop_words(lang: Column) -> Column:
    """The stop words of a language; those of English where there is no list."""
    table = F.create_map(*(x for k, words in lists.STOP_BY_LANG.items() for x in (F.lit(k), strings(words))))
    return F.coalesce(F.try_element_at(table, lang), strings(lists.SPARSE_STOP))


def token_id(token: C) -> Column:
    """The first eight bytes of the token's SHA-256, modulo a prime."""
    return (F.conv(F.substring(F.sha2(token, 256), 1, 16), 16, 10).cast("decimal(20,0)") % F.lit(1_000_000_007)).cast("long")


def content_words(text: C) -> Column:
    """Distinct whole words of three letters a-z and more, without stop words."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)(\w+)"), F.lit(1))
    return F.array_except(F.array_distinct(F.filter(words, lambda w: w.rlike("^[a-z]{3,}$"))), strings(lists.CONTENT_STOP))


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode's compatibility composition."""
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def composed(text: C) -> Column:
    """The same as nfkc, where only texts with characters beyond ASCII leave the JVM: all others are composed as they are."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(nfkc(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def plain_marks(text: Column) -> Column:
    """Quotes, dashes, ellipsis and invisible characters in ASCII."""
    return reduce(lambda t, x: F.replace(t, F.lit(x[0]), F.lit(x[1])), lists.QUOTES.items(), text)


def clean_whitespace(text: Column, most_newlines: int = 3) -> Column:
    """No white space before line ends, single spaces within lines, few empty lines in a row."""
    text = F.regexp_replace(text, r"[^\S\n]+(?=\n|$)", "")
    text = F.regexp_replace(text, r" {2,}", " ")
    return F.regexp_replace(text, r"\n{%d,}" % (most_newlines + 1), "\n" * most_newlines)


#: A line of page furniture: a page number, one of three words, or at most one character that ends no sentence.
FURNITURE = r"(?is)^\s*(?:(?:Page )?\d+(?: of \d+)?|confidential|draft|internal|[^.!?:;,\s]?)\s*$"


def kept_lines(text: C) -> Column:
    """Lines that are neither page numbers nor page furniture; one pattern a line."""
    return F.filter(F.split(text, "\n"), lambda line: ~line.rlike(FURNITURE))


def clean_urls(text: C) -> Column:
    """Without tracking parameters."""
    return F.regexp_replace(text, r"(?i)(https?://[^\s]+?)(?:[?&](?:utm_\w+|fbclid|gclid|ref)=[^\s&]*)+", "$1")


def java(pattern: str) -> str:
    """Word characters and boundaries by Unicode, whatever the Java version."""
    return "(?U)" + pattern


def pii_count(text: C, kind: str) -> Column:
    return F.regexp_count(text, F.lit(java(lists.PII[kind])))


#: Kinds that no text without a digit has.
WITH_DIGITS = {"ssn", "phone_us", "passport", "date_of_birth", "drivers_license", "medical_record", "credit_card", "iban", "ip_address", "aws_arn"}


def redact(text: Column) -> Column:
    """Personal data replaced, one kind after the other; texts without digits meet only the patterns that need none."""
    chain = lambda kinds: reduce(lambda t, k: F.regexp_replace(t, java(lists.PII[k]), f"[REDACTED_{k.upper()}]"), kinds, text)
    return F.when(text.rlike(r"(?U)\d"), chain(lists.PII)).otherwise(chain([k for k in lists.PII if k not in WITH_DIGITS]))


def pii_kinds(text: C) -> Column:
    """Kinds of personal data in the text, in their order."""
    return F.filter(F.array(*(F.when(F.col(text).rlike(java(p)) if isinstance(text, str) else text.rlike(java(p)), k) for k, p in lists.PII.items())), lambda k: k.isNotNull())


def cache_key(team: Column, namespace: Column, key: Column) -> Column:
    """What a cached value is stored under: teams and namespaces never meet."""
    return F.sha2(F.concat_ws(":", team, namespace, key), 256)


def query_key(query: Column) -> Column:
    """A short key of a query, whatever its case and the white space around it."""
    return F.substring(F.sha2(F.lower(F.regexp_replace(query, r"^\s+|\s+$", "")), 256), 1, 16)


def any_of(text: Column, patterns, flags: str = "(?i)") -> Column:
    return reduce(lambda a, b: a | b, (text.rlike(flags + p) for p in patterns))


def rail(query: Column, namespace: Column | None = None, allowed=()) -> Column:
    """Why a query is blocked, or null."""
    size = F.length(F.trim(query))
    why = F.when(size < 3, "too_short").when(size > 2000, "too_long").when(any_of(query, lists.INJECTION), "injection")
    return why.when(~namespace.isin(*allowed), "namespace") if allowed and namespace is not None else why


def gated(answer: Column, confidence: Column, least: float = 0.3) -> Column:
    """An answer behind a warning with its mean confidence where that is low, or what is said where there are no sources (null)."""
    share = F.format_string("%.0f%%", F.coalesce(confidence, F.lit(0.0)) * 100)
    warned = F.concat(F.lit(lists.LOW_CONFIDENCE[0]), share, F.lit(lists.LOW_CONFIDENCE[1]), answer, F.lit(lists.LOW_CONFIDENCE[2]))
    return F.when(confidence.isNull(), F.lit(lists.NO_SOURCES)).when(confidence < least, warned).otherwise(answer)


#: Output rails by name; each is a function of the answer and its confidence.
RAILS = {
    "response_length": lambda a, c: F.when(F.length(a) > 10_000, F.concat(F.substring(a, 1, 10_000), F.lit("\n\n[Response truncated]"))).otherwise(a),
    "confidence_gate": gated,
    "output_pii_redaction": lambda a, c: redact(a),
    "blocked_pattern": lambda a, c: reduce(lambda t, p: F.regexp_replace(t, "(?i)" + p, "[REDACTED]"), lists.LEAKS, a),
}


def railed(rows, answer: str, confidence: Column, rails=tuple(RAILS)):
    """rows with the answer column behind the output rails of these names, in this order; one projection each."""
    for name in rails:
        rows = rows.withColumn(answer, RAILS[name](F.col(answer), confidence))
    return rows


def sql_refusal(query: Column) -> Column:
    """Why a read-only SQL tool refuses a statement, or null."""
    first = F.upper(F.regexp_extract(query, r"^[(\s]*(\w*)", 1))
    words = r"(?i)\b(" + "|".join(lists.WRITES) + r")\b"
    return F.when(~first.isin(*lists.READS), "not_a_read").when(query.rlike(words), "blocked_word").when(any_of(query, lists.UNSAFE_SQL, ""), "unsafe_pattern")


def complexity(query: Column) -> Column:
    words = split_words(F.lower(query))
    hop, why = (F.arrays_overlap(words, strings(w)) for w in (lists.MULTI_HOP, lists.INVOLVED))
    return F.when((F.size(words) > 30) | hop, "complex").when((F.size(words) < 8) & ~why, "simple").otherwise("moderate")


def complexity_by_length(query: Column) -> Column:
    """The rule of hosted models: by characters alone."""
    return F.when(F.length(query) < 50, "simple").when(F.length(query) < 200, "moderate").otherwise("complex")


def unwrapped(text: Column) -> Column:
    """Text of a page layout: ligatures, words broken at line ends and white space in order."""
    plain = reduce(lambda t, x: F.replace(t, F.lit(x[0]), F.lit(x[1])), lists.LIGATURES.items(), text)
    joined = F.regexp_replace(plain, r"(?U)(\w)-\s*\n\s*(\w)", "$1$2")
    return F.regexp_replace(F.regexp_replace(joined, r"(?U)\s+", " "), r"^ | $", "")


def boilerplate(text: Column) -> Column:
    """Whether a block says by itself that it is page furniture."""
    return any_of(text, lists.BOILERPLATE)


def query_class(query: Column) -> Column:
    low = F.lower(query)
    structured = F.size(F.array_intersect(F.array_distinct(split_words(low)), strings(lists.STRUCTURED)))
    factual = reduce(lambda a, b: a + b, (low.contains(k).cast("int") for k in lists.FACTUAL))
    return F.when(structured > factual, "structured").when(factual > structured, "factual").otherwise("complex")


def path(mode: Column, target: Column, tree: Column, vectors: Column, kind: Column) -> Column:
    """Retrieval path of a request."""
    explicit = F.when(mode == "pageindex", "pageindex").when(mode.isin("vector", "rag"), "vector").when(mode == "hybrid", "hybrid")
    both = F.when(kind == "structured", "pageindex").when(kind == "factual", "vector").otherwise("hybrid")
    return explicit.when(target.isNull() | ~tree, "vector").when(~vectors, "pageindex").otherwise(both)


def path_confidence(mode: Column, target: Column, tree: Column, vectors: Column, kind: Column) -> Column:
    """How sure the choice of path() is."""
    tree, vectors = F.coalesce(tree, F.lit(False)), F.coalesce(vectors, F.lit(False))
    both = F.when(kind == "structured", 0.8).when(kind == "factual", 0.7).otherwise(0.6)
    return F.when(mode.isin("pageindex", "vector", "rag", "hybrid"), 1.0).when(target.isNull(), 0.9).when(tree & ~vectors, 0.9).when(tree & vectors, both).otherwise(0.7)
