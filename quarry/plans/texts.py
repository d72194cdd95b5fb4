"""Cleaning, personal data, rails, chunking and parsing over whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import lists
from ..functions import text as T
from ..operators import chunks as C
from ..sources import parsers as P
from .base import query, read


def docs(spark, sf_dir):
    return read(spark, sf_dir, "documents")


def duck(pattern: str) -> tuple[str, str]:
    """Pattern and options for DuckDB."""
    return (pattern[4:], "i") if pattern.startswith("(?i)") else (pattern, "c")


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def counted(kind: str) -> str:
    pattern, how = duck(lists.PII[kind])
    return f"len(regexp_extract_all(text, {literal(pattern)}, 0, '{how}'))"


REDACTED = "text"
for _kind in lists.PII:
    _pattern, _how = duck(lists.PII[_kind])
    REDACTED = f"regexp_replace({REDACTED}, {literal(_pattern)}, '[REDACTED_{_kind.upper()}]', 'g{_how}')"


@query(f"SELECT doc_id, {', '.join(f'{counted(k)} AS n_{k}' for k in lists.PII)} FROM documents")
def pii_counts(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", *(T.pii_count("text", k).alias(f"n_{k}") for k in lists.PII))


@query(f"SELECT doc_id, sha256({REDACTED}) AS redacted_sha256, length({REDACTED}) AS n_redacted_chars FROM documents")
def pii_redact(spark, sf_dir):
    redacted = T.redact(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", F.sha2(redacted, 256).alias("redacted_sha256"), F.length(redacted).alias("n_redacted_chars"))


def _flag(kind: str) -> str:
    pattern, how = duck(lists.PII[kind])
    return f"CASE WHEN regexp_matches(text, {literal(pattern)}, '{how}') THEN '{kind}' END"


@query(f"SELECT conv_id, turn, list_aggregate(list_filter([{', '.join(map(_flag, lists.PII))}], lambda k: k IS NOT NULL), 'string_agg', ',') AS kinds FROM conversations WHERE role = 'user'")
def pii_flags(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").where("role = 'user'")
    kinds = F.array_join(T.pii_kinds("text"), ",")
    return rows.select("conv_id", "turn", F.when(kinds != "", kinds).alias("kinds"))


WHITE = r"regexp_replace(regexp_replace(regexp_replace(text, '[ \t\r\f\v]+(\n|$)', '\1', 'g'), ' {2,}', ' ', 'g'), '\n{4,}', chr(10) || chr(10) || chr(10), 'g')"


@query(f"SELECT doc_id, sha256({WHITE}) AS clean_sha256, length({WHITE}) AS n_clean_chars FROM documents")
def clean_whitespace(spark, sf_dir):
    clean = T.clean_whitespace(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", F.sha2(clean, 256).alias("clean_sha256"), F.length(clean).alias("n_clean_chars"))


def kept(text: str) -> str:
    s = r"regexp_replace(l, '^\s+|\s+$', '', 'g')"
    return rf"""list_filter(string_split({text}, chr(10)), lambda l: NOT (regexp_full_match({s}, '\s*(Page )?\d+( of \d+)?\s*', 'i') OR regexp_full_match({s}, '\d{{1,5}}'))
        AND (NOT (length({s}) < 2 OR lower({s}) IN ('confidential', 'draft', 'internal') OR regexp_full_match({s}, '\d+')) OR regexp_matches({s}, '[.!?:;,]$')))"""


@query(f"SELECT doc_id, len({kept('text')}) AS n_kept, len(string_split(text, chr(10))) - len({kept('text')}) AS n_stripped, md5(array_to_string({kept('text')}, chr(10))) AS clean_md5 FROM documents")
def clean_headers(spark, sf_dir):
    lines = T.kept_lines("text")
    return docs(spark, sf_dir).select("doc_id", F.size(lines).alias("n_kept"), (F.size(F.split("text", "\n")) - F.size(lines)).alias("n_stripped"), F.md5(F.array_join(lines, "\n")).alias("clean_md5"))


def cleaned(docs, text):
    """docs with clean: marks, white space, page furniture and personal data of an NFKC text in order; one projection a stage, so that none is computed twice. before: the text that personal data was looked for in; stripped: lines that went."""
    rows = docs.withColumn("_lines", T.clean_whitespace(T.plain_marks(text)))
    rows = rows.withColumn("_kept", T.kept_lines("_lines"))
    rows = rows.withColumn("before", F.array_join("_kept", "\n")).withColumn("stripped", F.size(F.split("_lines", "\n")) - F.size("_kept"))
    return rows.withColumn("clean", F.regexp_replace(T.redact(F.col("before")), r"^\s+|\s+$", "")).drop("_lines", "_kept")


CLEANED = f"""a AS (SELECT doc_id, text AS original, {WHITE} AS white FROM documents),
    k AS (SELECT doc_id, original, len(string_split(white, chr(10))) AS n_lines, {kept("white")} AS kept FROM a),
    l AS (SELECT doc_id, original, n_lines - len(kept) AS stripped, array_to_string(kept, chr(10)) AS text FROM k),
    b AS (SELECT doc_id, original, stripped, text, regexp_replace({REDACTED}, '^\\s+|\\s+$', '', 'g') AS clean FROM l)"""


@query(f"WITH {CLEANED} SELECT doc_id, length(original) AS n_original, length(clean) AS n_clean, md5(clean) AS clean_md5 FROM b")
def clean_pipeline(spark, sf_dir):
    """cleaned() over documents; SQL has neither NFKC nor marks, which no document of the test tables needs."""
    rows = cleaned(docs(spark, sf_dir), T.composed("text"))
    return rows.select("doc_id", F.length("text").alias("n_original"), F.length("clean").alias("n_clean"), F.md5("clean").alias("clean_md5"))


@query(f"""WITH {CLEANED} SELECT doc_id, {' + '.join(map(counted, lists.PII))} AS n_pii, array_to_string(list_filter([{', '.join(f"CASE WHEN {counted(k)} > 0 THEN '{k}' END" for k in lists.PII)}], lambda k: k IS NOT NULL), ',') AS pii_types,
    'unicode_normalization,whitespace_normalization,header_footer_strip,pii_redaction' AS stages, CASE WHEN stripped > 0 THEN 'Stripped ' || stripped || ' header/footer lines' ELSE '' END AS warnings FROM b""")
def clean_audit(spark, sf_dir):
    """What the cleaning found and did: personal data before it was redacted, stages and warnings."""
    rows = cleaned(docs(spark, sf_dir), T.composed("text"))
    counts = [T.pii_count("before", k) for k in lists.PII]
    kinds = F.array_join(F.array_compact(F.array(*(F.when(c > 0, k) for k, c in zip(lists.PII, counts, strict=True)))), ",")
    warning = F.when(F.col("stripped") > 0, F.concat(F.lit("Stripped "), F.col("stripped").cast("string"), F.lit(" header/footer lines"))).otherwise("")
    stages = F.lit("unicode_normalization,whitespace_normalization,header_footer_strip,pii_redaction")
    return rows.select("doc_id", reduce(lambda a, b: a + b, counts).alias("n_pii"), kinds.alias("pii_types"), stages.alias("stages"), warning.alias("warnings"))


@query()
def clean_nfkc(spark, sf_dir):
    plain = T.plain_marks(T.composed("text"))
    return docs(spark, sf_dir).select("doc_id", F.length(plain).alias("n_plain"), F.md5(plain).alias("plain_md5"))


@query(f"SELECT doc_id, md5({''.join('replace(' for _ in lists.QUOTES)}text{''.join(f', chr({ord(a)}), {literal(b)})' for a, b in lists.QUOTES.items())}) AS plain_md5 FROM documents")
def clean_marks(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(T.plain_marks(F.col("text"))).alias("plain_md5"))


@query(r"SELECT page_id, regexp_replace(url, '(https?://[^\s]+?)(?:[?&](?:utm_\w+|fbclid|gclid|ref)=[^\s&]*)+', '\1', 'gi') AS clean_url FROM pages")
def clean_urls(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", T.clean_urls("url").alias("clean_url"))


WORDS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')"


@query(f"""WITH w AS (SELECT doc_id, {WORDS} AS words FROM documents),
    s AS (SELECT doc_id, words, unnest(range(0, greatest(len(words) - 49, 0) + 1, 336)) AS start FROM w WHERE len(words) > 0)
    SELECT doc_id, start // 336 AS chunk_index, start, len(words[start + 1:start + 384]) AS n_words, CAST(floor(len(words[start + 1:start + 384]) * 1.3) AS INTEGER) AS token_count,
    array_to_string(words[start + 1:start + 384], ' ') AS content FROM s""")
def chunk_fixed(spark, sf_dir):
    return C.fixed(docs(spark, sf_dir))


PARENTS = f"""w AS (SELECT doc_id, {WORDS} AS words FROM documents),
    s AS (SELECT doc_id, words, unnest(range(0, len(words), 384)) AS start FROM w WHERE len(words) > 0),
    p AS (SELECT doc_id, start // 384 AS parent_index, words[start + 1:start + 384] AS words, array_to_string(words[start + 1:start + 384], ' ') AS content FROM s),
    parents AS (SELECT *, left(sha256(doc_id || ':' || parent_index || ':' || left(content, 100)), 16) AS parent_id FROM p),
    n AS (SELECT doc_id, parent_index, parent_id, words, unnest(range(0, len(words), 80)) AS spot FROM parents),
    children AS (SELECT doc_id, parent_id, parent_index * 100 + spot // 80 AS child_index, array_to_string(words[spot + 1:spot + 96], ' ') AS content FROM n WHERE len(words) - spot >= 10)"""


@query(f"WITH {PARENTS} SELECT * FROM children")
def chunk_parent_child(spark, sf_dir):
    return C.children(C.parents(docs(spark, sf_dir)))


@query(f"""WITH {PARENTS} SELECT c.doc_id, child_index, md5('[Context Expanded]' || chr(10) || p.content) AS content_md5, 1 AS expansion_depth FROM children c JOIN parents p USING (parent_id)""")
def parent_expand(spark, sf_dir):
    parents = C.parents(docs(spark, sf_dir))
    return C.expand(C.children(parents), parents.select("parent_id", "content").dropDuplicates(["parent_id"])).select("doc_id", "child_index", F.md5("content").alias("content_md5"), "expansion_depth")


@query(r"""WITH s AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS parts FROM documents),
    t AS (SELECT doc_id, unnest(parts) AS sentence, generate_subscripts(parts, 1) - 1 AS position FROM s) SELECT * FROM t WHERE length(trim(sentence)) > 0""")
def sentences(spark, sf_dir):
    return C.sentences(docs(spark, sf_dir))


@query()
def chunk_recursive(spark, sf_dir):
    return C.recursive(docs(spark, sf_dir))


@query()
def chunk_structure(spark, sf_dir):
    return C.structure_aware(docs(spark, sf_dir))


# headings part the text; what stands between two begins with the line end of the first
LEVELS = r"""l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents WHERE text <> ''),
    o AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n) - length(line) - 1 AS a FROM l),
    h AS (SELECT doc_id, text, n, a, a + length(line) AS b, lag(a + length(line)) OVER (PARTITION BY doc_id ORDER BY n) AS before, lead(a) OVER (PARTITION BY doc_id ORDER BY n) AS after FROM o WHERE regexp_matches(line, '^#+\s+')),
    p AS (SELECT doc_id, a, b, text[a + 1:b] AS part FROM h
          UNION ALL SELECT doc_id, b, coalesce(after, length(text)), text[b + 1:coalesce(after, length(text))] FROM h WHERE coalesce(after, length(text)) > b
          UNION ALL SELECT doc_id, 0, a, text[1:a] FROM h WHERE before IS NULL AND a > 0
          UNION ALL SELECT doc_id, 0, length(text), text FROM documents d WHERE text <> '' AND NOT EXISTS (SELECT 1 FROM h WHERE h.doc_id = d.doc_id)),
    g AS (SELECT *, starts_with(part, '#') AS is_heading, trim(regexp_replace(part, '^[# ]+|[# ]+$', '', 'g')) AS own FROM p),
    w AS (SELECT *, coalesce(last_value(CASE WHEN is_heading THEN own END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY a), '') AS name FROM g),
    k AS (SELECT *, unnest(range(0, length(part), 1000)) AS i FROM w WHERE NOT is_heading),
    r AS (SELECT doc_id, 'document' AS level, -1 AS a, 0 AS sub, 0 AS block, 0 AS start_char, length(text) AS end_char, 'Root' AS breadcrumb, left(text, 2000) AS content FROM documents
          UNION ALL SELECT doc_id, 'section', a, 0, 0, a, b, ' > ' || own, part FROM g WHERE is_heading
          UNION ALL SELECT doc_id, 'block', a + i, 0, a + i, a + i, a + least(i + 1000, length(part)), ' > ' || name || ' [Block ' || (i // 1000) || ']', part[i + 1:i + 1000] FROM k
          UNION ALL SELECT doc_id, 'leaf', a + i, 1 + j, a + i, a + i + j, a + least(i + 1000, length(part), i + j + 150), ' > ' || name || ' > ' || (j // 150), part[i + j + 1:least(i + 1000, i + j + 150)] FROM (SELECT *, unnest(range(0, least(1000, length(part) - i), 150)) AS j FROM k)),
    x AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY a, sub, level = 'block') - 1 AS chunk_index FROM r),
    y AS (SELECT *, last_value(CASE WHEN level = 'section' THEN chunk_index END IGNORE NULLS) OVER v AS section, last_value(CASE WHEN level = 'block' THEN chunk_index END IGNORE NULLS) OVER v AS of_block FROM x WINDOW v AS (PARTITION BY doc_id ORDER BY chunk_index))"""


@query(f"""WITH {LEVELS} SELECT doc_id, chunk_index, level, CASE level WHEN 'document' THEN -1 WHEN 'section' THEN 0 WHEN 'block' THEN coalesce(section, 0) ELSE of_block END AS parent_index,
    breadcrumb, start_char, end_char, content, (end_char - start_char) // 4 AS token_count FROM y""")
def chunk_hierarchical(spark, sf_dir):
    return C.hierarchical(docs(spark, sf_dir))


LATE = r"""WITH RECURSIVE s AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS parts FROM documents),
    t AS (SELECT doc_id, unnest(parts) AS sentence, generate_subscripts(parts, 1) AS n, len(parts) AS total FROM s),
    c AS (SELECT *, len(list_filter(regexp_split_to_array(sentence, '\s+'), lambda w: w <> '')) AS words FROM t),
    r AS (SELECT doc_id, n, total, words AS held, CAST(0 AS BIGINT) AS span, words >= 256 AS full_ FROM c WHERE n = 1
          UNION ALL SELECT c.doc_id, c.n, c.total, CASE WHEN r.full_ THEN c.words ELSE r.held + c.words END, r.span + CASE WHEN r.full_ THEN 1 ELSE 0 END, CASE WHEN r.full_ THEN c.words ELSE r.held + c.words END >= 256
          FROM r JOIN c ON c.doc_id = r.doc_id AND c.n = r.n + 1),
    p AS (SELECT doc_id, span, string_agg(sentence, ' ' ORDER BY n) AS content FROM r JOIN c USING (doc_id, n) GROUP BY doc_id, span),
    k AS (SELECT *, len(list_filter(regexp_split_to_array(content, '\s+'), lambda w: w <> '')) AS n_words FROM p)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY span) - 1 AS chunk_index, n_words, content FROM k WHERE n_words >= 64"""


@query(LATE)
def chunk_late(spark, sf_dir):
    return C.late(docs(spark, sf_dir))


# a mark stands before the white space behind a full stop or question mark, but not where an abbreviation or a name's initial ends
SENTENCES = r"regexp_replace(regexp_replace(regexp_replace(text, '([.?])(\s)', '\1' || chr(1) || '\2', 'g'), '([\p{L}\p{M}\p{N}_]\.[\p{L}\p{M}\p{N}_][.?])' || chr(1), '\1', 'g'), '([A-Z][a-z]\.)' || chr(1), '\1', 'g')"


@query(rf"""WITH s AS (SELECT doc_id, source, regexp_split_to_array({SENTENCES}, chr(1) || '\s') AS parts FROM documents),
    t AS (SELECT doc_id, source, unnest(parts) AS sentence, generate_subscripts(parts, 1) - 1 AS chunk_index FROM s)
    SELECT doc_id, chunk_index, sentence, '[doc ' || doc_id || '](' || source || ') ' || regexp_replace(sentence, '^\s+|\s+$', '', 'g') AS content FROM t""")
def proposition(spark, sf_dir):
    return C.propositions(docs(spark, sf_dir), F.concat(F.lit("doc "), F.col("doc_id").cast("string")), F.col("source"))


@query("""WITH b AS (SELECT *, CAST(embedding AS DOUBLE[]) AS e, lag(CAST(embedding AS DOUBLE[])) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM embeddings)
    SELECT label, vec_id, CAST(sum(CASE WHEN p IS NULL OR round(list_cosine_similarity(e, p), 6) >= 0.1 THEN 0 ELSE 1 END) OVER (PARTITION BY label ORDER BY vec_id) AS BIGINT) AS segment FROM b""")
def chunk_semantic(spark, sf_dir):
    return C.segments(read(spark, sf_dir, "embeddings"), "label", "vec_id", 0.1).select("label", "vec_id", "segment")


@query(r"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines FROM documents),
    r AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS position FROM l)
    SELECT doc_id, position, CASE WHEN starts_with(line, '#') THEN 'header' ELSE 'paragraph' END AS element_type, CASE WHEN starts_with(line, '#') THEN regexp_replace(line, '^[# ]+', '') ELSE line END AS content FROM r""")
def markdown_elements(spark, sf_dir):
    return P.markdown(docs(spark, sf_dir))


@query("""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: trim(x)), lambda x: x <> '') AS parts FROM documents)
    SELECT doc_id, unnest(parts) AS content, generate_subscripts(parts, 1) - 1 AS position, 'paragraph' AS element_type FROM l""")
def text_paragraphs(spark, sf_dir):
    return P.paragraphs(docs(spark, sf_dir))


@query()
def html_elements(spark, sf_dir):
    return P.html(read(spark, sf_dir, "pages"))


@query("""WITH n AS (SELECT *, row_number() OVER (ORDER BY c_custkey) - 1 AS rn FROM customer),
    l AS (SELECT rn, '| ' || c_custkey || ' | ' || replace(c_name, '|', '\\|') || ' | ' || c_mktsegment || ' |' AS line FROM n)
    SELECT rn // 1000 AS batch, '## Rows ' || (min(rn) + 1) || chr(8211) || (max(rn) + 1) || chr(10) || chr(10) || '| c_custkey | c_name | c_mktsegment |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg(line, chr(10) ORDER BY rn) AS content
    FROM l GROUP BY rn // 1000""")
def csv_markdown(spark, sf_dir):
    return P.markdown_tables(read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), "c_custkey")


MARK = "CASE c_nationkey % 3 WHEN 0 THEN ',' WHEN 1 THEN ';' ELSE chr(9) END"
BATCH = 25


@query(f"""WITH t AS (SELECT c_nationkey AS doc_id, {MARK} AS delimiter, '| ' || c_custkey || ' | ' || c_name || ' | ' || c_mktsegment || ' |' AS row, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey || {MARK} || c_name || {MARK} || c_mktsegment) - 1 AS i FROM customer),
    n AS (SELECT doc_id, delimiter, count(*) AS n_rows FROM t GROUP BY ALL)
    SELECT doc_id, -1 AS batch, n_rows, delimiter, '# CSV Data Summary' || chr(10) || chr(10) || '- **Total Rows:** ' || n_rows || chr(10) || '- **Columns (3):** key, name, segment' || chr(10) || '- **Chunks:** ' || ((n_rows + {BATCH - 1}) // {BATCH}) || ' (batch size: {BATCH})' || chr(10) || chr(10) AS content FROM n
    UNION ALL SELECT doc_id, i // {BATCH}, n_rows, delimiter, '## Rows ' || (min(i) + 1) || chr(8211) || (max(i) + 1) || chr(10) || chr(10) || '| key | name | segment |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg(row, chr(10) ORDER BY i)
    FROM t JOIN n USING (doc_id, delimiter) GROUP BY doc_id, i // {BATCH}, n_rows, delimiter""")
def csv_text(spark, sf_dir):
    """A delimited text for each nation's customers, with one of three delimiters, parsed again."""
    mark = F.when(F.col("c_nationkey") % 3 == 0, ",").when(F.col("c_nationkey") % 3 == 1, ";").otherwise("\t")
    line = F.concat_ws("", "c_custkey", mark, "c_name", mark, "c_mktsegment")
    body = F.array_join(F.array_sort(F.collect_list(line)), "\n")
    files = read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("doc_id")).agg(F.concat(F.concat_ws("", F.lit("key"), F.first(mark), F.lit("name"), F.first(mark), F.lit("segment\n")), body).alias("text"))
    return P.csv_texts(files, batch=BATCH)


INJECTED = " OR ".join(f"regexp_matches(text, {literal(p)}, 'i')" for p in lists.INJECTION)


@query(f"""SELECT conv_id, turn, CASE WHEN length(trim(text)) < 3 THEN 'too_short' WHEN length(trim(text)) > 2000 THEN 'too_long' WHEN {INJECTED} THEN 'injection' END AS blocked FROM conversations WHERE role = 'user'""")
def guardrail_input(spark, sf_dir):
    return read(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", T.rail(F.col("text")).alias("blocked"))


LEAKED = REDACTED
for _p in lists.LEAKS:
    LEAKED = f"regexp_replace({LEAKED}, {literal(_p)}, '[REDACTED]', 'gi')"


@query(f"""WITH a AS (SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN NULL ELSE (turn % 4) / 4.0 END AS confidence, CASE WHEN length(text) > 10000 THEN left(text, 10000) || chr(10) || chr(10) || '[Response truncated]' ELSE text END AS t FROM conversations WHERE role = 'assistant'),
    b AS (SELECT conv_id, turn, CASE WHEN confidence IS NULL THEN {literal(lists.NO_SOURCES)} WHEN confidence < 0.3 THEN {literal(lists.LOW_CONFIDENCE[0])} || CAST(round(confidence * 100) AS INTEGER) || '%' || {literal(lists.LOW_CONFIDENCE[1])} || t || {literal(lists.LOW_CONFIDENCE[2])} ELSE t END AS text FROM a)
    SELECT conv_id, turn, md5({LEAKED}) AS answer_md5 FROM b""")
def guardrail_output(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").where("role = 'assistant'")
    confidence = F.when(F.col("turn") % 5 == 4, None).otherwise((F.col("turn") % 4) / 4.0)
    return T.railed(rows, "text", confidence).select("conv_id", "turn", F.md5("text").alias("answer_md5"))


UNSAFE = " OR ".join(f"regexp_matches(q, {literal(duck(p)[0])}, '{duck(p)[1]}')" for p in lists.UNSAFE_SQL)
STATEMENT = "CASE p_size % 5 WHEN 0 THEN 'SELECT * FROM t WHERE n = ''' || p_name || '''' WHEN 1 THEN 'DROP TABLE ' || p_brand WHEN 2 THEN 'WITH a AS (SELECT 1) DELETE FROM a' WHEN 3 THEN 'SELECT 1; SELECT ''' || p_type || '''' ELSE 'select ' || p_size END"


@query(f"""WITH s AS (SELECT p_partkey, {STATEMENT} AS q FROM part)
    SELECT p_partkey, CASE WHEN upper(regexp_extract(q, '^[(\\s]*(\\w*)', 1)) NOT IN ({', '.join(map(literal, lists.READS))}) THEN 'not_a_read' WHEN regexp_matches(q, '\\b({'|'.join(lists.WRITES)})\\b', 'i') THEN 'blocked_word' WHEN {UNSAFE} THEN 'unsafe_pattern' END AS refusal FROM s""")
def sql_guard(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select("p_partkey", F.expr(STATEMENT).alias("q"))
    return rows.select("p_partkey", T.sql_refusal(F.col("q")).alias("refusal"))
