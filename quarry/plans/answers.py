"""Answers, caches, cases and costs: what a service shows of its results, what it keeps of them and what it records."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import lists
from ..functions import text as T
from ..functions import vector as V
from ..operators import answers as A
from ..operators import chunks as C
from ..operators import measure as M
from ..operators import search as S
from ..operators.cells import Cells
from ..operators.postings import index_of
from ..sources import tables as D
from .base import query, read, sql_list
from .evaluation import CASES, judge_scores
from .retrieval import CENTROIDS, COSINE, frequencies
from .streams import folder
from .texts import WORDS, literal

FOUND = f"""q AS {frequencies('benchmark', 'item_id')}, d AS {frequencies('documents', 'doc_id')},
    s AS (SELECT item_id, doc_id, CAST(sum(q.tf * d.tf) AS BIGINT) AS score FROM d JOIN q USING (token_id) GROUP BY item_id, doc_id),
    r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 30),
    x AS (SELECT item_id, doc_id, rank, text AS content, score / (1.0::DOUBLE + score) AS relevance_score FROM r JOIN documents USING (doc_id))"""


def found(spark, sf_dir, k: int = 30):
    items, docs = read(spark, sf_dir, "benchmark"), read(spark, sf_dir, "documents")
    rows = index_of(docs).best(items, "item_id", k)
    score = F.col("score") / (F.lit(1.0) + F.col("score"))
    return rows.join(docs.select("doc_id", F.col("text").alias("content")), "doc_id").select("item_id", "doc_id", "rank", "content", score.alias("relevance_score"))


@query(f"WITH {FOUND} SELECT item_id, doc_id, rank, left(content, 1000) AS content, round(relevance_score, 4) AS relevance_score FROM x")
def api_projection(spark, sf_dir):
    return A.shown(found(spark, sf_dir), 1000, 4)


@query(f"WITH {FOUND} SELECT item_id, doc_id, rank, left(content, 500) AS content, round(relevance_score, 3) AS relevance_score FROM x WHERE rank <= 20")
def tool_projection(spark, sf_dir):
    return A.shown(found(spark, sf_dir), 500, 3, 20)


@query(f"""WITH {FOUND}, n AS (SELECT item_id, doc_id, rank, content, relevance_score FROM x WHERE rank <= 20), l AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY length(content) DESC, doc_id) AS rank, content FROM n),
    e AS (SELECT item_id, doc_id, left(content, 100) AS head, rank, 0 AS place, 'sparse' AS source FROM n WHERE rank <= 12 UNION ALL SELECT item_id, doc_id, left(content, 100), rank, 1, 'length' FROM l WHERE rank <= 12),
    f AS (SELECT item_id, doc_id, head, round(sum(1 / (60.0::DOUBLE + rank)), 8) AS rrf_score, string_agg(source, ',' ORDER BY source) AS sources, min((place, rank)) AS seen, arg_min(source, (place, rank)) AS first_list FROM e GROUP BY ALL)
    SELECT item_id, doc_id, rrf_score, sources, rank, first_list FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rrf_score DESC, seen, doc_id) AS rank FROM f) WHERE rank <= 10""")
def rrf_results(spark, sf_dir):
    """Two lists of each item, by terms and by length, fused with the row that was seen first."""
    rows = found(spark, sf_dir, 20)
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.length("content").desc(), "doc_id"))
    lists_ = {"sparse": rows.where("rank <= 12"), "length": rows.withColumn("rank", place).where("rank <= 12")}
    named = {n: df.select("item_id", "doc_id", "rank", "content", F.lit(n).alias("first_list")) for n, df in lists_.items()}
    return S.fuse_results(named, "item_id", "doc_id").drop("content")


@query(f"""WITH {CENTROIDS}, dense AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY {COSINE} DESC, vec_id) AS rank FROM pairs),
    q AS {frequencies("(SELECT * FROM benchmark WHERE item_id IN (SELECT label FROM embeddings))", "item_id")}, d AS {frequencies('documents', 'doc_id')},
    s AS (SELECT item_id AS label, doc_id AS vec_id, sum(q.tf * d.tf) AS score FROM d JOIN q USING (token_id) GROUP BY item_id, doc_id),
    sparse AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM s),
    e AS (SELECT label, vec_id, rank, 'dense' AS source FROM dense WHERE rank <= 20 UNION ALL SELECT label, vec_id, rank, 'sparse' FROM sparse WHERE rank <= 20),
    f AS (SELECT label, vec_id, round(sum(1 / (60.0::DOUBLE + rank)), 8) AS score, string_agg(source, ',' ORDER BY source) AS sources FROM e GROUP BY label, vec_id)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM f) WHERE rank <= 10""")
def hybrid_search(spark, sf_dir):
    """Dense and sparse branches with twice the results asked for: vectors of a label like its mean, from the index in cells, and texts like the label's benchmark item, from the inverted index. A vector and a text of one number are one item."""
    vectors, items = read(spark, sf_dir, "embeddings"), read(spark, sf_dir, "benchmark")
    asked = items.join(vectors.select(F.col("label").alias("item_id")).distinct(), "item_id", "left_semi")
    sparse = index_of(read(spark, sf_dir, "documents")).best(asked, "item_id", 20)
    sparse = sparse.select(F.col("item_id").cast("int").alias("label"), F.col("doc_id").alias("vec_id"), "rank")
    dense = Cells(vectors, "label", cells=32).similar(S.centroids(vectors, "label"), 20)
    return S.hybrid(dense, sparse, "label", "vec_id")


@query("""SELECT doc_id, source AS team FROM documents WHERE source = 'src1' AND n_chars > 1000 AND doc_id % 3 <> 0 AND lang = 'en'""")
def filter_merge(spark, sf_dir):
    """Conditions of the team, of the question, of the request and of the namespace at once."""
    rows = read(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("team"), F.col("lang").alias("namespace"), F.when(F.col("n_chars") > 1000, "long").otherwise("short").alias("size"), (F.col("doc_id") % 3 != 0).alias("public"))
    return rows.where(S.merged_filter({"team": "src1"}, {"size": "long"}, {"public": True}, "en")).select("doc_id", "team")


@query(r"SELECT conv_id, turn, CASE WHEN length(text) < 50 THEN 'simple' WHEN length(text) < 200 THEN 'moderate' ELSE 'complex' END AS complexity, sha256('team' || conv_id % 5 || ':' || role || ':' || text) AS cache_key, left(sha256(lower(regexp_replace(text, '^\s+|\s+$', '', 'g'))), 16) AS query_key FROM conversations")
def query_keys(spark, sf_dir):
    rows, text = read(spark, sf_dir, "conversations"), F.col("text")
    team = F.concat(F.lit("team"), (F.col("conv_id") % 5).cast("string"))
    return rows.select("conv_id", "turn", T.complexity_by_length(text).alias("complexity"), T.cache_key(team, F.col("role"), text).alias("cache_key"), T.query_key(text).alias("query_key"))


SAID = "list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_]+'), lambda t: NOT regexp_full_match(t, '[0-9]+'))"
STOPPED = "CASE lang " + " ".join(f"WHEN '{k}' THEN {sql_list(v)}" for k, v in lists.STOP_BY_LANG.items()) + f" ELSE {sql_list(lists.SPARSE_STOP)} END"


@query(f"WITH t AS (SELECT doc_id, {SAID} AS words, {STOPPED} AS stop FROM documents) SELECT doc_id, len(list_filter(words, lambda w: NOT list_contains(stop, w))) AS n_tokens FROM t")
def tokens_by_language(spark, sf_dir):
    """Terms of each document without the stop words of its language."""
    return read(spark, sf_dir, "documents").select("doc_id", F.size(T.sparse_tokens("text", T.stop_words(F.col("lang")))).alias("n_tokens"))


UNWRAPPED = r"regexp_replace(regexp_replace(regexp_replace(" + "".join("replace(" for _ in lists.LIGATURES) + "text" + "".join(f", chr({ord(a)}), '{b}')" for a, b in lists.LIGATURES.items()) + r", '([\p{L}\p{M}\p{N}_])-\s*\n\s*([\p{L}\p{M}\p{N}_])', '\1\2', 'g'), '\s+', ' ', 'g'), '^ | $', '', 'g')"
FURNITURE = " OR ".join(f"regexp_matches(line, {literal(p)}, 'i')" for p in lists.BOILERPLATE)


@query(f"SELECT doc_id, md5({UNWRAPPED}) AS unwrapped_md5 FROM documents")
def unwrapped_text(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(T.unwrapped(F.col("text"))).alias("unwrapped_md5"))


@query(f"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT doc_id, count(*) AS n_lines, count(*) FILTER ({FURNITURE}) AS n_boilerplate FROM l GROUP BY doc_id")
def boilerplate_lines(spark, sf_dir):
    lines = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count(F.when(T.boilerplate(F.col("line")), 1)).alias("n_boilerplate"))


@query(f"""WITH w AS (SELECT doc_id, {WORDS} AS words FROM documents),
    s AS (SELECT doc_id, words, unnest(range(0, greatest(len(words) - 49, 0) + 1, 336)) AS start FROM w WHERE len(words) > 0)
    SELECT doc_id, count(*) AS chunk_count, CAST(sum(floor(len(words[start + 1:start + 384]) * 1.3)) AS BIGINT) AS token_total FROM s GROUP BY doc_id""")
def chunk_totals(spark, sf_dir):
    return C.totals(C.fixed(read(spark, sf_dir, "documents")))


VOWELS = "[" + ", ".join(f"(length(sentence) - length(replace(sentence, '{c}', '')))::DOUBLE" for c in "aeiou") + "]"


@query(rf"""WITH s AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS parts FROM documents),
    t AS (SELECT doc_id, unnest(parts) AS sentence, generate_subscripts(parts, 1) AS position FROM s), u AS (SELECT *, {VOWELS} AS v FROM t WHERE length(trim(sentence)) > 0),
    p AS (SELECT *, lag(v) OVER (PARTITION BY doc_id ORDER BY position) AS before FROM u),
    g AS (SELECT *, sum(CASE WHEN before IS NULL THEN 0 WHEN list_sum(v) = 0 OR list_sum(before) = 0 THEN 1 WHEN round(list_cosine_similarity(v, before), 6) >= 0.9 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY position) AS segment FROM p),
    c AS (SELECT doc_id, segment, string_agg(trim(sentence), ' ' ORDER BY position) AS text, count(*) AS n FROM g GROUP BY doc_id, segment),
    k AS (SELECT *, {WORDS} AS words, sum(n) OVER (PARTITION BY doc_id) = 1 AS alone FROM c)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY segment) - 1 AS chunk_index, CAST(floor(least(len(words), 768) * 1.3) AS INTEGER) AS token_count, CASE WHEN len(words) > 768 THEN array_to_string(words[1:768], ' ') ELSE text END AS content FROM k WHERE alone OR len(words) >= 37""")
def chunk_semantic_text(spark, sf_dir):
    """Semantic chunks of documents; the counts of five letters stand for a sentence's vector."""
    rows = C.sentences(read(spark, sf_dir, "documents"))
    letters = F.array(*((F.length("sentence") - F.length(F.replace("sentence", F.lit(c), F.lit("")))).cast("double") for c in "aeiou"))
    return C.semantic(rows.withColumn("embedding", letters), 0.9)


@query(f"""WITH {CENTROIDS}, b AS (SELECT label, vec_id, e, query, row_number() OVER (PARTITION BY label ORDER BY {COSINE} DESC, vec_id) AS rank, {COSINE} AS score FROM pairs WHERE vec_id % 2 = 0)
    SELECT label, CASE WHEN score >= 0.3 THEN vec_id END AS cached_id, CASE WHEN score >= 0.3 THEN 'answer ' || vec_id END AS answer FROM b WHERE rank = 1""")
def semantic_cache(spark, sf_dir):
    """Each tenant's query against the cached ones (even ids): the nearest, if it is near enough, and the answer stored under its key."""
    vectors = read(spark, sf_dir, "embeddings")
    cached = vectors.where("vec_id % 2 = 0")
    answers = cached.select("vec_id", F.concat(F.lit("answer "), F.col("vec_id").cast("string")).alias("answer"))
    return A.cached(S.centroids(vectors, "label"), cached, answers, "label", "vec_id", 0.3)


@query(f"WITH {CASES} SELECT conv_id, turn, round((faithfulness + relevance + coverage) / 3, 4) AS composite, (faithfulness + relevance + coverage) / 3 >= 0.5 AS passed FROM j")
def case_results(spark, sf_dir):
    scores = judge_scores(spark, sf_dir).unpivot(["conv_id", "turn"], ["faithfulness", "relevance", "coverage"], "judge", "score")
    return A.composites(scores, ["conv_id", "turn"])


SURE = f"""CASE WHEN n > 30 OR list_has_any(w, {sql_list(lists.MULTI_HOP)}) THEN 'complex' WHEN n < 8 AND NOT list_has_any(w, {sql_list(lists.INVOLVED)}) THEN 'simple' ELSE 'moderate' END"""


@query(f"""WITH {CASES}, p AS (SELECT conv_id, turn + 1 AS turn, len(regexp_extract_all(lower(text), '\\S+')) AS n, regexp_split_to_array(lower(text), '\\s+') AS w FROM conversations)
    SELECT conv_id, turn, round((faithfulness + relevance) / 2, 6) AS mean_score, {SURE} AS complexity FROM j JOIN p USING (conv_id, turn) WHERE (faithfulness + relevance) / 2 < 0.7 AND {SURE} <> 'simple'""")
def self_evaluation(spark, sf_dir):
    """Answers whose judges are doubtful, but for simple questions: what a service records of itself."""
    asked = read(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") + 1).alias("turn"), T.complexity(F.col("text")).alias("complexity"))
    scores = judge_scores(spark, sf_dir).unpivot(["conv_id", "turn"], ["faithfulness", "relevance"], "judge", "score")
    return A.doubtful(scores, asked, ["conv_id", "turn"])


COST = "CASE event_id % 4 WHEN 0 THEN 'gpt-4o' WHEN 1 THEN 'gpt-4o-mini' WHEN 2 THEN 'text-embedding-3-large' ELSE 'unknown' END"
RATE = ["CASE model " + " ".join(f"WHEN '{m}' THEN {p[i]}" for m, p in lists.MODEL_PRICES.items()) + " ELSE 0 END" for i in (0, 1)]


@query(f"""WITH c AS (SELECT {COST} AS model, CAST(floor(value * 100) AS BIGINT) AS i, CAST(floor(value * 30) AS BIGINT) AS o FROM events)
    SELECT model, count(*) AS calls, CAST(sum(i) AS BIGINT) AS input_tokens, CAST(sum(o) AS BIGINT) AS output_tokens, round((sum(i) * ({RATE[0]})::DOUBLE + sum(o) * ({RATE[1]})::DOUBLE) / 1000000, 6) AS cost_usd FROM c GROUP BY model""")
def model_costs(spark, sf_dir):
    calls = read(spark, sf_dir, "events").select(F.expr(COST).alias("model"), F.floor(F.col("value") * 100).alias("tokens_in"), F.floor(F.col("value") * 30).alias("tokens_out"))
    return A.by_model(calls)


@query("SELECT event_type, count(*) AS total, count(value) AS n_values, arg_max(value, (ts, event_id)) FILTER (value IS NOT NULL) AS latest FROM events GROUP BY event_type")
def counters_gauges(spark, sf_dir):
    return A.counters(read(spark, sf_dir, "events"), "event_type")


@query("SELECT event_id, user_id, value FROM events WHERE value > 50")
def slow_operations(spark, sf_dir):
    return A.slow(read(spark, sf_dir, "events"), "value", 50.0).select("event_id", "user_id", "value")


@query("SELECT d.doc_id, CASE WHEN d.n_chars > 2000 THEN 'ready' WHEN d.lang = 'de' THEN 'failed' ELSE 'partial' END AS status FROM documents d")
def document_status(spark, sf_dir):
    """A document is ready with a tree, partial without one and without an error, else failed."""
    rows = read(spark, sf_dir, "documents")
    return rows.select("doc_id", A.status(F.col("n_chars") > 2000, F.when(F.col("lang") == "de", "no tree")).alias("status"))


@query("SELECT item_id, CASE item_id % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END AS difficulty FROM benchmark WHERE item_id % 3 <> 1 AND (length(text) % 2 = 0)")
def golden_filter(spark, sf_dir):
    """Cases written as JSON and read again, by difficulty and tag."""
    cases = golden(spark, sf_dir)
    path = f"{folder(spark)}/golden-{uuid.uuid4().hex}"
    D.write_cases(cases, path)
    rows = A.picked(D.read_cases(spark, path), difficulty=["easy", "hard"], tag="even")
    return rows.select(F.col("id").cast("long").alias("item_id"), "difficulty")


def golden(spark, sf_dir):
    n = F.col("item_id") % 3
    tags = F.array(F.when(F.length("text") % 2 == 0, "even").otherwise("odd"), F.lit("all"))
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.col("text").alias("query"), F.col("text").alias("expected_answer"), F.when(n == 0, "easy").when(n == 1, "medium").otherwise("hard").alias("difficulty"), tags.alias("tags"))


CATEGORY = "CASE WHEN faithfulness < 0.3 THEN 'hallucination' WHEN relevance < 0.3 THEN 'off_topic' WHEN latency_ms > 10000 THEN 'latency_exceeded' WHEN turn % 4 = 1 THEN 'retrieval_miss' WHEN coverage < 0.3 THEN 'low_coverage' ELSE 'unknown' END"


@query(f"WITH {CASES}, f AS (SELECT conv_id * 1000 + turn AS case_id, {CATEGORY} AS category, round((faithfulness + relevance + coverage) / 3, 4) AS score FROM j) SELECT case_id, category, score FROM f WHERE score < 0.5 AND category = 'off_topic'")
def failure_store(spark, sf_dir):
    """Failed cases with their recall, written as JSON, read again and filtered by category."""
    from ..functions import judge as J

    rows = judge_scores(spark, sf_dir)
    recall = F.when(F.col("turn") % 4 == 1, 0.1).otherwise(0.9)
    category = J.failure(F.col("faithfulness"), F.col("relevance"), F.col("coverage"), F.col("latency_ms"), recall)
    score = F.round((F.col("faithfulness") + F.col("relevance") + F.col("coverage")) / 3, 4)
    failed = rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("case_id"), category.alias("category"), score.alias("score")).where("score < 0.5")
    path = f"{folder(spark)}/failures-{uuid.uuid4().hex}"
    D.write_failures(failed, path)
    return D.read_failures(spark, path, "off_topic").select("case_id", "category", "score")


@query("WITH s AS (SELECT n_nationkey, string_split(n_name, ' ') AS names FROM nation), u AS (SELECT n_nationkey, unnest(names) AS name FROM s) SELECT n_nationkey AS toolset, name FROM u JOIN (SELECT DISTINCT r_name AS name FROM region UNION SELECT n_name FROM nation WHERE n_nationkey % 2 = 0) USING (name)")
def toolsets(spark, sf_dir):
    """Names in a set that name a registered tool; others are skipped."""
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    sets = nation.select(F.col("n_nationkey").alias("toolset"), F.split("n_name", " ").alias("names"))
    tools = region.select(F.col("r_name").alias("name")).union(nation.where("n_nationkey % 2 = 0").select("n_name")).distinct()
    return A.members(sets, tools)


@query("SELECT s_suppkey, coalesce(nullif(s_name, 'Supplier#000000001'), 'none') AS name, CAST(trunc(s_acctbal) AS BIGINT) AS balance, CAST(s_nationkey AS VARCHAR) AS nation FROM supplier WHERE s_acctbal > 0")
def sql_template(spark, sf_dir):
    """A declared SQL tool: its statement passes the guard and runs over a view with bound parameters."""
    read(spark, sf_dir, "supplier").createOrReplaceTempView("quarry_supplier")
    return D.run_sql(spark, "SELECT s_suppkey, coalesce(nullif(s_name, :skip), 'none') AS name, CAST(s_acctbal AS BIGINT) AS balance, CAST(s_nationkey AS STRING) AS nation FROM quarry_supplier WHERE s_acctbal > :least", None, {"skip": "Supplier#000000001", "least": 0})



MODES = "['auto', 'pageindex', 'rag', 'hybrid'][1 + turn % 4]"


@query(f"""WITH c AS (SELECT conv_id, turn, {MODES} AS mode, len(list_filter({sql_list(lists.STRUCTURED)}, lambda k: list_contains(regexp_split_to_array(lower(text), '\\s+'), k))) AS s, len(list_filter({sql_list(lists.FACTUAL)}, lambda k: contains(lower(text), k))) AS f FROM conversations),
    j AS (SELECT c.*, d.doc_id, coalesce(n_chars > 2000, false) AS tree, coalesce(lang <> 'de', false) AS vectors FROM c LEFT JOIN documents d ON d.doc_id = c.conv_id)
    SELECT conv_id, turn, CASE mode WHEN 'pageindex' THEN 'pageindex' WHEN 'rag' THEN 'vector' WHEN 'hybrid' THEN 'hybrid' ELSE CASE WHEN doc_id IS NULL OR NOT tree THEN 'vector' WHEN NOT vectors THEN 'pageindex' WHEN s > f THEN 'pageindex' WHEN f > s THEN 'vector' ELSE 'hybrid' END END AS path,
    (CASE WHEN mode <> 'auto' THEN 1.0 WHEN doc_id IS NULL THEN 0.9 WHEN tree AND NOT vectors THEN 0.9 WHEN tree AND vectors THEN CASE WHEN s > f THEN 0.8 WHEN f > s THEN 0.7 ELSE 0.6 END ELSE 0.7 END)::DOUBLE AS confidence FROM j""")
def route_modes(spark, sf_dir):
    """Paths and their confidence for requests whose modes go round."""
    docs = read(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") > 2000).alias("tree"), (F.col("lang") != "de").alias("vectors"))
    rows = read(spark, sf_dir, "conversations").join(docs, F.col("doc_id") == F.col("conv_id"), "left")
    mode = F.element_at(F.array(*map(F.lit, ("auto", "pageindex", "rag", "hybrid"))), (1 + F.col("turn") % 4).cast("int"))
    of = (mode, F.col("doc_id"), F.col("tree"), F.col("vectors"), T.query_class(F.col("text")))
    return rows.select("conv_id", "turn", T.path(*of).alias("path"), T.path_confidence(*of).alias("confidence"))


@query(f"""WITH {FOUND}, b AS (SELECT b.item_id, b.text AS prompt, x.rank, x.content FROM benchmark b LEFT JOIN x ON x.item_id = b.item_id AND x.rank <= 7 AND b.item_id % 5 <> 0)
    SELECT item_id, CASE WHEN count(content) = 0 THEN {literal(lists.NO_CONTEXT)} ELSE {literal(lists.STAND_IN[0])} || string_agg('[Source ' || rank || ']: ' || left(content, 200), chr(10) ORDER BY rank) FILTER (rank <= 5) || {literal(lists.STAND_IN[1])} || count(content) || {literal(lists.STAND_IN[2])} || left(first(prompt), 100) END AS answer FROM b GROUP BY item_id""")
def stand_in_answers(spark, sf_dir):
    """Answers from each item's best documents; every fifth item has none."""
    rows = found(spark, sf_dir, 30).where("rank <= 7 and item_id % 5 != 0").select("item_id", F.col("rank").alias("position"), "content")
    asked = read(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("prompt")).join(rows, "item_id", "left")
    return A.stand_in(asked, "item_id", "prompt")


@query("""WITH e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, count(*) OVER (PARTITION BY user_id) AS c FROM events) SELECT user_id, event_id, c >= 20 AS truncated FROM e WHERE n <= 20""")
def limited_rows(spark, sf_dir):
    """The first twenty rows of a call for each user, marked where the limit was reached."""
    return A.limited(read(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], 20).select("user_id", "event_id", "truncated")


@query("""WITH e AS (SELECT event_id, strftime(ts, '%Y-%m-%d %H') AS batch, row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d %H') ORDER BY ts, event_id) AS n FROM events) SELECT event_id, CASE WHEN n <= 3 THEN 'pending' ELSE 'failed' END AS status FROM e""")
def queue_overflow(spark, sf_dir):
    """Events stand for jobs that arrive by hours at a queue of three places."""
    rows = read(spark, sf_dir, "events").withColumn("batch", F.date_trunc("hour", F.col("ts").cast("timestamp")))
    return A.queued(rows, 3).select("event_id", "status")


@query(f"""WITH {FOUND}, c AS (SELECT item_id, doc_id, rank FROM x WHERE rank <= 5), a AS (SELECT item_id, doc_id, round(1.0::DOUBLE / rank, 6) AS score, 'first' AS reranker FROM c WHERE item_id % 3 = 0),
    b AS (SELECT item_id, doc_id, round(0.5::DOUBLE / rank, 6), 'second' FROM c WHERE item_id % 2 = 0 AND item_id NOT IN (SELECT item_id FROM a))
    SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT item_id, doc_id, 0.5::DOUBLE, 'none' FROM c WHERE item_id % 3 <> 0 AND item_id % 2 <> 0""")
def rerank_fallback(spark, sf_dir):
    """Two rerankers that know some items only, then the order as it was."""
    rows = found(spark, sf_dir, 5).join(read(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("query_text")), "item_id")
    score = lambda c: F.round(F.lit(c) / F.col("rank"), 6).alias("score")
    known = {"first": rows.where("item_id % 3 = 0").select("item_id", "doc_id", score(1.0)), "second": rows.where("item_id % 2 = 0").select("item_id", "doc_id", score(0.5))}
    return A.with_fallback(known, rows, "item_id", "doc_id")


@query(f"""WITH {FOUND}, c AS (SELECT *, rank - 1 AS position FROM x WHERE rank <= 10) SELECT item_id, doc_id, position AS index, round(1.0::DOUBLE / (1 + length(content) % 7), 6) AS relevance_score FROM c WHERE position % 2 = 0""")
def rerank_join(spark, sf_dir):
    """A reranker's results point to their rows by position."""
    rows = found(spark, sf_dir, 10).withColumn("position", F.col("rank") - 1)
    reranked = rows.where("position % 2 = 0").select("item_id", F.col("position").alias("index"), F.round(1 / (1 + F.length("content") % 7), 6).alias("relevance_score"))
    return A.by_position(reranked, rows, "item_id").select("item_id", "doc_id", "index", "relevance_score")


@query("""WITH s AS (SELECT doc_id, text, unnest(range(0, length(text), 1000)) AS start FROM documents WHERE length(text) > 0)
    SELECT doc_id, start // 1000 AS chunk_index, start AS start_char, least(start + 1000, length(text)) AS end_char, md5(substring(text, greatest(start - 200, 0) + 1, least(least(start + 1000, length(text)) + 200, length(text)) - greatest(start - 200, 0))) AS window_md5 FROM s""")
def chunk_windows(spark, sf_dir):
    """Stretches of 1000 characters with 200 on either side, for embeddings that know what stands around."""
    docs = read(spark, sf_dir, "documents")
    rows = docs.where("length(text) > 0").select("doc_id", F.length("text").alias("n"), F.posexplode(F.sequence(F.lit(0), F.length("text") - 1, F.lit(1000))).alias("chunk_index", "start_char"))
    places = C.boundaries(rows.withColumn("end_char", F.least(F.col("start_char") + 1000, F.col("n"))))
    return C.windows(places, docs).withColumn("window_md5", F.md5("window")).drop("window")


@query("SELECT u.s_suppkey, n_name, count(*) AS n_parts FROM supplier u JOIN nation ON s_nationkey = n_nationkey JOIN lineitem ON l_suppkey = u.s_suppkey GROUP BY u.s_suppkey, n_name")
def sql_join(spark, sf_dir):
    """A declared SQL tool that joins sources."""
    for name in ("supplier", "nation", "lineitem"):
        read(spark, sf_dir, name).createOrReplaceTempView(f"quarry_{name}")
    return D.run_sql(spark, "SELECT u.s_suppkey, n_name, count(*) AS n_parts FROM quarry_supplier u JOIN quarry_nation ON s_nationkey = n_nationkey JOIN quarry_lineitem ON l_suppkey = u.s_suppkey GROUP BY u.s_suppkey, n_name", None)
