"""Ranking metrics, judges, reports and table maintenance. A passage of the benchmark asks for the documents that hold its first sentence's words."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import judge as J
from ..functions import lists
from ..functions import text as T
from ..operators import measure as M
from ..operators import tables as B
from ..operators.postings import index_of
from ..sources.stored import place
from ..sources.versions import VersionedTable
from .base import query, read, sql_list
from .retrieval import frequencies

RETRIEVED = f"""q AS {frequencies('benchmark', 'item_id')}, d AS {frequencies('documents', 'doc_id')},
    s AS (SELECT item_id, doc_id, sum(q.tf * d.tf) AS s FROM d JOIN q USING (token_id) GROUP BY item_id, doc_id),
    shared AS (SELECT item_id, doc_id, count(*) AS n FROM d JOIN q USING (token_id) GROUP BY item_id, doc_id),
    sizes AS (SELECT item_id, count(*) AS size FROM q GROUP BY item_id),
    relevant AS (SELECT item_id, doc_id FROM shared JOIN sizes USING (item_id) WHERE n >= 0.6::DOUBLE * size),
    retrieved AS (SELECT * FROM (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY s DESC, doc_id) AS rank FROM s) WHERE rank <= 20)"""


def judged(spark, sf_dir):
    """Items and documents: rank of the 20 best, and whether the document has most of the item's terms. Either is a search of its own in one index."""
    items, index = read(spark, sf_dir, "benchmark"), index_of(read(spark, sf_dir, "documents"))
    best = index.best(items, "item_id", 20).select("item_id", "doc_id", "rank")
    relevant = index.sharing(items, "item_id", 0.6).select("item_id", "doc_id", F.lit(True).alias("relevant"))
    return best.join(relevant, ["item_id", "doc_id"], "full").withColumn("relevant", F.coalesce("relevant", F.lit(False)))


@query(f"""WITH {RETRIEVED},
    h AS (SELECT item_id, count(*) FILTER (rank <= 5) AS n, min(rank) AS first, coalesce(sum(1 / log2(rank + 1)) FILTER (rank <= 5), 0) AS gain FROM retrieved JOIN relevant USING (item_id, doc_id) GROUP BY item_id),
    z AS (SELECT item_id, count(*) AS r FROM relevant GROUP BY item_id),
    m AS (SELECT item_id, coalesce(n, 0) AS n, first, coalesce(gain, 0) AS gain, r, (SELECT sum(1 / log2(i + 1)) FROM range(1, least(r, 5) + 1) t(i)) AS best FROM z LEFT JOIN h USING (item_id))
    SELECT item_id, round(n / 5.0::DOUBLE, 4) AS precision, round(n / r::DOUBLE, 4) AS recall, round(CASE WHEN n = 0 THEN 0 ELSE 2 * (n / 5.0::DOUBLE) * (n / r::DOUBLE) / (n / 5.0::DOUBLE + n / r::DOUBLE) END, 4) AS f1, round(coalesce(1.0::DOUBLE / first, 0), 4) AS mrr, round(gain / best, 4) AS ndcg FROM m""")
def ir_metrics(spark, sf_dir):
    return M.ranking_of(judged(spark, sf_dir), "item_id", 5)


METRICS = ("precision", "recall", "f1", "mrr", "ndcg")
OF_ITEM = """h AS (SELECT item_id, count(*) FILTER (rank <= 5) AS n, min(rank) AS first, coalesce(sum(1 / log2(rank + 1)) FILTER (rank <= 5), 0) AS gain FROM retrieved JOIN relevant USING (item_id, doc_id) GROUP BY item_id),
    z AS (SELECT item_id, count(*) AS r FROM relevant GROUP BY item_id),
    m AS (SELECT item_id, coalesce(n, 0) AS n, first, coalesce(gain, 0) AS gain, r, (SELECT sum(1 / log2(i + 1)) FROM range(1, least(r, 5) + 1) t(i)) AS best FROM z LEFT JOIN h USING (item_id)),
    o AS (SELECT item_id, round(n / 5.0::DOUBLE, 4) AS precision, round(n / r::DOUBLE, 4) AS recall, round(CASE WHEN n = 0 THEN 0 ELSE 2 * (n / 5.0::DOUBLE) * (n / r::DOUBLE) / (n / 5.0::DOUBLE + n / r::DOUBLE) END, 4) AS f1, round(coalesce(1.0::DOUBLE / first, 0), 4) AS mrr, round(gain / best, 4) AS ndcg FROM m)"""


@query(f"WITH {RETRIEVED}, {OF_ITEM} SELECT CASE item_id % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END AS difficulty, count(*) AS n_cases, {', '.join(f'round(avg({m}), 4) AS {m}' for m in METRICS)} FROM o GROUP BY ROLLUP (1)")
def ir_report(spark, sf_dir):
    """Mean ranking metrics of all cases and by difficulty; metrics have four digits, so their sums are exact, in whatever order."""
    rows = M.ranking_of(judged(spark, sf_dir), "item_id", 5)
    n = F.col("item_id") % 3
    return rows.withColumn("difficulty", F.when(n == 0, "easy").when(n == 1, "medium").otherwise("hard")).rollup("difficulty").agg(F.count("*").alias("n_cases"), *(F.round(F.avg(F.col(m).cast("decimal(12,4)")).cast("double"), 4).alias(m) for m in METRICS))


CONTENT = f"list_filter(list_distinct(list_filter(regexp_extract_all(lower({{0}}), '[\\p{{{{L}}}}\\p{{{{M}}}}\\p{{{{N}}}}_]+'), lambda w: regexp_full_match(w, '[a-z]{{{{3,}}}}'))), lambda w: NOT list_contains({sql_list(lists.CONTENT_STOP)}, w))".replace("{{", "{").replace("}}", "}")


def content(c: str) -> str:
    return CONTENT.replace("{0}", c)


SHARE = "len(list_intersect({whole}, {part}))::DOUBLE / nullif(len({whole}), 0)"
CASES = f"""t AS (SELECT c.conv_id, c.turn, {content('c.text')} AS a, {content('p.text')} AS q, {content('d.text')} AS s, e.value * 200 AS latency_ms, trim(c.text) = '' AS no_answer, trim(d.text) = '' AS none_expected
        FROM conversations c JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1 JOIN documents d ON d.doc_id = c.conv_id JOIN events e ON e.event_id = c.conv_id WHERE c.role = 'assistant'),
    c AS (SELECT *, {SHARE.format(whole='a', part='s')} AS c, {SHARE.format(whole='q', part='a')} AS qc, {SHARE.format(whole='s', part='a')} AS ec, {SHARE.format(whole='q', part='s')} AS sq FROM t),
    j AS (SELECT conv_id, turn, latency_ms,
        round(CASE WHEN len(s) = 0 THEN 0 ELSE coalesce(CASE WHEN c >= 0.6 THEN least(1.0, 0.5 + c * 0.5) WHEN c >= 0.3 THEN 0.3 + c * 0.4 ELSE c * 0.5 END, 0) END, 4) AS faithfulness,
        round(CASE WHEN len(q) = 0 THEN 0.5 ELSE least(1.0, 0.4 * qc + 0.6 * coalesce(ec, 0)) END, 4) AS relevance,
        round(CASE WHEN no_answer THEN 0 WHEN none_expected THEN 1 ELSE coalesce(ec, 0.5) END, 4) AS coverage, round(sq, 4) AS recall FROM c)"""


def judge_scores(spark, sf_dir):
    """Answers of conversations against the document of the same number as source and expectation, and the turn before as question; recall is the share of the question's words that the source has."""
    talks = read(spark, sf_dir, "conversations")
    words = T.content_words
    answers = talks.where("role = 'assistant'").select("conv_id", "turn", words("text").alias("a"), F.col("text").alias("answer"))
    asked = talks.select("conv_id", (F.col("turn") + 1).alias("turn"), words("text").alias("q"))
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("conv_id"), words("text").alias("s"), F.col("text").alias("expected"))
    times = read(spark, sf_dir, "events").select(F.col("event_id").alias("conv_id"), (F.col("value") * 200).alias("latency_ms"))
    rows = answers.join(asked, ["conv_id", "turn"]).join(docs, "conv_id").join(times, "conv_id")
    a, q, s = F.col("a"), F.col("q"), F.col("s")
    return rows.select("conv_id", "turn", "latency_ms", F.round(J.faithfulness(a, s), 4).alias("faithfulness"), F.round(J.relevance(a, q, s), 4).alias("relevance"), F.round(J.coverage(a, s, F.col("answer"), F.col("expected")), 4).alias("coverage"), F.round(F.size(F.array_intersect(q, s)) / F.nullif(F.size(q), F.lit(0)), 4).alias("recall"))


@query(f"WITH {CASES} SELECT * FROM j")
def judges(spark, sf_dir):
    return judge_scores(spark, sf_dir)


LONG = """l AS (SELECT conv_id, turn, 'faithfulness' AS judge, faithfulness AS score FROM j UNION ALL SELECT conv_id, turn, 'relevance', relevance FROM j UNION ALL SELECT conv_id, turn, 'coverage', coverage FROM j),
    x AS (SELECT l.*, CASE turn % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END AS difficulty FROM l)"""


@query(f"WITH {CASES}, {LONG} SELECT difficulty, judge, count(*) AS n_scores, round(avg(score), 4) AS mean_score, round(avg(CASE WHEN score >= 0.5 THEN 1.0 ELSE 0.0 END), 4) AS pass_rate FROM x GROUP BY CUBE (difficulty, judge)")
def eval_report(spark, sf_dir):
    scores = judge_scores(spark, sf_dir).unpivot(["conv_id", "turn"], ["faithfulness", "relevance", "coverage"], "judge", "score")
    return M.report(scores.withColumn("difficulty", F.when(F.col("turn") % 3 == 0, "easy").when(F.col("turn") % 3 == 1, "medium").otherwise("hard")))


CATEGORY = "CASE WHEN faithfulness < 0.3 THEN 'hallucination' WHEN relevance < 0.3 THEN 'off_topic' WHEN latency_ms > 10000 THEN 'latency_exceeded' WHEN recall < 0.2 THEN 'retrieval_miss' WHEN coverage < 0.3 THEN 'low_coverage' ELSE 'unknown' END"


@query(f"""WITH {CASES}, f AS (SELECT conv_id * 1000 + turn AS case_id, {CATEGORY} AS category, round((faithfulness + relevance + coverage) / 3, 4) AS score FROM j)
    SELECT category, count(*) AS n_cases, round(avg(score), 4) AS mean_score, arg_min(case_id, (score, case_id)) AS worst_case FROM f WHERE score < 0.5 GROUP BY category""")
def failure_categories(spark, sf_dir):
    rows = judge_scores(spark, sf_dir)
    category = J.failure(F.col("faithfulness"), F.col("relevance"), F.col("coverage"), F.col("latency_ms"), F.col("recall"))
    score = F.round((F.col("faithfulness") + F.col("relevance") + F.col("coverage")) / 3, 4)
    return M.failures(rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("case_id"), category.alias("category"), score.alias("score")))


PATH = "CASE conv_id % 3 WHEN 0 THEN 'vector' WHEN 1 THEN 'pageindex' ELSE 'hybrid' END"


@query(f"""WITH {CASES}, p AS (SELECT {PATH} AS path, count(*) AS n, round(avg(faithfulness), 4) AS faithfulness, round(avg(coverage), 4) AS coverage, round(avg(latency_ms), 4) AS latency FROM j GROUP BY 1)
    SELECT *, row_number() OVER (ORDER BY faithfulness DESC, path) = 1 AS wins_faithfulness, row_number() OVER (ORDER BY coverage DESC, path) = 1 AS wins_coverage, row_number() OVER (ORDER BY latency, path) = 1 AS wins_latency FROM p""")
def path_comparison(spark, sf_dir):
    rows = judge_scores(spark, sf_dir).withColumn("path", F.expr(PATH)).withColumnRenamed("latency_ms", "latency")
    return M.compared(rows, "path", ["faithfulness", "coverage", "latency"])


def halves(spark, sf_dir):
    """Two versions of a corpus: what was loaded, and what a later load brings with changed and new texts."""
    docs = read(spark, sf_dir, "documents")
    old = docs.where("source < 'src5'").select("doc_id", "text", "lang", F.lit(1).alias("version"))
    new = docs.where("source >= 'src3'").select("doc_id", F.when(F.col("lang") == "de", F.concat("text", F.lit(" changed"))).otherwise(F.col("text")).alias("text"), "lang", F.lit(2).alias("version"))
    return old, new


HALVES = "old AS (SELECT doc_id, text, lang, 1 AS version FROM documents WHERE source < 'src5'), new AS (SELECT doc_id, CASE WHEN lang = 'de' THEN text || ' changed' ELSE text END AS text, lang, 2 AS version FROM documents WHERE source >= 'src3')"


@query(f"""WITH {HALVES}, a AS (SELECT DISTINCT md5(text) AS digest FROM old), b AS (SELECT DISTINCT md5(text) AS digest FROM new)
    SELECT coalesce(a.digest, b.digest) AS digest, CASE WHEN a.digest IS NULL THEN 'insert' WHEN b.digest IS NULL THEN 'orphan' ELSE 'reuse' END AS action FROM a FULL JOIN b ON a.digest = b.digest""")
def incremental_diff(spark, sf_dir):
    old, new = (h.select("doc_id", F.md5("text").alias("digest")) for h in halves(spark, sf_dir))
    return B.difference(old, new, "doc_id", "digest").select("digest", "action")


@query(f"""WITH {HALVES}, twice AS (SELECT doc_id, md5(text) AS text_md5, version FROM new UNION ALL SELECT doc_id, md5(text || ' again'), 3 FROM new WHERE lang = 'es'),
    n AS (SELECT doc_id, text_md5, version FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY version DESC) AS place FROM twice) WHERE place = 1)
    SELECT * FROM n UNION ALL SELECT doc_id, md5(text), version FROM old WHERE doc_id NOT IN (SELECT doc_id FROM new)""")
def upsert(spark, sf_dir):
    """The later load brings Spanish texts twice: the last one counts."""
    old, new = halves(spark, sf_dir)
    twice = new.unionByName(new.where("lang = 'es'").withColumns({"text": F.concat("text", F.lit(" again")), "version": F.lit(3)}))
    old, twice = (h.select("doc_id", F.md5("text").alias("text_md5"), "version") for h in (old, twice))
    return B.upsert(old, twice, ["doc_id"], ["version"])


@query(f"""WITH {HALVES}, v1 AS (SELECT doc_id, md5(text) AS text_md5, lang, version FROM old),
    twice AS (SELECT doc_id, md5(text) AS text_md5, lang, version FROM new UNION ALL SELECT doc_id, md5(text || ' again'), lang, 3 FROM new WHERE lang = 'es'),
    n AS (SELECT doc_id, text_md5, lang, version FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY version DESC) AS place FROM twice) WHERE place = 1),
    v2 AS (SELECT * FROM n UNION ALL SELECT * FROM v1 WHERE doc_id NOT IN (SELECT doc_id FROM n)),
    v3 AS (SELECT * FROM v2 WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE n_chars < 300)),
    v4 AS (SELECT * FROM v3 WHERE NOT (lang = 'fr' AND version = 1)),
    v5 AS (SELECT doc_id, text_md5, CASE WHEN version = 3 THEN 'es-again' ELSE lang END AS lang, version FROM v4)
    SELECT 1 AS table_version, * FROM v1 UNION ALL SELECT 2, * FROM v2 UNION ALL SELECT 3, * FROM v3 UNION ALL SELECT 4, * FROM v4 UNION ALL SELECT 5, * FROM v5""")
def versioned_table(spark, sf_dir):
    """A stored table through an upsert with repeated keys, a delete by keys, one by condition and an update; every version is read at the end."""
    old, new = halves(spark, sf_dir)
    twice = new.unionByName(new.where("lang = 'es'").withColumns({"text": F.concat("text", F.lit(" again")), "version": F.lit(3)}))
    old, twice = (h.select("doc_id", F.md5("text").alias("text_md5"), "lang", "version") for h in (old, twice))
    table = VersionedTable(spark, place(spark, "versioned-table"))
    table.create(old, ["doc_id"], buckets=16)
    table.upsert(twice, [F.col("version").desc()])
    table.delete(read(spark, sf_dir, "documents").where("n_chars < 300").select("doc_id"))
    table.delete_where((F.col("lang") == "fr") & (F.col("version") == 1))
    table.update_where(F.col("version") == 3, {"lang": F.lit("es-again")})
    versions = [table.read(v).select(F.lit(v).alias("table_version"), "doc_id", "text_md5", "lang", "version") for v in table.versions()]
    return reduce(DataFrame.unionByName, versions)


@query("SELECT doc_id, lang, source FROM documents WHERE NOT (lang = 'fr' AND n_chars < 1000)")
def delete_filtered(spark, sf_dir):
    return B.delete(read(spark, sf_dir, "documents"), (F.col("lang") == "fr") & (F.col("n_chars") < 1000)).select("doc_id", "lang", "source")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, epoch_us(max(ts)) AS at FROM events GROUP BY user_id")
def latest_status(spark, sf_dir):
    rows = B.latest(read(spark, sf_dir, "events"), ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()])
    return rows.select("user_id", F.col("event_type").alias("status"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def table_tool(spark, sf_dir):
    """The table tool's projection and equality without its row cap."""
    rows = read(spark, sf_dir, "orders")
    return B.query_table(rows, ["o_orderkey", "o_totalprice"], "o_orderstatus", "F", limit=None)


@query("SELECT vec_id, label, CASE WHEN label = 2 THEN 'archived' ELSE 'live' END AS status, 'team' || label AS team_id FROM embeddings")
def set_payload(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "label", F.create_map(F.lit("status"), F.lit("live"), F.lit("team_id"), F.concat(F.lit("team"), F.col("label").cast("string"))).alias("payload"))
    done = B.set_payload(rows, F.col("label") == 2, {"status": "archived"})
    return done.select("vec_id", "label", F.col("payload")["status"].alias("status"), F.col("payload")["team_id"].alias("team_id"))
