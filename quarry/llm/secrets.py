"""Secrets in whole texts, and weak credential parts that count only beside their complements (DataFrame operations only).

Spans of fixed kinds (assign, access, hex) are always reported. Weak parts (identifier, key, endpoint) are reported only
when complementary parts stand within the same scope: a document, within WINDOW code points. The parts meet in left semi
joins on the document and cells of the scope, so no list of pairs is made.

Defined cases: a null or empty text has no spans; a null doc_id is kept; repeated rows are scanned and reported one by
one; equal starts order by kind; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import stored

#: Kind, pattern, the group whose length counts, and its least length. Fixed values.
BASE = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
WEAK = (
    ("identifier", r"""(?i:(access_?key_?id|client_?id|account_?id|user_?name|login))["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]+)""", 2, 4),
    ("key", r"[A-Za-z0-9+/]{32,}={0,2}", 0, 32),
    ("endpoint", r"""(?i:(https?://|host["']?\x20*[:=]\x20*["']?))([A-Za-z0-9.-]+)""", 2, 4),
)
#: A bare key has letters of both cases and a digit.
KEY = r"^(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9])"
#: Code points between complementary parts at most.
WINDOW = 256

KINDS = [k for k, *_ in BASE + WEAK]
SPAN = "array<struct<start:long,kind:int,end:long>>"


def matches(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """Leftmost non-overlapping matches in order: code points between the last one and this, those of this, and whether it passes."""
    found = F.arrays_zip(
        F.transform(F.split(text, pattern, -1), F.length).alias("gap"),
        F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length).alias("size"),
        F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda v: (F.length(v) >= least) & (v.rlike(KEY) if kind == "key" else F.lit(True))).alias("passes"),
    )
    told_ = F.transform(F.filter(found, lambda x: x["size"].isNotNull()), lambda x: F.struct(F.lit(KINDS.index(kind)).alias("kind"), x["gap"].cast("long").alias("gap"), x["size"].cast("long").alias("size"), x["passes"].alias("passes")))
    return F.when(text.rlike(pattern), told_).otherwise(F.array().cast("array<struct<kind:int,gap:long,size:long,passes:boolean>>"))


def spans(scanned: DataFrame) -> DataFrame:
    """row, kind, start, end of the matches that pass: a running sum of gaps and sizes gives the places, one pass over a row's matches however many."""
    found = scanned.select("row", F.posexplode("found").alias("number", "match")).select("row", "number", "match.*")
    before = Window.partitionBy("row", "kind").orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("size")).over(before)
    return found.withColumn("end", end).where("passes").select("row", "kind", (F.col("end") - F.col("size")).alias("start"), "end")


def apart(found: DataFrame) -> DataFrame:
    """Without the weak spans that overlap a base span: the farthest end of the base spans that start before a weak span ends tells."""
    base = F.col("kind") < len(BASE)
    at = found.withColumn("at", F.when(base, F.col("start")).otherwise(F.col("end") - 1))
    farthest = F.max(F.when(base, F.col("end"))).over(Window.partitionBy("row").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return at.withColumn("farthest", farthest).where(base | F.coalesce(F.col("farthest") <= F.col("start"), F.lit(True))).drop("at", "farthest")


def told(parts: Column) -> Column:
    """kind:start:end, by start and then by kind, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(parts, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def linked(parts: DataFrame) -> DataFrame:
    """Weak spans that stand beside their complements: row, kind, start, end."""
    kind = {k: i for i, k in enumerate(KINDS)}
    of = lambda *kinds: parts.where(F.col("kind").isin([kind[k] for k in kinds]))
    ids, keys, ends = of("identifier", "access"), of("key", "assign", "hex"), of("endpoint")

    def beside(left: DataFrame, right: DataFrame) -> DataFrame:
        """Interval join: rows of left with one of right within the window; right posts itself in all cells that its window touches."""
        cells = F.sequence(F.floor((F.col("start") - WINDOW) / WINDOW), F.floor((F.col("end") + WINDOW) / WINDOW))
        near = right.select(F.col("row").alias("r_row"), F.col("start").alias("r_start"), F.col("end").alias("r_end"), F.explode(cells).alias("r_cell"))
        # a long left span may begin a cell before the window of what follows it
        wide = left.withColumn("l_cell", F.explode(F.sequence(F.floor(F.col("start") / WINDOW), F.floor(F.col("end") / WINDOW))))
        on = (F.col("row") == F.col("r_row")) & (F.col("l_cell") == F.col("r_cell")) & (F.col("start") <= F.col("r_end") + WINDOW) & (F.col("r_start") <= F.col("end") + WINDOW)
        return wide.join(near, on, "left_semi").drop("l_cell").distinct()

    near_ids, near_keys = beside(ids, keys), beside(keys, ids)
    return near_ids.unionByName(near_keys).unionByName(beside(beside(ends, near_ids), near_keys)).where(F.col("kind") >= len(BASE))


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Per document: counts and digest of the base spans, and all spans."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = F.concat(*(matches(text, *k) for k in BASE + WEAK))
    scanned = stored(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", found.alias("found")), "secret-matches")
    parts = stored(apart(spans(scanned.where(F.size("found") > 0))), "secret-spans")
    every = parts.where(F.col("kind") < len(BASE)).unionByName(linked(parts))
    of_row = every.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))
    out = scanned.select("row", "doc_id").join(of_row, "row", "left").withColumn("spans", F.coalesce("spans", F.array().cast(SPAN)))
    out = out.withColumn("base", F.filter("spans", lambda s: s["kind"] < len(BASE)))
    count = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")
    return out.select(
        "doc_id",
        *(count(i).alias(f"n_{k}") for i, (k, *_) in enumerate(BASE)),
        F.sha2(told(F.col("base")), 256).alias("base_sha256"),
        told(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size("base")).cast("long").alias("n_linked"),
    )
