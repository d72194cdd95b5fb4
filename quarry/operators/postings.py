"""An inverted index in bands of impact, for exact sparse search.

Terms of documents with their frequencies are stored twice: by documents, and as postings in bands of falling frequency, one folder
a band. A table of terms has, for each term and band, the number of postings and the highest frequency. A search for the k best
sums of products of frequencies reads the highest bands first: the k-th best of these partial sums is a bar that each query's results
must reach. What a document that stands only in bands below some band could reach is a sum of the highest frequencies there, so the
bar says down to which band a query has to read; what was found there is dropped if its sum and the most that its other terms
could add stay below the bar, and only the rest is looked up by documents. A search for documents with a share of the query's terms
reads the postings of the rarest ones alone: a document without any of those has too few.

Defined cases: null and empty texts have no terms and are never found; queries without terms find nothing; ties go to the smaller
document; fewer documents than k that share a term give all of them; queries with one id are one query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.stored import stored
from .search import postings, top

#: Bands to a doubling of the frequency; the share of all postings that is read first.
FINE, FIRST = 1, 0.02
#: Folders of documents, so that looking up a few reads a few.
PARTS = 8


class Index:
    """Postings of documents, stored."""

    def __init__(self, docs: DataFrame, doc: str = "doc_id"):
        self.doc, self._asked, self._seen = doc, [], []
        counts = T.sparse_words(docs, doc).groupBy(doc, "token").agg(F.count("*").alias("tf"))
        counts = counts.withColumns({"band": F.floor(F.log2("tf") * FINE).cast("int"), "part": F.pmod(F.xxhash64(doc), F.lit(PARTS)).cast("int")})
        self.documents = stored(counts, "index-documents", ["part"])
        self.inverted = stored(self.documents.drop("part").sortWithinPartitions("band", "token"), "index-postings", ["band"])
        self.terms = stored(self.inverted.groupBy("token", "band").agg(F.count("*").alias("n"), F.max("tf").alias("most")), "index-terms")
        #: Bands, the highest first, with their postings: as many as the highest frequency has bits.
        self.bands = [(r[0], r[1]) for r in self.terms.groupBy("band").agg(F.sum("n")).orderBy(F.col("band").desc()).collect()]

    def read(self) -> tuple[int, int]:
        """Postings that searches have read, and those of documents looked up: the latter are known once a search has run."""
        return sum(rows.agg(F.sum("n")).head()[0] or 0 for rows in self._asked), sum(o.get["n"] for o in self._seen)

    def high(self) -> int:
        """The lowest of the highest bands that hold a small share of the postings."""
        held, out = 0, self.bands[0][0]
        for band, n in self.bands:
            held += n
            if held > FIRST * sum(n for _, n in self.bands):
                break
            out = band
        return out

    def looked_up(self, pairs: DataFrame, terms: DataFrame, query: str) -> DataFrame:
        """query, doc, token, tf, and what terms says of the token, of pairs."""
        parts = [r[0] for r in pairs.select(F.pmod(F.xxhash64(self.doc), F.lit(PARTS)).cast("int")).distinct().collect()]  # at most PARTS
        own = self.documents.where(F.col("part").isin(parts)).select(self.doc, "token", "tf", "band")
        own = own.join(pairs.select(self.doc).distinct(), self.doc, "left_semi")
        self._seen.append(Observation())
        own = own.observe(self._seen[-1], F.count(F.lit(1)).alias("n"))
        return own.join(terms, "token").join(pairs, [query, self.doc], "left_semi")

    def best(self, queries: DataFrame, query: str, k: int) -> DataFrame:
        """query, doc, score, rank of the k best documents of each query."""
        terms = stored(postings(queries, query), "index-queries")
        if not self.bands:
            return terms.select(query, F.lit(None).cast(self.documents.schema[self.doc].dataType).alias(self.doc), F.lit(0).cast("long").alias("score"), F.lit(0).alias("rank")).limit(0)
        value = F.col("tf") * F.col("q_tf")
        start = self.high()
        self._asked.append(self.terms.where(F.col("band") >= start))
        first = self.inverted.where(F.col("band") >= start).join(terms, "token").groupBy(query, self.doc).agg(F.sum(value).alias("so_far"))
        bars = top(first, [query], [F.col("so_far").desc()], k).where(F.col("rank") == k).select(query, F.col("so_far").alias("bar"))
        # what a document below each band can have, at most; the highest band below which nothing reaches the bar
        most = terms.join(self.terms, "token").select(query, "token", "band", (F.col("most") * F.col("q_tf")).alias("value"))
        floors = F.explode(F.array(*(F.lit(b) for b, _ in self.bands))).alias("floor")
        below = most.select("*", floors).groupBy(query, "floor", "token").agg(F.max(F.when(F.col("band") < F.col("floor"), F.col("value")).otherwise(0)).alias("below"))
        rest = below.groupBy(query, "floor").agg(F.sum("below").alias("rest")).join(bars, query, "left").where("rest = 0 or rest < bar")
        limits = stored(rest.groupBy(query, "bar").agg(F.max(F.struct("floor", "rest")).alias("f")).select(query, "bar", "f.*"), "index-limits")
        asked = stored(terms.join(limits, query).join(below, [query, "floor", "token"]).select(query, "token", "q_tf", "floor", "below"), "index-asked")
        self._asked.append(self.terms.join(asked.groupBy("token").agg(F.min("floor").alias("floor")), "token").where((F.col("band") >= F.col("floor")) & (F.col("band") < start)))
        seen = self.inverted.join(asked, "token").where(F.col("band") >= F.col("floor"))
        seen = seen.groupBy(query, self.doc).agg(F.sum(value).alias("so_far"), F.sum("below").alias("known"))
        open_ = F.expr("bar is null or so_far + rest - known >= bar")
        seen = stored(seen.join(limits, query).where(open_).select(query, self.doc, "so_far", "known", "rest"), "index-seen")
        # more has been read than at first: the bar has risen
        bars = top(seen, [query], [F.col("so_far").desc()], k).where(F.col("rank") == k).select(query, F.col("so_far").alias("bar"))
        left = stored(seen.join(bars, query, "left").where(open_).select(query, self.doc, "so_far", (F.col("rest") > F.col("known")).alias("more")), "index-left")
        added = self.looked_up(left.where("more").select(query, self.doc), asked, query).where(F.col("band") < F.col("floor"))
        added = added.groupBy(query, self.doc).agg(F.sum(value).alias("added"))
        scored = left.join(added, [query, self.doc], "left").select(query, self.doc, (F.col("so_far") + F.coalesce("added", F.lit(0))).alias("score"))
        return top(scored, [query], [F.col("score").desc(), self.doc], k)

    def sharing(self, queries: DataFrame, query: str, share: float) -> DataFrame:
        """query, doc, n, score and size (the query's terms) of all documents that have at least that share of a query's terms."""
        terms = stored(postings(queries, query), "index-queries")
        often = self.terms.groupBy("token").agg(F.sum("n").alias("often"))
        place = F.row_number().over(Window.partitionBy(query).orderBy(F.coalesce("often", F.lit(0)), "token"))
        ranked = terms.join(often, "token", "left").withColumn("place", place).withColumn("size", F.count("*").over(Window.partitionBy(query)))
        ranked = stored(ranked, "index-ranked")
        least = F.greatest(F.lit(1), F.ceil(F.lit(share) * F.col("size")))
        few = ranked.where(F.col("place") <= F.col("size") - least + 1)
        self._asked.append(self.terms.join(few.select("token").distinct(), "token"))
        pairs = stored(self.inverted.join(few.select(query, "token"), "token").select(query, self.doc).distinct(), "index-pairs")
        found = self.looked_up(pairs, terms, query).groupBy(query, self.doc).agg(F.count("*").alias("n"), F.sum(F.col("tf") * F.col("q_tf")).alias("score"))
        sizes = ranked.select(query, "size").distinct()
        return found.join(sizes, query).where(F.col("n") >= F.lit(share) * F.col("size"))


_built: dict[tuple, Index] = {}


def index_of(docs: DataFrame, doc: str = "doc_id") -> Index:
    """The index of a table of files, built at its first search in a session: later searches read what is stored."""
    key = (docs.sparkSession.sparkContext.applicationId, doc, tuple(sorted(docs.inputFiles())))
    if key not in _built:
        for old in [k for k in _built if k[0] != key[0]]:  # of sessions that are over
            del _built[old]
        _built[key] = Index(docs, doc)
    return _built[key]
