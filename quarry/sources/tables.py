"""Document tables on disk, upserts of vectors, declarative sources, and facades over them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.tables import query_table

VARIABLE = re.compile(r"\$\{(\w+)(?::([^}]*))?\}")


def filled(value, variables: dict[str, str]):
    """Configuration with ${NAME:default} replaced, in nested lists and maps too."""
    if isinstance(value, dict):
        return {k: filled(v, variables) for k, v in value.items()}
    if isinstance(value, list):
        return [filled(v, variables) for v in value]
    return VARIABLE.sub(lambda m: variables.get(m[1], m[2] or ""), value) if isinstance(value, str) else value


def register_views(spark: SparkSession, sources: dict[str, dict]) -> list[str]:
    """Temporary views of declared sources: name to format, path and options. JDBC sources name a table in their options."""
    for name, s in sources.items():
        if not re.fullmatch(r"[A-Za-z_]\w*", name):
            raise ValueError(f"bad source name {name}")
        reader = spark.read.format(s.get("format", "parquet")).options(**s.get("options", {}))
        (reader.load(s["path"]) if "path" in s else reader.load()).createOrReplaceTempView(name)
    return sorted(sources)


def tenant_views(spark: SparkSession, tables: dict[str, DataFrame], tenant: str, column: str = "team_id") -> list[str]:
    """Temporary views of one tenant's rows: what is asked of them can't see another tenant's."""
    if not tenant:
        raise ValueError("a tenant is required")
    for name, df in tables.items():
        df.where(F.col(column) == tenant).createOrReplaceTempView(name)
    return sorted(tables)


def run_sql(spark: SparkSession, statement: str, limit: int | None = 100, parameters: dict | None = None) -> DataFrame:
    """A read-only statement's first rows; what the guard refuses isn't planned. Values are bound, never pasted in."""
    why = spark.createDataFrame([(statement,)], "q string").select(T.sql_refusal(F.col("q"))).head()[0]
    if why:
        raise ValueError(why)
    out = spark.sql(statement, args=parameters or {})
    return out if limit is None else out.limit(limit)


CASE = "id string, query string, expected_answer string, difficulty string, tags array<string>"
FAILURE = "case_id long, category string, score double"


def write_cases(cases: DataFrame, path: str) -> None:
    """Golden cases as JSON lines."""
    cases.write.mode("overwrite").json(path)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CASE).json(path)


def write_failures(failed: DataFrame, path: str) -> None:
    """A failure report: rows by category and a summary of each category beside them."""
    failed.write.mode("overwrite").partitionBy("category").json(f"{path}/rows")
    worst = F.min_by("case_id", F.struct("score", "case_id"))
    failed.groupBy("category").agg(F.count("*").alias("n_cases"), F.avg("score").alias("mean_score"), worst.alias("worst_case")).write.mode("overwrite").json(f"{path}/summary")


def read_failures(spark: SparkSession, path: str, category: str | None = None) -> DataFrame:
    """Failed cases; one category reads that category's files alone."""
    rows = spark.read.schema(FAILURE).json(f"{path}/rows")
    return rows if category is None else rows.where(F.col("category") == category)


# fixed value: what stands behind a text that was cut
TRUNCATED = "\n\n[TRUNCATED: Result exceeded {most} bytes]"


def capped(column, most: int = 5 * 1024 * 1024):
    """A text of at most so many bytes, with a mark where it was cut."""
    cut = F.decode(F.substring(F.encode(column, "utf-8"), 1, most), "utf-8")
    return F.when(F.octet_length(column) > most, F.concat(cut, F.lit(TRUNCATED.format(most=most)))).otherwise(column)


def store(df: DataFrame, path: str, tenant: str = "team_id") -> None:
    """Rows by tenant: reading one tenant's reads no other's files."""
    df.write.mode("append").partitionBy(tenant).parquet(path)


def load(spark: SparkSession, path: str, tenant: str, column: str = "team_id") -> DataFrame:
    """One tenant's rows; refuses to plan without a tenant."""
    if not tenant:
        raise ValueError("a tenant is required")
    return spark.read.parquet(path).where(F.col(column) == tenant)


def delete_document(tables: dict[str, DataFrame], doc_ids: DataFrame) -> dict[str, DataFrame]:
    """All tables without the documents: texts, chunks and vectors alike."""
    return {name: df.join(doc_ids.select("doc_id"), "doc_id", "left_anti") for name, df in tables.items()}


def feedback(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """Feedback on documents of the team that gives it; without a document it passes."""
    owned = documents.select("doc_id", "team_id")
    return rows.where("document_id IS NULL").unionByName(rows.join(owned, (rows.document_id == owned.doc_id) & (rows.team_id == owned.team_id), "left_semi"))


def listed(spark: SparkSession, path: str, tenant: str, namespace: str | None = None, schema: str = "doc_id string, team_id string, namespace string, status string") -> DataFrame:
    """A tenant's document records, JSON lines, in one namespace or all; what isn't a record is skipped."""
    if not tenant:
        raise ValueError("a tenant is required")
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).where(F.col("team_id") == tenant)
    return rows if namespace is None else rows.where(F.col("namespace") == namespace)


# fixed values: endings of files that are never opened
BLOCKED = (".exe", ".dll", ".so")


# fixed values: endings of files that hold text
TEXT = (".json", ".csv", ".txt", ".md", ".xml", ".yaml", ".yml", ".html", ".htm", ".log", ".tsv", ".sql", ".py", ".js", ".ts", ".java", ".go", ".rs", ".toml", ".ini", ".cfg", ".env", ".sh", ".bat", ".ps1", ".dockerfile")
# fixed value: what is said of a file that holds none
BINARY = "Binary file."


def objects(spark: SparkSession, path: str, pattern: str = "*", most: int = 5 * 1024 * 1024, prefixes: tuple[str, ...] = (), blocked: tuple[str, ...] = BLOCKED, text: tuple[str, ...] = TEXT) -> DataFrame:
    """path, length, text, note of files below a path that fit a pattern, a size and, if there are any, one of the prefixes below it. Text is UTF-8, or Latin-1 where it isn't; a file whose ending isn't one of text has a note instead; files with a blocked ending are never opened."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load([f"{path.rstrip('/')}/{p}" for p in prefixes] if prefixes else path)
    files = files.where(F.col("length") <= most)
    for ending in blocked:
        files = files.where(~F.lower("path").endswith(ending))
    ending = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    read = F.when(ending.isin(*text), F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).otherwise(F.decode("content", "ISO-8859-1")))
    return files.select("path", "length", read.alias("text"), F.when(~ending.isin(*text), BINARY).alias("note"))


class Tools:
    """Tools over tables by name, each a function of its arguments that gives a DataFrame; every table gets one to query it."""

    def __init__(self):
        self.tools: dict = {}

    def register(self, name: str, handler) -> None:
        if not re.fullmatch(r"[A-Za-z_][\w.]*", name):
            raise ValueError(f"bad tool name {name}")
        self.tools[name] = handler

    def register_table(self, name: str, df: DataFrame) -> None:
        self.register(f"query_{name}", lambda columns=None, where=None, value=None, limit=50: query_table(df, columns or df.columns, where, value, limit))

    def toolset(self, names: list[str]) -> dict:
        """The named tools; names without one are skipped."""
        return {n: self.tools[n] for n in names if n in self.tools}

    def call(self, name: str, **arguments) -> DataFrame:
        if name not in self.tools:
            raise ValueError(f"no tool {name}")
        return self.tools[name](**arguments)

    def register_statement(self, name: str, spark: SparkSession, statement: str, parameters: dict | None = None, limit: int | None = 100, most: int | None = None) -> None:
        """A tool that runs a read-only statement: arguments are bound to its named parameters, and those that aren't given have their defaults. Texts are cut at most bytes."""
        defaults = dict(parameters or {})

        def run(**arguments) -> DataFrame:
            if unknown := set(arguments) - set(defaults):
                raise ValueError(f"unknown parameters {sorted(unknown)}")
            rows = run_sql(spark, statement, limit, defaults | arguments)
            return rows if most is None else rows.withColumns({f.name: capped(F.col(f.name), most) for f in rows.schema.fields if f.dataType.simpleString() == "string"})

        self.register(name, run)

    @classmethod
    def declared(cls, spark: SparkSession, config: dict, variables: dict[str, str]) -> tuple["Tools", dict[str, list[str]]]:
        """Views, tools and toolsets of a declaration with variables filled in: sources by name as in register_views, tools with a source and its columns or with a statement, and toolsets as lists of tools. A tool or toolset that names what isn't declared is refused."""
        config, out = filled(config, variables), cls()
        known = register_views(spark, config.get("sources", {}))
        for name, tool in config.get("tools", {}).items():
            if "statement" in tool:
                out.register_statement(name, spark, tool["statement"], tool.get("parameters"), tool.get("limit", 100), tool.get("max_bytes"))
            elif tool.get("source") in known:
                df, columns, cap = spark.table(tool["source"]), tool.get("columns"), tool.get("limit", 50)
                out.register(name, lambda columns=None, where=None, value=None, limit=cap, df=df, allowed=columns: query_table(df.select(*(allowed or df.columns)), columns or allowed or df.columns, where, value, limit))
            else:
                raise ValueError(f"tool {name} has neither a statement nor a declared source")
        sets = config.get("toolsets", {})
        for name, tools in sets.items():
            if missing := [t for t in tools if t not in out.tools]:
                raise ValueError(f"toolset {name} names unknown tools {missing}")
        return out, sets


def healthy(spark: SparkSession, names: list[str]) -> dict[str, bool]:
    """Whether each view can be read: its first row is asked for."""
    out = {}
    for name in names:
        try:
            spark.table(name).limit(1).count()
            out[name] = True
        except Exception:
            out[name] = False
    return out
