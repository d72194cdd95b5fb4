import glob
import os

import pytest
from pyspark.sql import functions as F

from quarry.sources.versions import Conflict, VersionedTable


@pytest.fixture
def table(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t")
    rows = spark.createDataFrame([(i, f"a{i}", "x" if i % 2 else None) for i in range(40)] + [(None, "none", "x")], "k long, v string, w string")
    assert t.create(rows, ["k"], buckets=16) == 1
    return t


def files(t):
    return {os.path.relpath(f, t.path.removeprefix("file://")) for f in glob.glob(t.path.removeprefix("file://") + "/data/*/*/*.parquet")}


def got(df):
    return sorted(((r.k is None, r.k or 0), r.v) for r in df.collect())


def test_upsert_rewrites_only_the_buckets_it_hits(spark, table):
    before, first = files(table), got(table.read())
    new = spark.createDataFrame([(3, "new", "y", 1), (3, "newer", "y", 2), (100, "added", None, 1), (None, "other", None, 1)], "k long, v string, w string, at int")
    order = [F.col("at").desc()]
    assert table.upsert(new, order) == 2
    a, b = table.manifest(1)["places"], table.manifest(2)["places"]
    moved = {k for k in b if a.get(k) != b[k]}
    assert 1 <= len(moved) <= 3 and before <= files(table)
    want = {k: v for k, v in first} | {(False, 3): "newer", (False, 100): "added", (True, 0): "other"}
    assert dict(got(table.read())) == want and len(got(table.read())) == 42
    assert got(table.read(1)) == first


def test_deletes(spark, table):
    assert table.delete(spark.createDataFrame([(5,), (None,), (77,)], "k long")) == 2
    assert table.delete_where(F.col("w") == "x") == 3
    assert [k for (_, k), _ in got(table.read())] == list(range(0, 40, 2))
    before = table.manifest()["places"]
    assert table.delete_where(F.col("k") > 1000) == 4 and table.manifest()["places"] == before
    assert table.delete_where(F.lit(True)) == 5 and got(table.read()) == [] and table.read().columns == ["k", "v", "w"]
    assert len(got(table.read(1))) == 41


def test_updates_see_the_old_row(spark, table):
    table.update_where(F.col("k") < 2, {"v": F.lit("set"), "w": F.col("v")})
    rows = {r.k: (r.v, r.w) for r in table.read().collect()}
    assert rows[0] == ("set", "a0") and rows[1] == ("set", "a1") and rows[2] == ("a2", None)
    with pytest.raises(ValueError):
        table.update_where(F.lit(True), {"k": F.lit(1)})


def test_lookup_reads_only_the_keys_buckets(spark, table):
    keys = spark.createDataFrame([(7,), (8,)], "k long")
    found = table.lookup(keys)
    assert got(found) == [((False, 7), "a7"), ((False, 8), "a8")]
    assert len({f.rpartition("/")[0] for f in found.inputFiles()}) <= 2


def test_a_failed_write_leaves_the_old_version(spark, table, monkeypatch):
    first = got(table.read())
    new = spark.createDataFrame([(3, "new", "y")], "k long, v string, w string")
    with pytest.raises(Exception):
        table.upsert(new.withColumn("v", F.raise_error(F.lit("stop"))), ["v"])
    monkeypatch.setattr(table, "_commit", lambda manifest: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        table.upsert(new, ["v"])
    monkeypatch.undo()
    assert table.versions() == [1] and got(table.read()) == first
    kept = len(files(table))
    assert table.expire(1) == [] and len(files(table)) < kept and got(table.read()) == first


def test_of_two_writers_one_wins(spark, table):
    old = table.manifest()
    table.delete(spark.createDataFrame([(5,)], "k long"))
    with pytest.raises(Conflict):
        table._replace(old, [1], table.read().limit(0))
    assert len(got(table.read())) == 40
    with pytest.raises(Conflict):
        table.create(table.read(), ["k"])
    with pytest.raises(ValueError):
        table.read(9)
    assert table.expire(1) == [1] and table.versions() == [2] and len(got(table.read())) == 40
