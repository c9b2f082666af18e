"""Scans that tell what they could not read, versions that are whole or absent, and prepared tables that notice a change."""

import threading

import pytest
from pyspark.sql import functions as F

from sward import sources
from sward.plans import shared
from sward.session import scratch


def test_scan_counts_what_it_cannot_read(spark, tmp_path):
    (tmp_path / "a.csv").write_text('site,n,x\nA,1,2.5\nB,two,NA\nNA,3,-\n"C, c",4,1e3\nD,5\nE,6,7,8\n,9,0\n')
    df = sources.scan_csv(spark, str(tmp_path / "a.csv"), "site string, n int, x double")
    rows = {(r.site, r.n, r.x): (r._unread, r._line) for r in df.collect()}
    assert rows[("A", 1, 2.5)] == ([], None) and rows[("B", None, None)] == (["n"], None) and rows[(None, 3, None)] == (["x"], None)
    assert rows[("C, c", 4, 1000.0)] == ([], None) and rows[("D", 5, None)] == ([], "D,5") and rows[("E", 6, 7.0)] == ([], "E,6,7,8")
    report = {r.column: (r.n_rows, r.n_bad_lines, r.n_missing, r.n_unread) for r in sources.scan_report(df).collect()}
    assert report["n"] == (7, 2, 1, 1) and report["x"] == (7, 2, 3, 1)
    (tmp_path / "none.csv").write_text("site,n,x\n")
    assert sources.scan_csv(spark, str(tmp_path / "none.csv"), "site string, n int, x double").count() == 0


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_versions(spark, rows, fmt):
    folder = scratch(spark, "test_versions")
    first = rows("g string, x double, n int", [("a", 1.5, 1), (None, None, 2), ("NULL", 3.0, None)])
    assert sources.versions(spark, folder) == []
    with pytest.raises(ValueError):
        sources.read_version(spark, folder)
    assert sources.write_version(first, folder, fmt) == 1 and sources.write_version(first.where("x > 2"), folder, fmt, ["n"] if fmt == "parquet" else ()) == 2
    assert sorted(map(str, sources.read_version(spark, folder, 1).collect())) == sorted(map(str, first.collect()))
    assert [(r.g, r.x, r.n) for r in sources.read_version(spark, folder).collect()] == [("NULL", 3.0, None)]


def test_a_failed_write_is_not_seen_and_writers_do_not_collide(spark, rows):
    folder = scratch(spark, "test_writers")
    df = rows("x int", [(1,), (2,)])
    with pytest.raises(Exception, match="no"):
        sources.write_version(df.select(F.raise_error(F.lit("no")).alias("x")), folder)
    assert sources.versions(spark, folder) == []
    numbers = []
    threads = [threading.Thread(target=lambda: numbers.append(sources.write_version(df, folder))) for _ in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(numbers) == sources.versions(spark, folder) and len(set(numbers)) == 4
    assert all(sources.read_version(spark, folder, n).count() == 2 for n in numbers)


def test_prepared_tables_follow_rewritten_files(spark, rows):
    folder = scratch(spark, "test_source")

    def kept():
        return shared.keep(spark, folder, "kept", lambda: spark.read.parquet(f"{folder}/t.parquet"), ["x"], buckets=2)

    rows("x int", [(1,)]).write.parquet(f"{folder}/t.parquet")
    first = kept()
    assert first.count() == 1 and kept() is first
    rows("x int", [(1,), (2,)]).write.mode("overwrite").parquet(f"{folder}/t.parquet")
    second = kept()
    assert second.count() == 2 and first.count() == 1
    rows("x int", [(3,)] * 5).write.mode("overwrite").parquet(f"{folder}/t.parquet")
    assert kept().count() == 5 and second.count() == 2
    with pytest.raises(Exception, match="NOT_FOUND|does not exist|DOES_NOT_EXIST|FAILED_READ"):
        first.count()
