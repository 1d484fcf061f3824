"""Operators that SQL can express give the same rows as DuckDB, on the tables and on odd rows."""

import duckdb
import pytest

from quillon.llm import queries

SF = "/root/testdata/sf0.001"


def same(spark, folder, name):
    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet{'/*.parquet' if folder != SF else ''}')")
    got = queries.queries()[name](spark, folder)
    out = c.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in out.description]
    assert sorted(columns) == sorted(got.columns)
    rows = lambda found: sorted(repr(tuple(r[k] for k in sorted(range(len(columns)), key=columns.__getitem__))) for r in found)
    assert rows(got.select(*columns).collect()) == rows(out.fetchall())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_duckdb(spark, name):
    same(spark, SF, name)


def test_archives_of_odd_pages(spark, tmp_path):
    rows = [(1, None, None), (2, "u", ""), (3, "u", "<p>ü</p>"), (4, "v", "<p>ü</p>"), (4, "v", "<p>ü</p>"), (None, "u", "<p>ü</p>"), (9, "u", "x" * 100_000)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    same(spark, str(tmp_path), "op7_warc_seekable_bundles")
