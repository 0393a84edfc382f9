"""The queries of training-data operators that SQL expresses, against DuckDB over whole tables."""

import duckdb
import pytest

from ocellus.llm import licenses, queries


def same(spark, name, folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet{'' if 'testdata' in str(folder) else '/*.parquet'}')")
    want = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, str(folder))
    assert sorted(got.columns) == sorted(columns)
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=key) == sorted(want.fetchall(), key=key)
    return got


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_equals_sql(spark, name, sf):
    same(spark, name, f"/root/testdata/{sf}")


def test_licenses_equal_sql_where_some_match(spark, tmp_path):
    texts = [body for _, body in licenses.bodies(licenses.KNOWN)]
    texts += [f"{k} License\n\nCopyright (c) 2020 Some Holder\nAll rights reserved.\n\n{body}".upper() for k, body in licenses.bodies(licenses.KNOWN)]
    rows = [*enumerate(texts), (-1, None), (-2, ""), (-3, texts[0] + " more")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = same(spark, "op2_license_scan", tmp_path)
    assert got.filter("license is not null").count() >= 1.5 * len(texts) / 2
