import duckdb

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
TABLES = ["orders", "events", "lineitem", "documents", "customer", "supplier", "part", "nation", "region"]


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() == 952
    assert "ufid" in df.columns


def test_every_query_has_oracle_or_is_marked():
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q)
    assert len(q) >= 50


def _canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    norm = lambda v: round(v, 6) if isinstance(v, float) else v
    return [cols[i] for i in order], sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def test_selected_queries_match_oracle(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    q, s = E.queries(), E.oracle_sql()
    for name in ["relate_polygons", "relate_lines", "connected_components", "finalise_layer", "stitch_layer", "append_report", "detect_key"]:
        df = q[name](spark, SF)
        rel = con.sql(s[name])
        assert _canon(df.columns, [tuple(r) for r in df.collect()]) == _canon(rel.columns, rel.fetchall()), name
