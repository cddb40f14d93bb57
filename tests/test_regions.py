import duckdb
import pytest
from oracle import differences

from evigrid import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name, classes", [("q2_region_in_full", "(VALUES ('A'), ('N'), ('R')) f(r), (VALUES ('F'), ('O')) s(s)"), ("q4_q9_map_info_in_full", "(SELECT '' AS r, '' AS s WHERE false) f")])
def test_rows_about_no_cells(spark, tmp_path, name, classes):
    """All classes alike in every cell, so that none is as sure as the box wants; and a map without points."""
    c = duckdb.connect()
    c.execute(f"COPY (SELECT l.* REPLACE (r AS l_returnflag, s AS l_linestatus) FROM '{SF}/lineitem.parquet' l, {classes}) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    c.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    c.execute(f"CREATE VIEW nation AS SELECT * FROM '{SF}/nation.parquet'")
    found = differences(registry.QUERIES[name](spark, str(tmp_path)), registry.ORACLE_SQL[name], c)
    assert all(repr(a) == repr(b) for a, b in found)  # lists of NaN aren't equal
