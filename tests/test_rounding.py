"""Rounded values are those of the SQL to the last bit, signs of zeros included."""

import struct

import duckdb

from scene_analytics import queries as library


def test_units_are_those_of_the_sql_bit_by_bit(spark, tmp_path):
    rows = [(0, [1.0, -1e-7, 4e-7, -4.9e-7]), (1, [-0.0, 0.0, 1.0, -5e-7]), (2, [0.0, -0.0]), (3, [3.0, -4.0]), (4, [-2e-7, 1e-3, 2.5, -2.5]), (5, [-1e-15, 0.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, label int")
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    bits = lambda found: {i: struct.pack(f"<{len(v)}d", *v) for i, v in found}
    got = bits((r.vec_id, r.unit) for r in library.l2_normalize(spark, str(tmp_path)).collect())
    assert got == bits(con.execute(library.ORACLES["l2_normalize"]).fetchall())
