import duckdb
import numpy as np
from pyspark.sql import functions as F

from millrace.functions.rounding import published, published_sql


def test_published_rounding(spark):
    rng = np.random.default_rng(0)
    xs = [2.675, 0.125, 0.375, 1.005, 2.5, 3.5, -2.675, -0.125, 0.0, -0.0, 1e300, -1e17, 5e-324, 0.5, 1.5, 1e-9, 4503599627370495.5, 0.145, 8.345]
    xs += (rng.integers(-10**6, 10**6, 4000) / 1000).tolist() + (rng.integers(0, 10**5, 2000) / 32).tolist() + (rng.normal(size=2000) * 10.0 ** rng.integers(-6, 9, 2000)).tolist()
    df = spark.createDataFrame([(k, float(x)) for k, x in enumerate(xs)] + [(len(xs), None)], "k int, x double")
    got = df.select("k", *[published(F.col("x"), d).alias(f"r{d}") for d in range(5)]).orderBy("k").collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE t AS SELECT unnest(?::DOUBLE[]) AS x", [xs])
    other = con.execute("SELECT " + ", ".join(published_sql("x", d) for d in range(5)) + " FROM t").fetchall()
    for k, x in enumerate(xs):
        want = [round(x, d) for d in range(5)]
        assert [got[k][f"r{d}"] for d in range(5)] == want, x
        assert list(other[k]) == want, x
    assert got[-1]["r2"] is None
