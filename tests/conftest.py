import duckdb
import pytest
from pyspark.sql import SparkSession

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "3g").config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def _same(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(_same, v))
    return v


@pytest.fixture(scope="session")
def agrees(spark):
    """Whether a query's rows are those of its SQL over the same tables, in any order."""

    def run(query, sql, sf_dir=SF):
        con = duckdb.connect()
        for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
        want = con.execute(sql)
        names = [c[0] for c in want.description]
        df = query(spark, sf_dir)
        assert sorted(df.columns) == sorted(names)
        rows = lambda found, cols: sorted(([_same(r[cols.index(c)]) for c in sorted(cols)] for r in found), key=repr)
        got = rows([tuple(r) for r in df.collect()], df.columns)
        assert got == rows(want.fetchall(), names)
        return len(got)

    return run
