"""What a reviewer found in round 4: labels in several files."""

import duckdb
import pyarrow.parquet as pq

from landmosaic.plans import job_queries as _jobs  # noqa: F401  (registers its queries)
from landmosaic.plans.queries import ORACLE, QUERIES


def test_f2_of_labels_in_several_files_the_last_by_name_counts(spark, tmp_path):
    source = "/root/testdata/sf0.001"
    for name in ("orders", "customer"):
        pq.write_table(pq.read_table(f"{source}/{name}.parquet"), tmp_path / f"{name}.parquet")
    (tmp_path / "labels.parquet").mkdir()
    duck = duckdb.connect()
    duck.sql("SET threads = 1")  # with more the SQL doesn't repeat itself
    for part, n in enumerate((300, 3000, 600, 1500)):  # Spark reads the largest first
        rows = f"SELECT (i * 31 + {part} * 17) % 700 AS doc_id, CAST((i + {part}) % 2 AS INT) AS quality, CAST((i // 3 + {part}) % 2 AS INT) AS toxic FROM range({n}) r(i)"
        duck.sql(f"COPY ({rows}) TO '{tmp_path}/labels.parquet/{part}.parquet' (FORMAT parquet)")
    for name in ("orders", "customer", "labels"):
        duck.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet{'/*.parquet' if name == 'labels' else ''}'")
    want = duck.sql(ORACLE["g5_strong_build"])
    got = QUERIES["g5_strong_build"](spark, str(tmp_path)).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall()) and len(got) > 2
