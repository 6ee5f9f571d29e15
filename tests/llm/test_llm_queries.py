import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from conftest import DATA  # noqa: E402
from oracle import connect, same  # noqa: E402

from codeloom.llm.queries import QUERIES, SQL  # noqa: E402

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
COLUMNS = {
    "p1_found": {"file_id": "bigint"},
    "p2_found": {"file_id": "bigint"},
    "p4_found": {"chunk_id_a": "bigint", "chunk_id_b": "bigint"},
    "p5_found": {"chunk_id": "bigint"},
    "p6_found": {"chunk_id": "bigint"},
    "p7_found": {"doc_id": "bigint", "item_id": "bigint"},
    "p9_found": {"doc_id": "bigint", "sent_end": "int"},
}


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    frame = QUERIES[name](spark, DATA)
    if name in COLUMNS:
        assert dict(frame.dtypes) == COLUMNS[name]
        assert frame.count() == frame.distinct().count() > 0
    if name in SQL:
        same(frame, con, SQL[name])
    elif name not in COLUMNS:
        assert frame.count() > 0


@pytest.mark.parametrize("kind", ["empty", "nulls"])
def test_queries_survive_empty_tables_and_null_rows(spark, tmp_path, kind):
    import glob

    from pyspark.sql import functions as F

    for path in glob.glob(f"{DATA}/*.parquet"):
        table = spark.read.parquet(path)
        nulls = table.limit(2).select(*[F.lit(None).cast(table.schema[c].dataType).alias(c) for c in table.columns])
        frame = table.limit(0) if kind == "empty" else table.union(nulls)
        frame.coalesce(1).write.parquet(f"{tmp_path}/{os.path.basename(path)}")
    for query in QUERIES.values():
        query(spark, str(tmp_path)).collect()
