import os
import subprocess
import sys

import pytest
from conftest import DATA
from oracle import connect, same

from codeloom.plans.queries import FLAGSHIP, QUERIES, SQL

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, con, name):
    frame = QUERIES[name](spark, DATA)
    if name in SQL:
        same(frame, con, SQL[name])
    else:
        assert len(frame.columns) == len(set(frame.columns))
        assert frame.count() >= 0


def test_flagship_is_registered():
    assert FLAGSHIP in QUERIES and FLAGSHIP in SQL


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)


def test_the_core_imports_nothing_of_the_optional_package():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    names = []
    for folder, folders, files in os.walk(os.path.join(root, "codeloom")):
        folders[:] = [d for d in folders if d not in ("llm", "__pycache__")]
        for f in files:
            if f.endswith(".py"):
                names.append(os.path.relpath(os.path.join(folder, f), root)[:-3].replace(os.sep, ".").removesuffix(".__init__"))
    code = f"import sys, importlib\nfor n in {names!r}: importlib.import_module(n)\nassert not any(n.startswith('codeloom.llm') for n in sys.modules)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=root)


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
