import os
import sys

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SCHEMAS = {
    "documents": [("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())],
    "labels": [("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32())],
    "pages": [("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string())],
    "benchmark": [("item_id", pa.int64()), ("text", pa.string())],
}


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    shared = tmp_path_factory.mktemp("shared")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{shared}")
        .config("spark.sql.warehouse.dir", str(shared / "warehouse"))
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    from codeloom.plans.shipping import ship

    ship(session)
    yield session
    session.stop()


@pytest.fixture
def make_tables(tmp_path):
    """Write small tables; each value is a list of rows in the order of SCHEMAS."""

    def make(**tables) -> str:
        for name in SCHEMAS:
            rows, fields = tables.get(name, []), SCHEMAS[name]
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
            arrays = [pa.array(list(c), t) for c, (_, t) in zip(columns, fields, strict=True)]
            pq.write_table(pa.table(arrays, names=[f[0] for f in fields]), str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return make
