import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    tmp = tmp_path_factory.mktemp("spark")
    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "4g", "spark.checkpoint.dir": str(tmp / "shared"), "spark.sql.warehouse.dir": str(tmp / "warehouse"), "spark.local.dir": str(tmp / "local")}
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small() -> str:
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck(small):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    return con


def rows_of(pdf) -> list[str]:
    """Rows as sorted text, columns by name."""
    pdf = pdf[sorted(pdf.columns)]
    plain = lambda v: v.item() if hasattr(v, "item") and not hasattr(v, "__len__") else v
    return sorted(str(tuple(plain(v) for v in r)) for r in pdf.itertuples(index=False))


def plain_rows(names: list[str], rows) -> list[str]:
    """Collected rows as sorted text, columns by name: nulls and whole numbers stay what they are."""
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda v: bytes(v) if isinstance(v, bytearray) else v
    return sorted(repr(tuple(plain(r[i]) for i in order)) for r in rows)
