import os
import sys
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))
DATA = Path(os.environ.get("CREASE_TESTDATA", "/root/testdata/sf0.001"))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "4g", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))}
    s = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def changed(table: pa.Table, how: str) -> pa.Table:
    if how == "empty":
        return table.slice(0, 0)
    if how == "extra":
        for name in ("value", "key", "path", "clean", "cost", "id", "w", "n", "name", "amount", "residue", "shard", "season_", "before"):
            if name not in table.column_names:
                table = table.append_column(name, pa.array(["x"] * len(table)))
        return table
    rows = table.slice(0, 4).to_pylist()
    out = list(rows)  # repeated rows
    out += [r | {c: None} for r in rows[:1] for c in table.column_names]
    out.append(dict.fromkeys(table.column_names))
    texts = [f.name for f in table.schema if pa.types.is_string(f.type) and not f.name.endswith("_id")]
    out += [r | {c: t for c in texts} for r in rows[:1] for t in ("", " ", "(" * 30_000 + "word " * 30_000)]
    return pa.concat_tables([table, pa.Table.from_pylist(out, schema=table.schema)])


@pytest.fixture(scope="session")
def variant(tmp_path_factory):
    """variant(how): a folder of the test tables, changed: empty, extra (clashing columns) or odd (NULLs, repeated rows, blank and long texts)."""
    made = {}

    def make(how: str) -> str:
        if how not in made:
            folder = tmp_path_factory.mktemp(how)
            for p in sorted(DATA.glob("*.parquet")):
                pq.write_table(changed(pq.read_table(p), how), folder / p.name)
            made[how] = str(folder)
        return made[how]

    return make
