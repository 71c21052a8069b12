"""Every core query runs over empty tables, and over tables with null rows, repeated rows and columns that clash."""

import glob
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tessera.plans import registry

QUERIES = registry.queries()


@pytest.fixture(scope="module")
def edges(sf, tmp_path_factory):
    empty, dirty = tmp_path_factory.mktemp("empty"), tmp_path_factory.mktemp("dirty")
    for f in glob.glob(f"{sf}/*.parquet"):
        t = pq.ParquetDataset(f).read()
        pq.write_table(t.slice(0, 0), empty / os.path.basename(f))
        null = pa.table({c.name: pa.nulls(1, c.type) for c in t.schema}, schema=t.schema)
        rows = pa.concat_tables([t.slice(0, 150), null, t.slice(0, 3), null])
        for name in ("kind", "n", "line", "token", "label", "_n", "status"):
            if name not in rows.column_names:
                rows = rows.append_column(name, pa.array(["x"] * len(rows)))
        pq.write_table(rows, dirty / os.path.basename(f))
    return str(empty), str(dirty)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, edges, name):
    assert QUERIES[name](spark, edges[0]).count() <= 2  # totals, and the frame of a drawing


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_null_and_repeated_rows(spark, edges, name):
    QUERIES[name](spark, edges[1]).write.format("noop").mode("overwrite").save()
