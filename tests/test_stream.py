"""The stream's sink: no row twice and none lost when a run dies between write and commit."""

import pytest

from tagweave.streaming.scoring import hashed_linear_scorer
from tagweave.streaming.stream import read_sink, run_stream

SCHEMA = "doc_id long, text string"


@pytest.fixture
def source(spark, tmp_path):
    def add(name, ids):
        spark.createDataFrame([(i, f"some words {i}") for i in ids], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / name))
        return str(tmp_path / "in" / "*")
    return add


def run(spark, src, sink, **opts):
    run_stream(spark, src, SCHEMA, str(sink), hashed_linear_scorer(), max_files_per_trigger=1, **opts)


def ids(spark, sink):
    return sorted(r["doc_id"] for r in read_sink(spark, str(sink)).collect())


def test_death_between_write_and_commit(spark, source, tmp_path):
    source("a", range(0, 10))
    src = source("b", range(10, 25))

    def die(number):
        if number == 1:
            raise RuntimeError("killed")

    with pytest.raises(Exception):
        run(spark, src, tmp_path / "out", after_write=die)
    assert len(ids(spark, tmp_path / "out")) in (10, 15)       # the second batch is written, but does not count
    run(spark, src, tmp_path / "out")
    assert ids(spark, tmp_path / "out") == list(range(25))
    source("c", range(25, 30))
    run(spark, src, tmp_path / "out")
    run(spark, src, tmp_path / "out")                           # nothing new
    assert ids(spark, tmp_path / "out") == list(range(30))


def test_sinks_do_not_share_offsets(spark, source, tmp_path):
    src = source("a", range(7))
    for sink in ("one", "two"):
        run(spark, src, tmp_path / sink)
        assert ids(spark, tmp_path / sink) == list(range(7))
    with pytest.raises(ValueError):
        run(spark, src, tmp_path / "one", checkpoint_path=str(tmp_path / "two" / "checkpoint"))


@pytest.mark.parametrize("folder", [False, True])
def test_documents_as_one_file_or_as_a_folder(spark, tmp_path, folder):
    import pyarrow as pa
    import pyarrow.parquet as pq

    from tagweave.plans.catalog import QUERIES

    table = pa.table({"doc_id": pa.array(range(20), pa.int64()), "text": [f"some words {i}" for i in range(19)] + [None]})
    path = tmp_path / "documents.parquet"
    if folder:
        path.mkdir()
        for k in range(2):
            pq.write_table(table.slice(10 * k, 10), path / f"part-{k}.parquet")
    else:
        pq.write_table(table, path)
    rows = [sorted(map(tuple, QUERIES[q](spark, str(tmp_path)).collect())) for q in ("stream_tag", "score_batch")]
    assert len(rows[0]) == 20 and rows[0] == rows[1]
