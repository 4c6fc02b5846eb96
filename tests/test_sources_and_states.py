"""The data source of files, the progress states, and vectors in cells."""

import random
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lodeline.operators import retrieval
from lodeline.operators.library import Library
from lodeline.operators.staging import stored
from lodeline.sources import files, paged_files
from lodeline.streaming import progress

from .test_library import docx, make


def folder(tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    put = lambda name, content: (tmp_path / "in" / name).write_bytes(content)
    put("a.docx", docx(("Heading1", "Top"), ("", "Body &amp; more")))
    put("deep/b.HTML", b"<h2>T</h2><p>b</p>")
    put("broken.docx", b"zz")
    put("p.pdf", b"%PDF-none")
    put("x.exe", b"0")
    put("latin.txt", "n°".encode("latin-1"))
    put("_hidden.txt", b"no")
    return str(tmp_path / "in")


def test_files_as_a_data_source(spark, tmp_path):
    path = folder(tmp_path)
    got = {r.path.rsplit("/", 1)[-1]: r for r in paged_files.load(spark, path).collect()}
    assert set(got) == {"a.docx", "b.HTML", "broken.docx", "p.pdf", "x.exe", "latin.txt"}
    assert got["broken.docx"].error and got["p.pdf"].error and got["x.exe"].kind == "unsupported" and got["a.docx"].error is None
    by_uri = paged_files.texts(paged_files.load(spark, f"file://{path}")).collect()
    here = {r.path.rsplit("/", 1)[-1]: r for r in by_uri}
    there = {r.path.rsplit("/", 1)[-1]: r for r in files.extracted(files.read_files(spark, path).filter("path NOT LIKE '%hidden%'")).collect()}
    assert {k: (r.text, r.byte_size) for k, r in here.items()} == {k: (r.text, r.byte_size) for k, r in there.items()} and here["a.docx"].text.startswith("# Top")
    assert {k for k, r in here.items() if r.error} == {k for k, r in there.items() if r.error} == {"broken.docx", "p.pdf", "x.exe"}
    (tmp_path / "none").mkdir()
    assert paged_files.load(spark, str(tmp_path / "none")).count() == 0


def test_groups_follow_bytes(tmp_path, monkeypatch):
    path = folder(tmp_path)
    monkeypatch.setattr(paged_files, "GROUP_BYTES", 20)
    groups = paged_files.grouped(paged_files.listed(path)[1])
    assert len(groups) > 2 and sorted(f for g in groups for f, _ in g.files) == sorted(f.path for f in paged_files.listed(path)[1])


def test_files_as_a_stream(spark, tmp_path):
    path = folder(tmp_path)
    seen = []
    time.sleep(paged_files.SETTLED + 0.2)

    def run():
        rows = paged_files.load(spark, path, stream=True)
        keep = lambda batch, _: seen.extend(r.path.rsplit("/", 1)[-1] for r in paged_files.texts(batch).collect())
        rows.writeStream.foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()

    run()
    assert sorted(seen) == ["a.docx", "b.HTML", "broken.docx", "latin.txt", "p.pdf", "x.exe"]
    (tmp_path / "in" / "later.txt").write_text("more")
    time.sleep(paged_files.SETTLED + 0.2)
    run()
    assert seen[6:] == ["later.txt"]


EVENTS = [(1, "queued", 0, 10), (1, "embedding", 40, 30), (1, "embedding", 90, 40), (1, "ready", 100, 50), (2, "queued", 0, 11), (2, "chunking", 15, 21), (3, "failed", None, 12)]
LAST = {1: ("ready", 100), 2: ("chunking", 15), 3: ("failed", None)}


def test_states_of_disordered_and_repeated_events(spark, tmp_path):
    random.seed(1)
    schema = "document_id bigint, stage string, percent int, at bigint"
    parts = [EVENTS[:3] + EVENTS[4:5], [EVENTS[3], *EVENTS[:2], EVENTS[6]], [*EVENTS[4:6], EVENTS[2], EVENTS[5]], random.sample(EVENTS, 7)]
    state, told = {}, []
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")

        def keep(batch, _, state=state):
            for r in batch.collect():
                told.append((r.document_id, r["at"]))
                state[r.document_id] = (r.stage, r.percent)

        stream = progress.stages(spark.readStream.schema(schema).parquet(f"{tmp_path}/events"))
        stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    assert state == LAST and all(a <= b for d in LAST for a, b in zip([x for k, x in told if k == d], [x for k, x in told if k == d][1:]))
    assert len(told) == len(set(told))  # what is told again changes nothing
    table = progress.stages(spark.createDataFrame(random.sample(EVENTS * 2, 14), schema))
    assert {r.document_id: (r.stage, r.percent) for r in table.collect()} == LAST


def test_silent_documents_are_stuck(spark, tmp_path):
    lib = Library(spark, f"{tmp_path}/lib")
    lib._tell(spark.createDataFrame([(7,)], "id bigint"), "embedding", 40)
    lib._tell(spark.createDataFrame([(8,)], "id bigint"), "ready", 100)
    told = []
    keep = lambda batch, _: told.extend((r.document_id, r.percent, r.stuck) for r in batch.collect())
    query = progress.follow(lib, f"{tmp_path}/ck", keep, "1 second", patience=0.5)
    until = time.time() + 60
    while (7, 40, True) not in told and time.time() < until:
        time.sleep(0.5)
    query.stop()
    ended = []
    progress.follow(lib, f"{tmp_path}/ck2", lambda batch, _: ended.extend(r.document_id for r in batch.collect())).awaitTermination()
    assert sorted(ended) == [7, 8]
    assert {(7, 40, False), (8, 100, False), (7, 40, True)} == set(told)


def test_cells_give_the_exact_nearest_and_leave_blocks_out(spark):
    rng = np.random.default_rng(2)
    middles = rng.normal(size=(12, 16))
    vectors = (middles[rng.integers(0, 12, 3000)] + 0.05 * rng.normal(size=(3000, 16))).astype(np.float32)
    vectors[10] = vectors[20] = vectors[30]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "chunk_id bigint, embedding array<float>").repartition(3)
    asked = df.filter("chunk_id % 100 = 30").withColumnRenamed("chunk_id", "question_id")
    around = retrieval.pivots(df)
    assert around.shape == (54, 16)
    cells = stored(retrieval.celled(df, around), "cells")
    key = lambda d: sorted(tuple(r) for r in d.collect())
    whole = key(retrieval.nearest(df, asked, 9))
    assert key(retrieval.nearest_in_cells(cells, around, asked, 9)) == whole == key(retrieval.nearest_in_cells(cells, around, asked, 9, few=7))
    scan = retrieval.CellScan(list(range(30)), vectors[30::100].astype(np.float64), around, 9, step=64)
    for batch in cells.toArrow().combine_chunks().to_batches():
        scan.see(pa.RecordBatch.from_arrays(batch.columns, names=batch.schema.names))
    assert scan.skipped > 0.7 * scan.seen > 0
    none = df.limit(0)
    assert retrieval.nearest_in_cells(cells, around, asked.limit(0)).count() == 0
    assert retrieval.pivots(none).shape[0] == 0 and retrieval.nearest_in_cells(retrieval.celled(none, np.zeros((1, 16))), np.zeros((1, 16)), asked).count() == 0
