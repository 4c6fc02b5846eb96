import hashlib
import io
import json
import re
import uuid
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lodeline.operators import citations, library, retrieval
from lodeline.operators.embedding import ModelEmbedder, in_order
from lodeline.operators.library import Library
from lodeline.operators.staging import passing, shared_dir, stored
from lodeline.sources import files
from lodeline.streaming import ingest

HIVES = """# The colony

A queen lays up to two thousand eggs in a day of early summer. Workers feed the larvae, build comb and guard the entrance of the hive.

Drones leave the hive at noon and gather high above the fields. They are driven out when the first cold nights come.

# The harvest

Honey is ripe when the bees have sealed its cells with wax. Frames are then uncapped with a warm knife and spun."""


def rows(spark, texts):
    data = [(i, i, 0, t, "", None, 0, len(t)) for i, t in enumerate(texts, 1)]
    return spark.createDataFrame(data, "id bigint, document_id bigint, ordinal int, text string, heading string, page int, char_start bigint, char_end bigint")


CORPUS = ["The label HX204 marks hives that were treated for mites.", "Swarms are caught at dusk, with a box and a sheet.", "Pollen counts are read from traps at the entrance.", "A double-walled hive keeps its warmth in winter.", "Foxes dig at the edge of the orchard."]


def test_search(spark):
    passages = rows(spark, CORPUS)
    docs = passages.select("id", F.concat(F.lit("d"), "id").alias("title"), F.lit("f").alias("filename"), F.when(F.col("id") < 3, "care").otherwise("site").alias("collection"))
    ask = lambda q, **how: retrieval.search(passages, docs, spark.createDataFrame([(1, q)], "question_id bigint, question string"), **how).orderBy("place").collect()
    assert ask("what does hx204 mark", mode="keyword")[0].chunk_id == 1
    assert ask("warmth double-walled")[0].chunk_id == 4
    ids = spark.createDataFrame([(2,), (3,)], "document_id bigint")
    assert {r.document_id for r in ask("mites swarms pollen", document_ids=ids)} <= {2, 3}
    assert {r.collection for r in ask("mites swarms pollen", collection="site")} == {"site"}
    assert ask("?!", mode="keyword") == []
    similar = [r.similarity for r in sorted(ask("foxes dig", mode="vector"), key=lambda r: r.vector_rank)]
    assert similar == sorted(similar, reverse=True)


def test_nearest_alike_by_broadcast_and_by_blocks(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), "embedding")
    asked = vectors.filter("chunk_id % 50 = 0").select(F.col("chunk_id").alias("question_id"), "embedding")
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(retrieval.nearest(vectors, asked, 7)) == key(retrieval.nearest(vectors, asked, 7, block=100, few=0))
    assert retrieval.nearest(vectors, asked.limit(0)).count() == 0 and retrieval.nearest(vectors.limit(0), asked).count() == 0


def test_neighbours(spark):
    passages = rows(spark, CORPUS).withColumn("document_id", F.lit(1)).withColumn("ordinal", (F.col("id") - 1).cast("int"))
    got = retrieval.neighbours(passages, spark.createDataFrame([(1,), (3,)], "chunk_id bigint"), 1).collect()
    assert sorted((r.chunk_id, r.neighbour_id) for r in got) == [(1, 1), (1, 2), (3, 2), (3, 3), (3, 4)]


def test_fusion_prefers_agreement(spark):
    k = spark.createDataFrame([(1, 10, -5.0, 1), (1, 11, -4.0, 2), (1, 12, -1.0, 3)], "question_id bigint, chunk_id bigint, score double, rank int")
    v = spark.createDataFrame([(1, 12, 0.9, 1), (1, 10, 0.8, 2), (1, 13, 0.7, 3)], "question_id bigint, chunk_id bigint, similarity double, rank int")
    got = [r.chunk_id for r in retrieval.fuse(k, v).orderBy("rank").collect()]
    assert got == [10, 12, 11, 13]


USED = [("S1", 11, 1, "Bees", "Harvest", 4, 0, "Honey is ripe when the bees have sealed its cells with wax: white, thin, dry."), ("S2", 12, 1, "Bees", "Harvest", 5, 1, "A refractometer shows whether there is too much water in it.")]


def verify(spark, answer, cites, confidence):
    reply = spark.createDataFrame([(1, answer, cites, confidence, "")], f"question_id bigint, {citations.ANSWER}")
    used = spark.createDataFrame([(1, *u) for u in USED], "question_id bigint, label string, chunk_id bigint, document_id bigint, document_title string, heading string, page int, ordinal int, text string")
    return citations.verified(reply, used).first()


def test_citations(spark):
    good = verify(spark, "The cells are closed [S1].", [("s1 ", "the bees have sealed its cells")], "high")
    assert good.confidence == "high" and good.kept == 1 and good.citations_kept[0].page == 4 and "[S1]" in good.answer
    assert "<mark>" in good.citations_kept[0].excerpt
    bad = verify(spark, "It is heated [S1].", [("S1", "heated to sixty degrees before bottling")], "high")
    assert bad.answer == "It is heated [unverified]." and bad.citations_dropped[0].reason == citations.NOT_FOUND and bad.confidence == "partial"
    assert verify(spark, "x [S9]", [("S9", "any text at all")], "high").citations_dropped[0].reason == citations.NOT_RETRIEVED
    assert verify(spark, "x [S1]", [("S1", " ")], "high").citations_dropped[0].reason == citations.NO_QUOTE
    none = verify(spark, "Not covered.", [], "none")
    assert none.confidence == "none" and none.checked == 0
    third = [("S1", "the bees have sealed its cells"), ("S2", "A refractometer shows whether"), ("S2", "nothing like this is there")]
    assert verify(spark, "a [S1] b [S2]", third, "high").confidence == "high"  # a third exactly is not enough
    assert verify(spark, "a", third + [("S7", "zzz zzz zzz")], "high").confidence == "partial"


def test_budget(spark):
    hits = spark.range(50).select(F.lit(1).alias("question_id"), (F.col("id") + 1).cast("int").alias("place"), F.repeat(F.lit("word "), 300).alias("text"), F.lit("Doc").alias("document_title"), F.lit("H").alias("heading"), F.lit(1).alias("page"))
    packed = citations.packed_sources(hits, 2000).orderBy("place").collect()
    assert 0 < len(packed) < 50 and packed[-1].tokens <= 2000 and packed[0].block.startswith('<source id="S1" from="Doc › H › page 1">')
    assert citations.packed_sources(hits, 1).count() == 1


def test_replies(spark):
    raw = ['```json\n{"answer": "a", "citations": [{"marker": "S1", "quote": "q"}], "confidence": "high"}\n```', "no json", None, '{"answer": "cut off', '{"answer": "x", }', '{"answer": oops}']
    got = [r.r for r in spark.createDataFrame([(x,) for x in raw], "x string").select(citations.parsed_reply(F.col("x")).alias("r")).collect()]
    assert got[0].answer == "a" and got[0].citations[0].marker == "S1" and got[1:] == [None] * 5
    assert [citations.reply_is_json(x or "") for x in raw] == [r is not None for r in got]
    text = citations.request("Why?", "src", "ro", again=True)
    assert "Why?" in text and "src" in text and "Romanian" in text
    with pytest.raises(ValueError):
        citations.request("Why?", "src", "xx")


def docx(*paragraphs):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{s}{chr(34)}/></w:pPr>" if s else ""}<w:r><w:t>{t}</w:t></w:r></w:p>' for s, t in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<?xml version="1.0"?><w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def table_docx():
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    p = lambda t, inner="": f"<w:p>{inner}<w:r><w:t>{t}</w:t></w:r></w:p>"
    item = "<w:pPr><w:numPr><w:ilvl w:val='0'/></w:numPr></w:pPr>"
    body = p("Tools", "<w:pPr><w:pStyle w:val='Heading2'/></w:pPr>") + p("veil", item) + p("smoker", item) + f"<w:tbl><w:tr><w:tc>{p('hive')}</w:tc><w:tc>{p('kg')}</w:tc></w:tr><w:tr><w:tc>{p('A')}</w:tc><w:tc>{p('17')}</w:tc></w:tr></w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<?xml version="1.0"?><w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_sources(spark):
    data = [("a/x.txt", b"plain  text"), ("p.HTML", b"<h2>T</h2><p>b</p>"), ("w.docx", docx(("Heading1", "Top"), ("", "Body &amp; more"))), ("t.docx", table_docx()), ("old.doc", b""), ("y.exe", b""), ("noext", b""), ("broken.docx", b"zz")]
    got = {r.path: r for r in files.extracted(spark.createDataFrame(data, "path string, content binary")).collect()}
    assert got["a/x.txt"].text == "plain text" and got["p.HTML"].text.split() == ["##", "T", "b"] and got["w.docx"].text.split("\n\n")[0] == "# Top" and "Body & more" in got["w.docx"].text
    assert "- veil\n- smoker" in got["t.docx"].text and "hive | kg |" in got["t.docx"].text and "A | 17 |" in got["t.docx"].text
    assert got["old.doc"].error == files.OLD_WORD and '".exe"' in got["y.exe"].error and "unknown" in got["noext"].error and got["broken.docx"].error and len(got) == 8
    with pytest.raises(ValueError):
        files.checked_upload(spark.createDataFrame(data, "path string, content binary"), 3)


def test_bad_bytes_and_references_fail_alone(spark):
    data = [("latin.txt", "Ruche n\u00b0 4, \u00e9t\u00e9".encode("latin-1")), ("big.html", b"<p>a&#99999999;b&#xFFFFFFFF;c&#xD800;d&#0;e&#123456789012345678901234567890;f&#233;&#xe9;&#00065;</p>"), ("good.txt", "mi\u00e8re et \u00e9t\u00e9".encode())]
    got = {r.path: r for r in files.extracted(spark.createDataFrame(data, "path string, content binary")).collect()}
    assert got["latin.txt"].text == "Ruche n\ufffd 4, \ufffdt\ufffd" and got["good.txt"].text == "mi\u00e8re et \u00e9t\u00e9"
    assert got["big.html"].text == "a\ufffdb\ufffdc\ufffdd\ufffde\ufffdf\u00e9\u00e9A" and all(r.error is None for r in got.values())


def test_pages(spark):
    marked = "Inner Frames\nthe wire goes through\nand is drawn tight.\n-- 1 of 40 --\n\n-- 2 of 40 --\nThe third page is short.\n-- 3 of 40 --\n" + "".join(f"\n-- {i} of 40 --\n" for i in range(4, 41))
    blank = "\n-- 1 of 2 --\n\n-- 2 of 2 --\n"
    r = files.paged(spark.createDataFrame([("k", marked), ("n", "no marks at all in this text, only words."), ("o", blank)], "k string, marked string"), "k").orderBy("k").collect()
    assert [p.page for p in r[0].pages] == [1, 3] and r[0].page_count == 40
    assert r[0].pages[1].start == r[0].pages[0].end and r[0].pages[1].end == len(r[0].text)
    assert r[0].text.startswith("## Inner Frames\n\nthe wire goes through and is drawn tight.")
    assert r[1].pages is None and r[1].page_count is None and r[1].text.startswith("no marks")
    assert r[2].text == "" and r[2].page_count == 2


def make(spark, *rows_):
    return spark.createDataFrame(list(rows_), "path string, content binary")


def question(spark, text, i=7):
    return spark.createDataFrame([(i, text)], "question_id bigint, question string")


def test_library_life(spark, tmp_path):
    lib = Library(spark, f"{tmp_path}/lib")
    first = make(spark, ("bees.md", HIVES.encode()), ("copy.md", HIVES.encode()), ("tiny.txt", b"too short"), ("bad.xyz", b"0123456789" * 10))
    lib.add(first, "course")
    status = {r.filename: r.status for r in lib.documents.collect()}
    assert len(status) == 3 and status["tiny.txt"] == status["bad.xyz"] == "failed" and "ready" in status.values()
    n = lib.passages.count()
    assert n == lib.passages.filter("embedding IS NOT NULL").count() > 0
    assert {(r.stage, r.percent) for r in lib.progress.collect()} == {("ready", 100), ("failed", None)}
    assert all(r.duplicate for r in lib.add(make(spark, ("again.md", HIVES.encode()))).collect()) and lib.passages.count() == n
    lib.add(make(spark, ("later.txt", b"Another document, about gardens and the seasons in which to plant.")))
    assert lib.stats().first().documents == 4 and lib.passages.count() == n + 1
    hit = lib.search(question(spark, "uncapped honey frames")).orderBy("place").first()
    assert hit.heading == "The harvest" and "<mark>" in hit.excerpt
    assert lib.around(lib.passages.select(F.col("id").alias("chunk_id"))).count() > n
    doc = lib.documents.filter("filename = 'later.txt'").first().id
    lib.delete([doc])
    assert lib.documents.count() == 3 and lib.passages.filter(F.col("document_id") == doc).count() == 0
    lib.clear_index()
    assert lib.passages.count() == 0 and lib.documents.filter("status = 'pending'").count() == 3 and lib.config() is None
    assert lib.recover().count() == 3 and lib.passages.count() == n
    lib.reindex()
    assert lib.passages.count() == n and lib.doctor()["width"] == 256
    later = Library(spark, lib.path)
    assert later.documents.count() == 3
    later._write("config", spark.createDataFrame([("x", "y", 1, 99, 64, 1)], library.TABLES["config"]))
    with pytest.raises(ValueError):
        Library(spark, lib.path)


ONE = b"The first writer's document, with words enough to be kept."


def test_two_writers_at_once(spark, tmp_path, monkeypatch):
    one, two = Library(spark, f"{tmp_path}/lib"), Library(spark, f"{tmp_path}/lib")
    embedded, turn = Library._embedded, []

    def late(self, cut, documents):
        if not turn:  # the second writer does all its work inside the first one's
            turn.append(1)
            two.add(make(spark, ("two.txt", b"The second writer's document, with words enough to be kept."), ("one.txt", ONE)))
        return embedded(self, cut, documents)

    monkeypatch.setattr(Library, "_embedded", late)
    one.add(make(spark, ("one.txt", ONE)))
    assert {r.filename: r.status for r in one.documents.collect()} == {"one.txt": "ready", "two.txt": "ready"} and one.passages.count() == 2


@pytest.mark.parametrize("work", ["reindex", "recover"])
def test_a_deletion_holds_whatever_runs_beside_it(spark, tmp_path, monkeypatch, work):
    lib = Library(spark, f"{tmp_path}/lib")
    lib.add(make(spark, ("one.txt", ONE), ("bees.md", HIVES.encode())))
    gone = lib.documents.filter("filename = 'one.txt'").first().id
    if work == "recover":
        lib.clear_index()
    embedded = Library._embedded

    def late(self, cut, documents):
        Library(spark, lib.path).delete([gone])
        return embedded(self, cut, documents)

    monkeypatch.setattr(Library, "_embedded", late)
    getattr(lib, work)()
    assert [(r.filename, r.status) for r in lib.documents.collect()] == [("bees.md", "ready")]
    assert lib.passages.filter(F.col("document_id") == gone).count() == 0 < lib.passages.count()
    assert lib.search(question(spark, "writer document kept"), mode="keyword").count() == 0
    assert lib._all("texts").count() == 1


def test_equal_paths_and_equal_contents(spark, tmp_path):
    lib = Library(spark, f"{tmp_path}/lib")
    told = lib.add(make(spark, ("in/a.txt", ONE), ("in/a.txt", b"Other words under the same path, and enough of them to be kept."), ("b/copy.txt", ONE))).collect()
    docs = {r.id: r for r in lib.documents.collect()}
    assert len(docs) == 2 and len(told) == 3 and len({r.document_id for r in told}) == 2 and not any(r.duplicate for r in told)
    by_text = {r.extracted_text: r for r in docs.values()}
    assert by_text[ONE.decode()].content_hash == hashlib.sha256(ONE).hexdigest() and by_text[ONE.decode()].filename == "copy.txt"
    assert sorted((r.document_id, r.text) for r in lib.passages.collect()) == sorted((i, r.extracted_text) for i, r in docs.items())


def test_an_added_file_is_read_twice_and_leaves_few_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_bytes(ONE)
    assert Library(spark, f"{tmp_path}/lib", buckets=7).buckets == 7
    lib = Library(spark, f"{tmp_path}/lib")
    assert lib.buckets == 7 and lib.config() is None
    here = lambda: {p for p in (tmp_path / "lib").rglob("part-*.parquet")}
    before, plans = here(), []
    stored_ = library.stored
    library.stored = lambda df, label, **how: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), stored_(df, label, **how))[1]
    try:
        lib.add(files.read_files(spark, f"{tmp_path}/in"))
    finally:
        library.stored = stored_
    assert sum(p.count("binaryFile") for p in plans) == 2
    assert len(here() - before) <= 12 and lib.passages.count() == 1


def test_older_tables_are_taken_over(spark, tmp_path):
    """Layout 3: rows with batches, seen when committed."""
    doc = "id bigint, title string, source_type string, filename string, mime string, byte_size bigint, content_hash string, char_count bigint, page_count int, collection string, status string, error string, added_at timestamp, indexed_at timestamp, extracted_text string, pages array<struct<page:int,start:bigint,end:bigint>>, gone boolean, batch string"
    row = lambda i, status, gone, batch: (i, f"t{i}", "file", f"{i}.txt", None, 9, f"h{i}", 9, None, "c", status, None, None, None, f"text of {i}", None, gone, batch)
    put = lambda name, rows_, schema: spark.createDataFrame(rows_, schema).write.parquet(f"{tmp_path}/lib/{name}")
    put("documents", [row(1, "pending", False, "a"), row(1, "ready", False, "b"), row(2, "ready", False, "a"), row(2, "ready", True, "c"), row(3, "ready", False, "lost")], doc)
    put("passages", [(10, 1, 0, "honey of the hive", "", None, 0, 9, 4, [1.0] + [0.0] * 255, "b"), (20, 2, 0, "deleted honey", "", None, 0, 9, 4, [1.0] + [0.0] * 255, "a")], f"{library.PASSAGE}, batch string")
    put("terms", [(10, 1, ["honey"], [], "b")], "chunk_id bigint, document_id bigint, text_terms array<string>, heading_terms array<string>, batch string")
    put("commits", [("a", 1, "receive", None, None, None, 3), ("b", 2, "index", "hash", "hash-256", 256, 3), ("c", 3, "delete", None, None, None, 3)], "batch string, at bigint, change string, provider string, model string, dims int, version int")
    post = Library._post

    def broken(self, passages, buckets=None):
        raise RuntimeError("lost")

    Library._post = broken
    try:
        with pytest.raises(RuntimeError):
            Library(spark, f"{tmp_path}/lib")
    finally:
        Library._post = post
    lib = Library(spark, f"{tmp_path}/lib")
    assert [(r.id, r.status, r.extracted_text) for r in lib.documents.collect()] == [(1, "ready", "text of 1")] and lib.config()["model"] == "hash-256"
    assert [r.chunk_id for r in lib.search(question(spark, "honey"), mode="keyword").collect()] == [10]
    assert Library(spark, lib.path).documents.count() == 1 == lib.passages.count() and not (tmp_path / "lib" / "commits").exists()


def test_progress_goes_on_while_vectors_are_made(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(library, "EMBED_LEAST", 4)
    lib = Library(spark, f"{tmp_path}/lib")
    lib.add(make(spark, ("long.txt", ("The scales under the hive showed a gain that day. " * 400).encode())))
    told = [r.percent for r in lib._all("progress").orderBy("at", "percent").collect()]
    assert told[:4] == [0, 5, 15, 25] and told[-1] == 100 and told == sorted(told) and len({p for p in told if 25 < p <= 90}) > 3 and 90 in told


def test_nothing_is_seen_of_a_broken_change(spark, tmp_path):
    def broken(texts):
        raise RuntimeError("no model")

    lib = Library(spark, f"{tmp_path}/lib", ModelEmbedder("test", "m", 3, broken, tries=1))
    with pytest.raises(Exception):
        lib.add(make(spark, ("a.txt", b"A document whose vectors cannot be made by this model.")))
    assert lib.passages.count() == 0 and [r.status for r in lib.documents.collect()] == ["pending"]
    mended = Library(spark, lib.path, ModelEmbedder("test", "m", 3, lambda texts: [[len(t), 1.0, 0.0] for t in texts], batch=2))
    assert mended.recover().count() == 1 and mended.passages.count() == 1 and mended.documents.first().status == "ready"
    with pytest.raises(ValueError):  # another model's vectors
        Library(spark, lib.path).search(question(spark, "q"))
    found = mended.search(question(spark, "vectors model")).collect()
    assert len(found) == 1 and mended.vector_error is None
    away = Library(spark, lib.path, ModelEmbedder("test", "m", 3, broken, tries=1))
    assert len(away.search(question(spark, "vectors model")).collect()) == 1 and "no model" in away.vector_error


def test_vectors_go_by_their_index():
    assert in_order([{"index": 2, "embedding": [3]}, {"index": 0, "embedding": [1]}, {"index": 1, "embedding": [2]}]) == [[1], [2], [3]] == in_order([[1], [2], [3]])
    with pytest.raises(ValueError):
        in_order([{"index": 1, "embedding": [3]}, {"index": 1, "embedding": [1]}])


def test_passing_tables_are_removed(spark, tmp_path):
    here = lambda: set(Path(shared_dir(spark).removeprefix("file:")).glob("probe-*"))
    before = here()
    with passing(spark):
        stored(spark.range(3), "probe")
        with passing(spark):
            assert stored(spark.range(3), "probe").count() == 3 and len(here() - before) == 2
        assert len(here() - before) == 1
    assert here() == before and stored(spark.range(3), "probe").count() == 3 and len(here() - before) == 1


def test_colliding_document_ids_are_refused(spark, tmp_path, monkeypatch):
    lib = Library(spark, f"{tmp_path}/lib")
    lib.add(make(spark, ("a.txt", b"A document that comes first and is kept in the library.")))
    first = lib.documents.first().id
    monkeypatch.setattr(library, "document_id", lambda c: F.lit(first))
    with pytest.raises(ValueError):
        lib.add(make(spark, ("b.txt", b"Another document, whose name is forced to be the same.")))
    assert lib.documents.count() == 1


def test_model_is_asked_once(spark, tmp_path):
    lib = Library(spark, f"{tmp_path}/lib")
    lib.add(make(spark, ("bees.md", HIVES.encode())))
    calls = tmp_path / "calls"
    calls.mkdir()

    def model(instructions, request):
        n = len(list(calls.iterdir()))
        (calls / uuid.uuid4().hex).write_text(request)
        if "broken" in request:
            return '{"answer": "never ends'
        if "silent" in request:
            raise RuntimeError("away")
        if "again" in request and "could not be read" not in request:
            return "not yet"
        label = re.search(r'id="(S\d+)"[^>]*>\s*[^<]*sealed its cells', request)[1]
        return json.dumps({"answer": f"Reply {n}: when sealed [{label}].", "citations": [{"marker": label, "quote": "the bees have sealed its cells with wax"}], "confidence": "high", "missing": ""})

    asked = lambda text: lib.ask(question(spark, text), model, wait=0).first()
    one = asked("when is honey ripe")
    assert one.confidence == "high" and one.kept == 1 and one.answer.startswith("Reply 0") and len(list(calls.iterdir())) == 1
    assert "sealed" in one.citations_kept[0].excerpt and lib.queries.count() == 1
    two = asked("when is honey ripe, again")
    assert two.kept == 1 and len(list(calls.iterdir())) == 3
    assert asked("broken honey").error == library.NO_REPLY and "away" in asked("silent honey").error
    none = asked("zzzz ???")
    assert none.error is None or none.answer is not None


def test_streaming_adds_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.md").write_text(HIVES)
    lib = Library(spark, f"{tmp_path}/lib")
    run = lambda: ingest.watch(lib, str(folder), f"{tmp_path}/ck").awaitTermination()
    run()
    n = lib.passages.count()
    assert n > 0
    (folder / "b.txt").write_text("A second document with enough words to be read as text.")
    run()
    run()
    assert lib.documents.count() == 2 and lib.passages.count() == n + 1
    assert {r.percent for r in ingest.document_progress(lib).collect()} == {100} and ingest.session(spark, lib)["pending"] == 0
