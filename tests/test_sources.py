"""Readers, sinks and streams on small files."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from proselake.operators.compare import compare
from proselake.sources import readers, sinks
from proselake.streaming import findings as stream


def test_text_files_and_manifest(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("Ünï\nline")
    (tmp_path / "sub/b.md").write_text("two")
    (tmp_path / "c.csv").write_text("no")
    (tmp_path / "m.json").write_text(json.dumps([{"file": "a.txt", "author": "Ann", "text": "clash"}]))
    t = readers.text_files(spark, str(tmp_path))
    got = {r.path.rsplit("/", 1)[1]: r for r in readers.with_manifest(t, spark.read.json(str(tmp_path / "m.json"), multiLine=True)).collect()}
    assert set(got) == {"a.txt", "b.md"} and got["a.txt"].text == "Ünï\nline" and got["a.txt"].author == "Ann" and got["b.md"].author is None and got["a.txt"].manifest_text == "clash"


def test_decoding(spark):
    b = spark.createDataFrame([("u", "é".encode()), ("bom", b"\xef\xbb\xbfx"), ("c", "“é”".encode("cp1252")), ("l", b"\x81\xe9"), ("n", None)], "path string, content binary")
    got = {r.path: (r.text, r.encoding) for r in readers.decoded(b).collect()}
    assert got == {"u": ("é", "utf-8-sig"), "bom": ("x", "utf-8-sig"), "c": ("“é”", "cp1252"), "l": ("\x81é", "latin-1"), "n": (None, None)}


def test_html(spark):
    h = "<html><head><style>x{}</style><script>bad()</script></head><body><nav>menu</nav><h1>T</h1><p>One &amp; <b>two</b><br>three</p><!-- c --></body></html>"
    assert spark.createDataFrame([(h,)], "h string").select(readers.html_text(F.col("h"))).first()[0] == "T\n\nOne & two\nthree"


def test_epub(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "b.epub", "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="O/p.opf"/></rootfiles></container>')
        z.writestr("O/p.opf", '<package xmlns="http://www.idpf.org/2007/opf"><manifest><item id="b" href="b.xhtml"/><item id="a" href="a.xhtml"/></manifest><spine><itemref idref="a"/><itemref idref="b"/></spine></package>')
        z.writestr("O/a.xhtml", "<html><body><p>First</p></body></html>")
        z.writestr("O/b.xhtml", "<html><body><p>Second</p></body></html>")
    (tmp_path / "bad.epub").write_bytes(b"nothing")
    got = {r.path.rsplit("/", 1)[1]: (r.text, r.refused) for r in readers.epub_files(spark, str(tmp_path)).collect()}
    assert got == {"b.epub": ("First\n\nSecond", None), "bad.epub": (None, "not an EPUB: BadZipFile")}


CONLLU = "# newdoc id = d1\n# text = A dog ran.\n1\tA\ta\tDET\t_\t_\t2\tdet\t_\t_\n2\tdog\tdog\tNOUN\t_\t_\t3\tnsubj\t_\t_\n3\tran\trun\tVERB\t_\t_\t0\troot\t_\t_\n\n# text = It sat.\n1-2\tIt\t_\t_\n1\tIt\tit\tPRON\t_\t_\t2\tnsubj\t_\t_\n\n# newdoc id = d2\n# text = End.\n1\tEnd\tend\tNOUN\t_\t_\t0\troot\t_\t_\n"


def test_conllu(spark, tmp_path):
    (tmp_path / "x.conllu").write_text(CONLLU)
    t = readers.conllu(spark, str(tmp_path)).orderBy("sent_idx", "tok_i").collect()
    assert [(r.sent_idx, r.tok_i, r.text, r.head_i) for r in t] == [(0, 1, "A", 2), (0, 2, "dog", 3), (0, 3, "ran", 0), (1, 1, "It", 2), (2, 1, "End", 0)]
    assert sorted(r.text for r in readers.conllu_documents(spark, str(tmp_path)).collect()) == ["A dog ran. It sat.", "End."]


def test_manuscript(spark):
    c = spark.createDataFrame([("m/chapter1.md", "a"), ("m/chapter2.md", "b"), ("m/chapter4.md", "d"), ("m/ch-4.md", "e"), ("m/notes.md", "n")], "path string, text string")
    assert [(r.number, r.gap, r.repeated) for r in readers.manuscript(c).orderBy("number", "text").collect()] == [(1, None, None), (2, False, False), (4, True, False), (4, False, True)]


def test_profile_and_reports(spark, tmp_path):
    d = spark.createDataFrame([(p, "m", f"o{i}", float(i)) for p in "ab" for i in range(12)], "profile string, metric_id string, obs_id string, value double")
    sinks.write_profile(d, str(tmp_path / "p"))
    back = sinks.read_profile(spark, str(tmp_path / "p"), "a")
    assert back.count() == 12 and sinks.without_observation(back, "o3").count() == 11
    f = spark.createDataFrame([(1, "m", "full", "a", 5.0), (1, "m", "full", "b", 90.0)], "doc_id bigint, metric_id string, channel string, corpus string, value double")
    sinks.write_reports(compare(f, d), str(tmp_path / "r"))
    (r,) = spark.read.json(str(tmp_path / "r")).collect()
    assert r.doc_id == 1 and r["count"] == 2 and r.critical == 1


def test_stream(spark, sf, tmp_path):
    src = str(tmp_path / "in")
    spark.read.parquet(f"{sf}/findings.parquet").repartition(3).write.parquet(src)
    s = stream.read(spark, src, 1)
    q = stream.windowed(s).writeStream.outputMode("complete").format("memory").queryName("w").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    want = {(r.start, r.metric_id): r.n for r in stream.windowed(spark.read.parquet(src), late=None).collect()}
    assert {(r.start, r.metric_id): r.n for r in spark.table("w").collect()} == {k: v for k, v in want.items() if k[0] is not None}
    q = stream.once(stream.read(spark, src, 1)).writeStream.outputMode("append").format("memory").queryName("o").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    keys = ["doc_id", "metric_id", "channel", "corpus", "measured_at"]
    assert spark.table("o").count() == spark.table("o").select(*keys).distinct().count()
    q = stream.drift_events(stream.read(spark, src, 1)).writeStream.outputMode("update").format("memory").queryName("d").option("checkpointLocation", str(tmp_path / "c3")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("d").count() >= spark.table("d").select("metric_id").distinct().count() > 0


def test_entry_point(spark):
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and len(q) > 60
    assert e.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["core_metrics", "compare_findings", "sequence_trend", "conversation_structure", "catalogue_distinct"])
def test_queries_on_empty_tables(spark, sf, tmp_path, name):
    import __spark_entry__ as e

    for t in ("documents", "findings", "candidates", "turns", "sequences", "corpus_dist"):
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert e.queries()[name](spark, str(tmp_path)).count() == 0
