import io
import zipfile

from pyspark.sql import functions as F

from sagelode.functions import text, vectors
from sagelode.operators import analytics, graph
from sagelode.sources import readers, sinks


def test_csv_rows_become_sentences(spark, tmp_path):
    (tmp_path / "a.csv").write_text("rate,Unnamed: 1,goods\n5,x,rice\n,y,tea\n")
    got = [r.text for r in readers.read_csv_sentences(spark, str(tmp_path / "a.csv")).collect()]
    assert got == ["rate: 5. goods: rice", "goods: tea"]


def test_texts_html_and_listing(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo")
    (tmp_path / "b.html").write_text("<p>" + "word " * 40 + "</p>")
    (tmp_path / ".hidden.txt").write_text("x")
    assert [r.text for r in readers.read_texts(spark, str(tmp_path / "a.txt")).collect()] == ["one\ntwo"]
    assert readers.read_html(spark, str(tmp_path / "b.html")).first().text == ("word " * 40).strip()
    assert [r.path.rsplit("/")[-1] for r in readers.list_files(spark, str(tmp_path), [".txt"]).collect()] == ["a.txt"]


def test_jsonl_skips_malformed_lines(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"chunk_id": 1, "text": "a"}\nnot json\n{"chunk_id": 2, "text": "b"}\n')
    assert sorted(r.chunk_id for r in readers.read_jsonl(spark, str(tmp_path / "c.jsonl"), readers.CHUNKS).collect()) == [1, 2]


def test_docx(spark, tmp_path):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        p = "<w:p><w:r><w:t>{}</w:t></w:r></w:p>"
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>' + p.format("one") + p.format(" ") + p.format("two") + "</w:body></w:document>")
    (tmp_path / "a.docx").write_bytes(raw.getvalue())
    (tmp_path / "bad.docx").write_bytes(b"no archive")
    assert [r.text for r in readers.read_docx(spark, str(tmp_path)).collect()] == ["one\ntwo"]


def test_sinks(spark, tmp_path):
    df = spark.range(5).withColumnRenamed("id", "k")
    for _ in range(2):
        sinks.append_jsonl(df, str(tmp_path / "j"))
        sinks.append_parquet(df, str(tmp_path / "p"))
    assert spark.read.json(str(tmp_path / "j")).count() == spark.read.parquet(str(tmp_path / "p")).count() == 10
    sinks.rebuild(df, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 5
    assert [r.k for r in sinks.newest(df, 2, [F.desc("k")]).collect()] == [4, 3]


def test_keys_and_similarity(spark):
    keys = spark.createDataFrame([("SEC_17",), ("SEC_17_5",), ("SEC_17A",), ("SEC_170",)], "k string")
    assert [r[0] for r in keys.select(text.key_matches(F.col("k"), F.lit("SEC_17"))).collect()] == [True, True, True, False]
    v = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0])], "a array<double>, b array<double>")
    assert v.select(vectors.cosine("a", "b")).first()[0] == 0.0


def test_levels_leave_cycles_out(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x")], "src string, dst string")
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst"))
    assert {r.node: r.level for r in graph.levels(e, nodes).collect()} == {"a": 0, "b": 1, "c": 2, "x": None, "y": None}


def test_verdicts(spark):
    got = spark.createDataFrame([(4, 5), (1, 2), (1, 9)], "f int, t int").select(analytics.verdict(F.col("f"), F.col("t"))).collect()
    assert [r[0] for r in got] == ["pass", "partial", "fail"]
