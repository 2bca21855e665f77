import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as t
from tidemark.functions.web import html_to_text, valid_address
from tidemark.operators import fusion, survey, vector, workload
from tidemark.operators.index import build_index
from tidemark.sources import news, vectors
from tidemark.streaming import ingest


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


def test_scalars(spark):
    assert one(spark, " \t a b \n", t.strip) == "a b"
    assert one(spark, None, t.strip) == ""
    assert one(spark, "a\r\nb\rc\n", t.unify_newlines) == "a\nb\nc\n"
    assert one(spark, "  Two \t Words ", t.cache_key).strip() == "two words"
    assert one(spark, "a%20b+c%C3%A9", t.percent_decode) == "a b+cé"
    assert one(spark, "a%2", t.percent_decode) is None
    assert one(spark, "0042", t.parse_size) == 42
    assert one(spark, "-1", t.parse_size) is None
    assert one(spark, "9" * 30, t.parse_size) is None
    assert one(spark, " 1 2.5\t-3e1 ", t.parse_vector) == [1.0, 2.5, -30.0]
    assert one(spark, "1 x", t.parse_vector) is None
    assert one(spark, "  ", t.parse_vector) is None
    assert one(spark, 1536, t.format_bytes, "long") == "1.50 KB"
    assert one(spark, 7, t.format_bytes, "long") == "7 B"


def test_html(spark):
    page = "<html><!-- c --><script>x<y</script><h1>A&amp;B</h1><p>one<br>two &#233;&#x41;</p><li>three</li><nav>menu</nav><b>bold</b></html>"
    text = spark.createDataFrame([(page,), (None,), ("",)], "x string").select(html_to_text(F.col("x"))).collect()
    assert [r[0] for r in text] == ["A&B\none\ntwo éA\nthree\nbold", "", ""]


@pytest.mark.parametrize(
    "url, fine",
    [
        ("https://news.example/a?b#c", True),
        ("http://news.example/", False),
        ("https://user:pw@news.example/", False),
        ("https://localhost/", False),
        ("https://printer.local/", False),
        ("https://127.0.0.1/", False),
        ("https://172.20.1.1:8080/", False),
        ("https://172.40.1.1/", True),
        ("https://100.64.0.1/", False),
        ("https://[::1]/", False),
        ("https://127.1/", False),
        ("https://2130706433/", False),
        ("https://0x7f.1/", False),
        ("https://0177.0.0.1./x", False),
        ("https://0xa000001/", False),
        ("https://999999999999999999999/", False),
        ("https://256.1.1.1/", False),
        ("https://8.8/", True),
        ("https://134744072/", True),
        ("https://1.example/", True),
        ("https://", False),
        (None, False),
    ],
)
def test_addresses(spark, url, fine):
    assert one(spark, url, valid_address) is fine


def test_ndjson(spark, tmp_path):
    lines = [
        json.dumps({"headline": " First ", "short_description": "a", "link": "l", "extra": 1}),
        "",
        "not json",
        json.dumps({"headline": "  ", "short_description": "b"}),
        json.dumps({"short_description": "c"}),
        "[1, 2]",
        json.dumps({"headline": "Café \"x\"", "category": None}),
    ]
    at = tmp_path / "news.json"
    at.write_text("\n".join(lines))
    records = news.read_ndjson(spark, str(at))
    stored = news.stored_documents(records).orderBy("_id").collect()
    assert [(r._id, r.headline, r.short_description, r.category) for r in stored] == [(1, "First", "a", ""), (2, 'Café "x"', "", "")]
    assert [tuple(r) for r in news.index_documents(records).orderBy("doc_id").collect()] == [(1, "First\na"), (2, 'Café "x"\n')]
    counts = news.count_invalid(spark, str(at)).first()
    assert (counts.lines, counts.invalid) == (6, 2)
    assert [r.doc_id for r in news.headline_corpus(records, 2).orderBy("doc_id").collect()] == [0, 1]
    with pytest.raises(news.SourceError):
        news.headline_corpus(records, 3)
    files = news.text_files(news.stored_documents(records))
    stats = news.file_stats(files).first()
    assert stats.files == 2 and stats.largest_file == "000002.txt"
    news.write_files(files, f"file://{tmp_path}/texts")
    assert (tmp_path / "texts" / "000001.txt").read_text() == "First\n\na\n"
    folder = news.read_folder(spark, f"file://{tmp_path}/texts").orderBy("doc_id").collect()
    assert [(r.doc_id, r.text.split("\n")[0]) for r in folder] == [(1, "First"), (2, 'Café "x"')]
    with pytest.raises(news.SourceError):
        news.read_folder(spark, f"file://{tmp_path}/absent")
    news.write_store(news.stored_documents(records), f"{tmp_path}/store", by="category")
    assert spark.read.parquet(f"{tmp_path}/store").count() == 2


def test_quantised_vectors(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [0.70710677, 0.70710677, 0.0]), (4, None), (5, []), (6, [0.0, 0.0, 0.0]), (7, [float("nan"), 1.0, 0.0]), (8, [1.0])]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    made = vector.build_vectors(df, "id", "v", 3)
    assert {r.doc_id: r.qvec for r in made.collect()} == {1: [127, 0, 0], 2: [0, 127, 0], 3: [90, 90, 0]}
    found = vector.search(made, [1.0, 0.0, 0.0], 3).collect()
    assert [r.doc_id for r in found] == [1, 3, 2]
    assert found[0].score > 0.99 and 0.70 < found[1].score < 0.72 and abs(found[2].score) < 1e-6
    assert vector.search(made, [], 3).count() == 0 and vector.search(made, [1.0, 0.0, 0.0], 0).count() == 0
    many = spark.createDataFrame([(9, [0.0, 2.0, 0.0]), (10, None)], "query_id long, vector array<float>")
    assert [(r.query_id, r.doc_id, r["rank"]) for r in vector.search_many(made, many, 2).orderBy("rank").collect()] == [(9, 2, 1), (9, 3, 2)]
    for bad in ([0.0, 0.0, 0.0], [float("inf"), 0.0, 0.0]):
        with pytest.raises(vector.InvalidVector):
            vector.search(made, bad, 1)
    with pytest.raises(Exception, match="differ in length"):
        vector.search(made, [1.0, 0.0], 1).collect()
    with pytest.raises(vector.InvalidVector):
        vector.build_vectors(df, "id", "v", 3, strict=True)
    sizes = vector.dimensions(made).first()
    assert (sizes.n, sizes.width) == (3, 3)


def test_vector_files(spark, tmp_path):
    ids, rows = np.array([11, 12]), np.array([[3.0, 0, 0], [0, 4.0, -1.0]], dtype=np.float32)
    legacy = vectors.HEADER.pack(vectors.MAGIC, 1, 3, 2) + ids.astype("<u4").tobytes() + rows.tobytes()
    (tmp_path / "v1.bin").write_bytes(legacy)
    read = vectors.read_binary(spark, str(tmp_path / "v1.bin"))
    assert {r.doc_id: r.qvec for r in read.collect()} == {11: [127, 0, 0], 12: [0, 123, -31]}
    again = vectors.encode(ids, vectors.quantise_rows(rows))
    assert vectors.decode(again)[1].tolist() == [[127, 0, 0], [0, 123, -31]]
    for damaged in (vectors.MAGIC, again[:-1], again + b"x", b"XXXXXXXX" + again[8:], again[:-1] + struct.pack("b", -128)):
        with pytest.raises(vector.InvalidVector):
            vectors.decode(damaged)
    vectors.write_vectors(read, f"{tmp_path}/q")
    assert vectors.read_vectors(spark, f"{tmp_path}/q").count() == 2


def test_fusion(spark):
    lexical = spark.createDataFrame([(5, 9.0, 1), (46743, 8.0, 2), (0, 7.0, 3)], "doc_id long, score double, rank int")
    semantic = spark.createDataFrame([(0, 0.9, 1), (7, 0.8, 2), (46743, 0.7, 3)], "doc_id long, score double, rank int")
    rows = {r.doc_id: r for r in fusion.fuse(lexical, semantic, 10).collect()}
    assert set(rows) == {5, 7, 46743}
    assert rows[46743].score == pytest.approx(1 / 62 + 1 / 63, abs=1e-9) and rows[46743]["rank"] == 1
    assert rows[5].semantic_rank is None and rows[7].lexical_score is None
    turned = {r.doc_id: r.score for r in fusion.fuse(semantic, lexical, 10).collect()}
    assert turned == {d: r.score for d, r in rows.items()}
    assert fusion.fuse(lexical, semantic, 1).count() == 1
    assert tuple(fusion.fusion_stats(lexical, semantic).first()) == ("RRF", 60.0, 3, 3)
    store = spark.createDataFrame([(3, "c"), (1, "a")], "_id long, score string")
    assert [(r.ordinal, r._id) for r in fusion.lookup(store, [1, 2, 3]).collect()] == [(0, 1), (2, 3)]
    assert fusion.lookup(store, []).count() == 0


def test_survey(spark):
    rows = [
        (1, 1, "a", " Head ", "https://x.example/1", "d" * 900),
        (1, 2, "b", "Same", "https://x.example/1", None),
        (1, 3, None, "", "https://x.example/2", ""),
        (1, 4, "c", "Bad", "http://x.example/3", ""),
        *[(1, n, str(n), f"H{n}", f"https://x.example/{n}", "") for n in range(5, 12)],
    ]
    df = spark.createDataFrame(rows, "q long, pos int, id string, headline string, url string, description string")
    kept = survey.usable_sources(df, "q", "pos").orderBy("place").collect()
    assert [r.headline for r in kept] == ["Head", "H5", "H6", "H7", "H8"] and len(kept[0].description) == 700
    pages = survey.readable(spark.createDataFrame([(1, 1, "a", "H", "u", "<p>" + "w " * 200 + "</p>"), (1, 2, "", "I", "v", "<p>short</p>")], "q long, place int, id string, headline string, url string, html string"), "html")
    block = survey.source_block(pages, "q").first().block
    assert block.startswith("SOURCE 1\nID: a\nHEADLINE: H\nURL: u\nARTICLE TEXT:\nw w") and "SOURCE 2" not in block


def test_workload(spark):
    df = spark.createDataFrame([(d, "all " + ("half " if d % 2 else "") + f"rare{d}") for d in range(1, 201)], "doc_id long, text string")
    index = build_index(df)
    terms = workload.workload_terms(index).collect()
    assert {(r.bucket, r.place, r.term) for r in terms if r.bucket == "high_df"} == {("high_df", 1, "all"), ("high_df", 2, "half")}
    assert [r.term for r in sorted(terms, key=lambda r: r.place) if r.bucket == "rare_df"] == ["rare1", "rare10", "rare100", "rare101", "rare102", "rare103", "rare104", "rare105"]
    queries = workload.workload(index).orderBy("query_id").collect()
    assert [len(q.terms) for q in queries] == [1] * 10 + [2] + [2] * 4 + [4]
    stats = workload.percentiles(spark.createDataFrame([("g", float(x)) for x in range(5)], "g string, x double"), "x", ["g"]).first()
    assert (stats.p50, stats.p95, stats["mean"]) == (2.0, 3.8, 2.0)
    a = spark.createDataFrame([(1, 5, 1.0), (2, 6, 0.5)], "rank int, doc_id long, score double")
    assert workload.differences(a, a).count() == 0 and workload.differences(a, a.limit(1)).count() == 1


def test_streaming(spark, tmp_path):
    source, target = f"{tmp_path}/in", f"{tmp_path}/out"
    schema = "doc_id long, text string, at timestamp"
    spark.sql("SELECT 1L AS doc_id, 'Cat dog' AS text, timestamp'2024-01-01 10:00:00' AS at").write.parquet(source)
    stream = lambda: spark.readStream.schema(schema).parquet(source)
    ingest.append_tokens(stream(), target, f"{tmp_path}/c").awaitTermination(120)
    spark.sql("SELECT 2L AS doc_id, 'bird' AS text, timestamp'2024-01-03 10:00:00' AS at").write.mode("append").parquet(source)
    ingest.append_tokens(stream(), target, f"{tmp_path}/c").awaitTermination(120)
    assert {r.doc_id: r.tokens for r in spark.read.parquet(target).collect()} == {1: ["cat", "dog"], 2: ["bird"]}
    query = ingest.arrivals(stream(), "at", "doc_id").writeStream.format("memory").queryName("arrived").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sum(r.n_docs for r in spark.sql("SELECT * FROM arrived").collect()) == 2


def test_a_folder_is_listed_and_emptied_by_tasks(spark, tmp_path, monkeypatch):
    at = tmp_path / "texts"
    (at / "below").mkdir(parents=True)
    for name, content in {"b %41.txt": "é\n".encode(), "a.txt": b"", "c.txt": b"x" * 70_000, ".hidden": b"?", "_hidden": b"?", "below/d.txt": b"?"}.items():
        (at / name).write_bytes(content)
    monkeypatch.setattr(type(spark), "read", property(lambda self: pytest.fail("Spark's reader lists the files in the driver")))
    monkeypatch.setattr(news, "READ", 4)
    for folder in (f"file://{at}", str(at)):
        rows = news.read_folder(spark, folder).orderBy("doc_id").collect()
        assert [(r.doc_id, r.path, len(r.text)) for r in rows] == [(1, f"file:{at}/a.txt", 0), (2, f"file:{at}/b %41.txt", 2), (3, f"file:{at}/c.txt", 70_000)]
    news.drop_files(spark, str(at))
    assert [f.name for f in at.iterdir()] == ["below"]
    news.write_files(spark.createDataFrame([(f"{n}.txt", "é\n") for n in range(9)], "file_name string, content string").repartition(3), f"file://{at}")
    assert sorted(f.name for f in at.iterdir()) == [*[f"{n}.txt" for n in range(9)], "below"]
