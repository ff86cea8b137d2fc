"""Writing, speech, pictures, limits, the facade, and small tables on all cores."""

import zipfile

import pytest

import skerry
from skerry import cli
from skerry.operators import layout, output, records
from skerry.operators.file_search import Pictures, search_files
from skerry.sources import extract
from skerry.sources.cache import UnitCache
from skerry.sources.files import list_files
from skerry.streaming.scores import scored_stream

CONTAINS = {"contains": 1.0}


def read_writing(data):
    return data.decode("utf-8", "ignore").strip("\0")


def read_speech(data):
    return [(160, data.decode()), (200, "nothing")]


def vector(text):
    return [1.0, 0.0] if "beach" in text else [0.6, 0.8]


def vectors_of(pictures):
    return [[1.0, 0.0] if b"sand" in p else [0.0, 1.0] for p in pictures]


@pytest.fixture
def tree(tmp_path):
    (tmp_path / "scan.png").write_bytes(b"invoice total")
    (tmp_path / "noise.png").write_bytes(b"ab 12 !!")
    (tmp_path / "talk.mp3").write_bytes(b"welcome to the invoice meeting")
    (tmp_path / "sea.jpg").write_bytes(b"sand")
    (tmp_path / "note.txt").write_text("invoice\n" + "long line of text\n" * 40)
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="w"><w:body><w:p><w:r><w:t>body text</w:t></w:r></w:p></w:body></w:document>')
        z.writestr("word/media/image1.png", b"invoice inside" + b"\0" * extract.LEAST_PICTURE)
        z.writestr("docProps/core.xml", '<c xmlns:d="d"><d:creator>Ann</d:creator><d:contentStatus>Draft</d:contentStatus><d:lastModifiedBy>Bob</d:lastModifiedBy></c>')
        z.writestr("docProps/app.xml", "<a><Application>Writer</Application></a>")
    return tmp_path


PORTS = extract.Ports(ocr=read_writing, speech=read_speech)


def found(spark, tree, query, **more):
    s = search_files(spark, str(tree), query, weights=CONTAINS, names=False, ports=PORTS, **more)
    return {r["path"].rsplit("/", 1)[1]: r for r in s.results.collect()}, {r["path"].rsplit("/", 1)[1]: r["reason"] for r in s.skipped.collect()}


def test_writing_and_speech_are_read_where_asked_for(spark, tree):
    got, _ = found(spark, tree, "invoice")
    assert set(got) == {"note.txt"}
    got, _ = found(spark, tree, "invoice", ocr=True, transcribe=True)
    assert {k: [(x["line_number"], x["location_kind"]) for x in r["lines"]] for k, r in got.items()} == {
        "note.txt": [(1, "line")], "scan.png": [(1, "ocr")], "talk.mp3": [(160, "transcript")], "d.docx": [(1, "ocr")],
    }
    got, _ = found(spark, tree, "invoice", ocr=True, docs_tags=False)
    assert set(got) == {"scan.png", "d.docx"}
    units = extract.units(list_files(spark, str(tree)).where("suffix = '.docx'"), PORTS, extract.Wanted(ocr=True)).orderBy("unit_ord").collect()
    assert [(u["text"].strip("\0"), u["location_kind"]) for u in units] == [
        ("body text", "paragraph"), ("invoice inside", "ocr"), ("[Author] Ann", "tag"), ("[Last saved by] Bob", "tag"), ("[Content status] Draft", "tag"), ("[Program name] Writer", "tag"),
    ]
    with pytest.raises(RuntimeError):
        search_files(spark, str(tree), "x", ocr=True)


def test_the_best_of_several_readings_counts(spark, tree):
    assert extract.reading("") == extract.reading("a b 12") == (0, 0)
    assert extract.reading("invoice total xqzvw jkkkk") == (12, 10) and extract.reading("Straße école", {"Straße"}.__contains__) == (6, 5)
    assert extract.Ports(ocr=lambda data: "xqzvw jkkkk").writing(b"") == extract.Ports(ocr=lambda data: "total xqzvw jkkkk").writing(b"") == ""
    several = extract.Ports(ocr=lambda data: ["", "v\no\ni", "invoice total", "x"])
    assert several.writing(b"") == "invoice total" and extract.Ports(ocr=lambda data: []).writing(b"") == ""
    listing = list_files(spark, str(tree)).where("suffix = '.txt'")
    assert [r["path"].rsplit("/", 1)[1] for r in search_files(spark, str(tree), "invoice", files=listing, weights=CONTAINS).results.collect()] == ["note.txt"]


def test_limits_of_each_kind(spark, tree):
    _, skipped = found(spark, tree, "invoice", max_file_bytes=20)
    assert skipped == {"note.txt": "oversized", "d.docx": "oversized"}
    got, skipped = found(spark, tree, "invoice", ocr=True, transcribe=True, max_file_bytes=20)
    assert "scan.png" in got and "talk.mp3" in got and "d.docx" in got and not skipped
    small = extract.Ports(ocr=read_writing, speech=read_speech, ocr_bytes=5, speech_bytes=5)
    s = search_files(spark, str(tree), "invoice", ports=small, ocr=True, transcribe=True, weights=CONTAINS)
    assert {(r["path"].rsplit("/", 1)[1], r["reason"]) for r in s.skipped.collect()} == {("scan.png", "ocr_too_large"), ("noise.png", "ocr_too_large"), ("talk.mp3", "transcribe_too_large")}
    body = [(1, "12345", "line"), (2, "12345", "line"), (1, "t" * 50, "tag"), (3, "123456", "line"), (2, "[a] b", "tag")]
    assert list(extract._counted(iter(body), 12)) == body[:3] and list(extract._counted(iter(body), None)) == body
    with zipfile.ZipFile(tree / "many.xlsx", "w") as z:
        for i in range(extract.archives.MAX_ENTRIES + 1):
            z.writestr(f"x{i}", "")
    assert extract.units(list_files(spark, str(tree)).where("suffix = '.xlsx'")).count() == 0


@pytest.mark.parametrize("stored", [False, True])
def test_pictures_like_the_query(spark, tree, stored):
    table = spark.createDataFrame([(str(tree / "sea.jpg"), [1.0, 0.0]), (str(tree / "scan.png"), [0.0, 1.0])], "path string, embedding array<float>")
    pictures = Pictures(vector, vectors=table) if stored else Pictures(vector, read=vectors_of)
    got, _ = found(spark, tree, "beach", pictures=pictures)
    assert set(got) == {"sea.jpg"} and got["sea.jpg"]["breakdown"]["semantic_image"] == pytest.approx(1)
    assert [(x["text"], x["location_kind"]) for x in got["sea.jpg"]["lines"]] == [("(visual match)", "semantic_image")]
    assert got["sea.jpg"]["term_surfaces"]["beach"]["semantic_image"] == pytest.approx(1)
    labels = output.match_labels(search_files(spark, str(tree), "beach", pictures=pictures, weights=CONTAINS).results).collect()
    assert [r["labels"] for r in labels] == ["image semantic"]
    got, _ = found(spark, tree, "invoice", pictures=pictures, ocr=True)
    assert [(x["location_kind"], round(x["score"], 2)) for x in got["scan.png"]["lines"]] == [("ocr", 1.0), ("semantic_image", 0.8)]
    assert found(spark, tree, "bea", pictures=pictures)[0] == {}
    assert set(found(spark, tree, "nowhere", pictures=pictures, picture_threshold=0.7)[0]) == ({"scan.png"} if stored else {"scan.png", "noise.png"})


def test_cached_units_serve_file_search(spark, tree, tmp_path_factory):
    cache = UnitCache(spark, str(tmp_path_factory.mktemp("cache")))
    first, _ = found(spark, tree, "invoice", ocr=True, cache=cache)
    again, _ = found(spark, tree, "invoice", ocr=True, cache=cache)
    plain, _ = found(spark, tree, "invoice", cache=cache)
    assert set(first) == set(again) == {"note.txt", "scan.png", "d.docx"} and set(plain) == {"note.txt"}


def test_command_line_names_what_reads(spark, tree, capsys):
    here = "tests.test_surfaces"
    args = ["invoice", str(tree), "--no-names", "--format", "flat", "--max-ocr-file-size", "20"]
    assert cli.main([*args, "--ocr", f"{here}:read_writing", "--transcribe", f"{here}:read_speech"], spark) == 0
    out, told = capsys.readouterr()
    assert "scan.png:ocr:1:" in out and "talk.mp3:transcript:160:" in out and "skipped OCR" not in told
    assert cli.main([*args[:-1], "5", "--ocr", f"{here}:read_writing"], spark) == 0
    assert "skipped OCR in" in capsys.readouterr().err
    assert cli.main(["beach", str(tree), "--names-only"], spark) == 1
    assert 'No matches for "beach"' in capsys.readouterr().err


def test_plain_calls(spark, tree):
    class Thing:
        def __init__(self, name):
            self.name, self._hidden = name, "salt"

    items = [{"name": "salad"}, {"name": "salt", "other": 7}, Thing("salty"), {"name": None}]
    out = skerry.magic_search(items, "salt", spark=spark)
    assert [r.item for r in out][0] is items[1] and set(out[0].breakdown) == {"name", "other"} and out[0].breakdown["name"]["exact"] == 1
    out = skerry.search(items, "salt", where=skerry.Q.contains("name"), spark=spark)
    assert [(r.item, r.score, r.breakdown) for r in out] == [(items[1], 1.0, {"name": 1.0}), (items[2], 1.0, {"name": 1.0})]
    assert skerry.search(items, " ", fields=["name"]) == [] and skerry.search([], "x", fields=["name"]) == []
    with pytest.raises(ValueError):
        skerry.search(items, "x")
    told, skipped = [], []
    out = skerry.magic_file_search(str(tree), "invoice", search_names=False, max_file_size=400, skipped_files=skipped, on_result=told.append, spark=spark)
    assert out == told and [r.path.rsplit("/", 1)[1] for r in out] == [] or out[0].lines[0].line_number == 1
    assert {s.path.rsplit("/", 1)[1] for s in skipped} >= {"note.txt"}
    with pytest.warns(DeprecationWarning):
        skerry.magic_file_search(str(tree), "invoice", max_line_matches=1, spark=spark)


def test_hit_rate(spark):
    ranked = spark.createDataFrame([("q", 1, 1), ("q", 2, 2), ("r", 5, 3)], "query string, id int, rank int")
    wanted = spark.createDataFrame([("q", 2), ("r", 5)], "query string, id int")
    assert [records.hit_rate(ranked, wanted, k).first()["rate"] for k in (1, 2, 3)] == [0, 0.5, 1]


def test_small_tables_are_dealt_out_and_results_written_once(spark, monkeypatch, tmp_path):
    df = spark.range(10).coalesce(1)
    assert layout.spread(df).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(layout, "SMALL_BYTES", 1)
    assert layout.spread(df).rdd.getNumPartitions() == 1
    assert layout.once(df, "x").count() == 10
    monkeypatch.setattr(layout, "shared_folder", lambda s: None)
    assert layout.once(df, "x") is df


def test_scores_on_a_stream_are_those_of_the_table(spark, tmp_path):
    rows = spark.createDataFrame([(1, "alpha\nbeta"), (2, "gamma alpha"), (3, None)], "id long, t string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = scored_stream(spark, str(tmp_path / "in"), rows.schema, "id", "t", "alpha", CONTAINS)
    q = stream.writeStream.format("memory").queryName("scores").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(tuple(r) for r in spark.table("scores").select("file_id", "line_number", "score").collect()) == [(1, 1, 1.0), (2, 1, 1.0)]
