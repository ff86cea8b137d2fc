import gzip
import json
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from skerry import cli
from skerry.operators import output
from skerry.operators.file_search import search_files
from skerry.plans.query import parse_file_query
from skerry.sources import extract
from skerry.sources.files import WalkOptions, list_files

CONTAINS = {"contains": 1.0}
ARCHIVES = WalkOptions(include_archives=True)


@pytest.fixture
def tree(tmp_path):
    for name, text in {
        "notes.txt": "alpha\nquarterly revenue projections\nomega\n", "both.txt": "alpha beta", "split.txt": "alpha\nbeta", "alpha-only.txt": "nothing",
        ".hidden/a.txt": "alpha", "node_modules/x.txt": "alpha", "yarn.lock": "alpha", "sub/deep/far.md": "one\r\ntwo\rrevenue", "empty.txt": "", "app.min.js": "alpha",
    }.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text.encode())
    (tmp_path / "blob.bin").write_bytes(b"alpha\0")
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("in/member.txt", "first\nrevenue in zip")
    with tarfile.open(tmp_path / "b.tar.gz", "w:gz") as t:
        t.add(tmp_path / "both.txt", "inside.txt")
    (tmp_path / "c.txt.gz").write_bytes(gzip.compress(b"revenue gz"))
    (tmp_path / "broken.zip").write_bytes(b"no zip")
    return tmp_path


def _rel(df):
    return sorted(r["rel_path"] for r in df.collect())


def test_walk_filters_and_archives(spark, tree):
    plain = WalkOptions(include_archives=False)
    names = _rel(list_files(spark, str(tree), plain))
    assert "sub/deep/far.md" in names and not {".hidden/a.txt", "node_modules/x.txt", "yarn.lock", "app.min.js"} & set(names)
    assert {".hidden/a.txt", "yarn.lock"} <= set(_rel(list_files(spark, str(tree), WalkOptions(False, False, False))))
    flagged = {r["rel_path"]: r["names_only"] for r in list_files(spark, str(tree), WalkOptions(match_skipped_names=True)).collect()}
    assert flagged["yarn.lock"] and flagged["node_modules/x.txt"] and not flagged["notes.txt"]
    assert "sub/deep/far.md" not in _rel(list_files(spark, str(tree), WalkOptions(include_subdirectories=False)))
    assert {"a.zip::in/member.txt", "b.tar.gz::inside.txt", "c.txt.gz::c.txt"} <= set(_rel(list_files(spark, str(tree), ARCHIVES)))
    assert _rel(list_files(spark, str(tree / "yarn.lock"))) == ["yarn.lock"]
    with pytest.raises(FileNotFoundError):
        list_files(spark, str(tree / "none"))


def test_shared_out_walk_finds_the_same(spark, tree, monkeypatch):
    whole = _rel(list_files(spark, str(tree), ARCHIVES))
    for seeds in (1, 2, 3):
        monkeypatch.setattr("skerry.sources.files.SEEDS", seeds)
        assert _rel(list_files(spark, str(tree), ARCHIVES)) == whole


def test_units_of_lines_and_office_files(spark, tree):
    with zipfile.ZipFile(tree / "d.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="w"><w:body><w:p><w:r><w:t>first</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>third </w:t><w:t>one</w:t></w:r></w:p></w:body></w:document>')
        z.writestr("docProps/core.xml", '<c xmlns:d="d"><d:creator>Ann</d:creator><d:keywords>x; y</d:keywords></c>')
    with zipfile.ZipFile(tree / "s.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", '<w xmlns:r="r"><sheets><sheet name="Late" r:id="x2"/><sheet name="Data" r:id="x1"/></sheets></w>')
        z.writestr("xl/_rels/workbook.xml.rels", '<r><Relationship Id="x1" Target="worksheets/sheet1.xml"/><Relationship Id="x2" Target="/xl/worksheets/sheet2.xml"/></r>')
        z.writestr("xl/worksheets/sheet2.xml", "<w><row><c><v>1</v></c></row></w>")
        z.writestr("xl/sharedStrings.xml", "<s><si><t>red</t></si></s>")
        z.writestr("xl/worksheets/sheet1.xml", '<w><row/><row><c t="s"><v>0</v></c><c><v>7</v></c></row></w>')
    with zipfile.ZipFile(tree / "p.pptx", "w") as z:
        z.writestr("ppt/slides/slide1.xml", "<s><txBody><p><t>hello</t></p></txBody><txBody><p><t>world</t></p></txBody></s>")
    (tree / "bad.docx").write_bytes(b"not one")
    files = list_files(spark, str(tree), WalkOptions(include_archives=False))
    rows = extract.units(files).join(files.select("file_id", "name"), "file_id").collect()
    got = {n: [(r["line_number"], r["text"], r["location_kind"]) for r in sorted((r for r in rows if r["name"] == n), key=lambda r: r["unit_ord"])] for n in {r["name"] for r in rows}}
    assert got["d.docx"] == [(1, "first", "paragraph"), (3, "third one", "paragraph"), (1, "[Author] Ann", "tag"), (2, "[Keywords] x", "tag"), (3, "[Keywords] y", "tag")]
    assert got["s.xlsx"] == [(1, "[Late] 1", "row"), (2, "[Data] red 7", "row")] and got["p.pptx"] == [(1, "hello world", "slide")]
    assert [t for _, t, _ in got["far.md"]] == ["one", "two", "revenue"]
    assert not {"blob.bin", "bad.docx", "empty.txt"} & set(got)


def test_terms_may_be_on_different_lines_and_are_rescued(spark, tree):
    found = {r["path"].rsplit("/", 1)[1]: r for r in search_files(spark, str(tree), "alpha & beta", names=False, weights=CONTAINS, options=WalkOptions(include_archives=False)).results.collect()}
    assert set(found) == {"both.txt", "split.txt"}
    assert [(x["line_number"], x["matched_term"]) for x in found["split.txt"]["lines"]] == [(1, "alpha"), (2, "beta")]
    assert [(x["line_number"], x["matched_term"]) for x in found["both.txt"]["lines"]] == [(1, None)]
    mixed = search_files(spark, str(tree), "alpha & nothing", weights=CONTAINS).results.collect()
    assert [r["path"].rsplit("/", 1)[1] for r in mixed] == ["alpha-only.txt"]
    assert mixed[0]["term_surfaces"]["alpha"] == {"name": 1.0, "content": 0.0}


def test_limits_order_and_empty_queries(spark, tree):
    (tree / "many.txt").write_text("\n".join(f"token line {i}" for i in range(100)))
    one = search_files(spark, str(tree), "token", weights=CONTAINS, max_matches=3).results.collect()
    assert [x["line_number"] for x in one[0]["lines"]] == [1, 2, 3] and one[0]["breakdown"] == {"name": 0.0, "content": 1.0}
    assert search_files(spark, str(tree), "  ").results.count() == 0
    with pytest.raises(ValueError):
        search_files(spark, str(tree), "x", names=False, contents=False)
    big = search_files(spark, str(tree), "many", weights=CONTAINS, max_file_bytes=50)
    assert [r["breakdown"] for r in big.results.collect()] == [{"name": 1.0}]
    assert {r["path"].rsplit("/", 1)[1]: r["reason"] for r in big.skipped.collect()}["many.txt"] == "oversized"
    files, skipped = extract.skips(list_files(spark, str(tree)), extract.Ports(), extract.Wanted(max_bytes=0))
    assert skipped.count() == 0 and files.where("names_only").count() == 0
    with pytest.raises(ValueError):
        search_files(spark, str(tree), "x", docs_tags=False)


def test_outputs(spark, tree):
    (tree / "rep.txt").write_text("Revenue\nRevenue\nx\nRevenue")
    q = parse_file_query("revenue")
    found = search_files(spark, str(tree), q, weights=CONTAINS, options=ARCHIVES).results
    flat = [r["flat"].rsplit("/", 1)[1] for r in output.flat_lines(found).collect()]
    assert "notes.txt:line:2:100%:quarterly revenue projections" in flat and "member.txt:line:2:100%:revenue in zip" in flat
    texts = [x["preview"] for r in output.json_rows(found, q).collect() for x in json.loads(r["json"])["lines"]]
    assert "quarterly «revenue» projections" in texts
    grouped = {r["path"].rsplit("/", 1)[1]: r["ranges"] for r in output.grouped_lines(found, q).collect()}
    assert grouped["rep.txt"] == "1-2, 4"
    assert {r["labels"] for r in output.match_labels(found).collect()} == {"content"}
    assert output.unpacked(output.packed(found), found.schema).orderBy("path").collect() == found.orderBy("path").collect()
    long = spark.createDataFrame([("a " * 200 + "needle" + " b" * 200,), ("c" * 300,), (None,)], "t string").select(output.preview(F.col("t"), ["needle"]).alias("p")).collect()
    assert "«needle»" in long[0]["p"] and len(long[0]["p"]) <= 106 and len(long[1]["p"]) == 100 and long[2]["p"] is None


def test_command_line(spark, tree, capsys):
    assert cli.main(["revenue", str(tree), "--content-only", "--format", "flat", "-o", str(tree / "out.log")], spark) == 0
    assert "quarterly revenue projections" in capsys.readouterr().out
    assert cli.main(["revenue", str(tree), "--content-only"], spark) == 0
    out = capsys.readouterr().out
    assert out.startswith('2 files matched for "revenue"') or out.startswith('3 files matched for "revenue"')
    assert "notes.txt ──" in out and "   line 2  ·  match " in out and "   │ quarterly «revenue» projections" in out
    assert cli.main(["revenue", str(tree), "--no-names", "--json"], spark) == 0
    assert all(x["lines"] for x in json.loads(capsys.readouterr().out))
    with pytest.raises(SystemExit):
        cli.main(["a", str(tree), "--limit", "0"], spark)
    assert cli.main(["zzzzqqqq", str(tree), "--threshold", "0.99"], spark) == 1
    assert cli.main(["a&", str(tree)], spark) == 2 and cli.main(["a", str(tree / "none")], spark) == 2
