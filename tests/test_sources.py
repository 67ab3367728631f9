import struct
import zlib

import pytest
from pyspark.errors import PySparkException

from ledgerframe.sources import files


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "set"
    for name, content in (("Batik/Parang/a.jpg", b"one"), ("Batik/flanel_x (2).PNG", b"two"), ("non batik/kain_y12.jpeg", b"one"), ("non batik/notes.txt", b"text")):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(content)
    return root


def test_labelled_files(spark, tree):
    rows = {r["path"]: r for r in files.labelled_files(spark, str(tree), ("batik", "non_batik"), "development").collect()}
    assert sorted(rows) == ["Batik/Parang/a.jpg", "Batik/flanel_x (2).PNG", "non batik/kain_y12.jpeg"]
    assert {r["class"] for r in rows.values()} == {"batik", "non_batik"}
    assert rows["Batik/Parang/a.jpg"]["subtype"] == "Parang" and rows["Batik/flanel_x (2).PNG"]["subtype"] == "x" and rows["non batik/kain_y12.jpeg"]["subtype"] == "y"
    assert rows["Batik/Parang/a.jpg"]["sha256"] == rows["non batik/kain_y12.jpeg"]["sha256"]
    assert rows["Batik/flanel_x (2).PNG"]["extension"] == ".png" and rows["Batik/flanel_x (2).PNG"]["bytes"] == 3


def test_unknown_class_is_an_error(spark, tree):
    with pytest.raises(ValueError, match="unknown class: non_batik"):
        files.labelled_files(spark, str(tree), ("batik", "flanel"), "development")
    with pytest.raises(PySparkException, match="unknown class"):
        files.labelled_files(spark, str(tree), ("batik",), "development").collect()


def test_a_class_without_files_is_an_error(spark, tree):
    with pytest.raises(ValueError, match="no files of class kain"):
        files.labelled_files(spark, str(tree), ("batik", "non_batik", "kain"), "development")


def test_inventory(spark, tree):
    expected = spark.createDataFrame([("Batik/Parang/a.jpg",), ("gone.jpg",)], "path string")
    rows = {r["path"]: r for r in files.inventory(spark, str(tree), expected).collect()}
    assert rows["Batik/Parang/a.jpg"]["exists"] and rows["Batik/Parang/a.jpg"]["bytes"] == 3
    assert not rows["gone.jpg"]["exists"] and rows["gone.jpg"]["sha256"] is None


def png(width, height):
    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    rows = b"".join(b"\0" + bytes(range(width)) for _ in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("name", ["set", "my.data+v1 (2)"])
def test_image_sizes_are_met_by_path(spark, tmp_path, name):
    root = tmp_path / name / name  # the root's name comes twice in a path
    for path, content in (("c/x.jpg", b"no image"), ("abc/x.jpg", png(5, 3)), ("abc/a b.png", png(7, 2))):
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(content)
    manifest = files.labelled_files(spark, str(root), ("c", "abc"), "development")
    images = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", True).load(str(root))
    rows = {r["path"]: (r["readable"], r["width"], r["height"]) for r in files.with_image_size(manifest, images, str(root)).collect()}
    assert rows == {"c/x.jpg": (False, 0, 0), "abc/x.jpg": (True, 5, 3), "abc/a b.png": (True, 7, 2)}
    assert files.with_image_size(manifest, images, str(root)).count() == 3


def test_text_csv_has_no_nulls(spark, tmp_path):
    (tmp_path / "d.csv").write_text("a,b\n1,\n,x\n")
    assert sorted(map(tuple, files.read_text_csv(spark, str(tmp_path / "d.csv"), ["a", "b"]).collect())) == [("", "x"), ("1", "")]


def test_table_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, None)], "a int, b string")
    files.write_table(df, str(tmp_path / "p"))
    files.write_table(df, str(tmp_path / "p"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "p")).collect())) == [(1, "x"), (2, None)]


def test_significant_digits_json_markdown_and_cache(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.1 + 0.2, "a|b"), (2, None, None)], "a int, x double, s string")
    files.write_table(df, str(tmp_path / "c"), "csv", digits=15)
    assert sorted(map(tuple, spark.read.csv(str(tmp_path / "c"), header=True).collect()), key=str) == [("1", "0.3", "a|b"), ("2", None, None)]
    files.write_json(df, str(tmp_path / "j"))
    assert sorted((r["a"], r["x"], r["s"]) for r in files.read_json(spark, str(tmp_path / "j")).where("a = 1").collect()) == [(1, 0.1 + 0.2, "a|b")]
    (tmp_path / "doc.json").write_text('{"best": {"model": "m",\n "f1": 0.5}}')
    assert files.read_json(spark, str(tmp_path / "doc.json")).select("best.model").head()[0] == "m"
    assert files.markdown(df.orderBy("a")) == "| a | x | s |\n| --- | --- | --- |\n| 1 | 0.300 | a\\|b |\n| 2 |  |  |"
    with pytest.raises(ValueError, match="over 1 rows"):
        files.markdown(df, most=1)
    made = []
    for key in ({"k": 1}, {"k": 1}, {"k": 2}):
        assert files.cached(spark, str(tmp_path / "kept"), key, lambda: made.append(1) or df).count() == 2
    assert len(made) == 2


def test_outputs_are_listed_in_order(spark, tree):
    rows = files.outputs(spark, str(tree)).collect()
    assert [r["path"] for r in rows] == ["Batik/Parang/a.jpg", "Batik/flanel_x (2).PNG", "non batik/kain_y12.jpeg", "non batik/notes.txt"]
    assert all(r["modified"] is not None and len(r["sha256"]) == 64 for r in rows)


def test_parts_must_be_complete(spark, tmp_path):
    for arm, repeat in (("a", 1), ("a", 2), ("b", 1)):
        (tmp_path / f"{arm}__r{repeat}__metrics.csv").write_text(f"arm,repeat,f1\n{arm},{repeat},0.5\n")
    got = files.complete_parts(spark, str(tmp_path / "a__*__metrics.csv"), "arm string, repeat int, f1 double", "repeat", [1, 2])
    assert got.count() == 2
    with pytest.raises(ValueError, match="missing repeat: 2"):
        files.complete_parts(spark, str(tmp_path / "b__*__metrics.csv"), "arm string, repeat int, f1 double", "repeat", [1, 2])


def test_zip_members(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/media/a.png", b"abc")
        z.writestr("word/document.xml", b"x")
    rows = files.zip_members(spark, str(tmp_path / "d.docx"), "word/media/").collect()
    assert [(r["member"], r["bytes"]) for r in rows] == [("word/media/a.png", 3)]
    assert rows[0]["sha256"] == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"


def test_upload_checks(spark):
    rows = spark.createDataFrame([("a", 0, 100, 100), ("b", 11 << 20, 100, 100), ("c", 10, 20, 100), ("d", 10, 9000, 9000), ("e", 10, 100, 100), ("f", 10, None, None), ("g", 10, 100, None), ("h", 10, None, 100)], "k string, bytes long, width int, height int")
    got = dict(rows.select("k", files.upload_problem(rows["bytes"], rows["width"], rows["height"])).collect())
    assert got == {"a": "empty", "b": "too large", "c": "too small", "d": "too many pixels", "e": None, "f": "unreadable", "g": "unreadable", "h": "unreadable"}


def test_reports_and_loggers(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5)], "a int, x double")
    said = files.write_report(spark, str(tmp_path / "r" / "report.md"), "Audit", [("Counts", df), ("Notes", "none")])
    assert (tmp_path / "r" / "report.md").read_text() == said == "# Audit\n\n## Counts\n\n| a | x |\n| --- | --- |\n| 1 | 0.500 |\n\n## Notes\n\nnone\n"
    log = files.tee_logger("ledgerframe-test", str(tmp_path / "log.txt"))
    log.info("a line")
    assert (tmp_path / "log.txt").read_text().endswith("INFO a line\n")
