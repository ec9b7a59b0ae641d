"""Folder trees: relative paths, unreadable files as rows, mirrored outputs."""

import json
import os

import pytest

from umbra.sources import folders


@pytest.fixture
def tree(tmp_path):
    top = tmp_path / "in"
    (top / "a/b").mkdir(parents=True)
    (top / "one.txt").write_text("mail ann@x.example.com")
    (top / "a/b/two.txt").write_text("é call 0412 345 678")
    (top / "a/empty.txt").write_text("")
    (top / "a/broken.txt").write_bytes(b"\xff\xfe\xfa")
    (top / "a/other.csv").write_text("x")
    os.symlink(tmp_path / "nowhere", top / "a/gone.txt")  # listed, but can't be opened
    return top


def test_mirrored_tree_and_error_rows(spark, tree, tmp_path):
    done = {r.path: r for r in folders.process_folder(spark, str(tree), str(tmp_path / "out"), "*.txt", active={"EMAIL_ADDRESS", "AU_PHONE"}).collect()}
    assert {p for p, r in done.items() if r.success} == {"one.txt", "a/b/two.txt", "a/empty.txt"}
    assert not done["a/broken.txt"].success and done["a/broken.txt"].error == "not UTF-8"
    out = tmp_path / "out"
    assert (out / "anonymized/one.txt").read_text() == "mail <EMAIL_ADDRESS>" and (out / "anonymized/a/b/two.txt").read_text() == "é call <AU_PHONE>"
    assert json.loads((out / "analysis/a/b/two.txt.json").read_text())["entity_count"] == 1
    assert not (out / "anonymized/a/broken.txt").exists() and (out / "anonymized/a/empty.txt").read_text() == ""


def test_files_come_back_as_they_were(spark, tree, tmp_path):
    rows = folders.read_folder(spark, str(tree)).where("error is null")
    folders.write_folder(rows, f"file://{tmp_path}/copy")
    for p in tree.rglob("*"):
        if p.is_file():
            assert (tmp_path / "copy" / p.relative_to(tree)).read_bytes() == p.read_bytes()
    assert folders.read_folder(spark, str(tree), recursive=False).count() == 1
    empty = tmp_path / "none"
    empty.mkdir()
    assert folders.read_folder(spark, str(empty)).count() == 0


def test_an_unreadable_file_is_a_row(tmp_path, monkeypatch):
    (tmp_path / "x.txt").write_text("x")
    reader = folders._Reader({"path": str(tmp_path)})
    part = reader.partitions()[0]
    part.paths.append("lost.txt")  # gone between listing and reading
    rows = list(reader.read(part))
    assert rows[0] == ("x.txt", b"x", None) and rows[1][:2] == ("lost.txt", None) and "lost.txt" in rows[1][2]


def test_paths_stay_inside(spark, tmp_path):
    bad = spark.createDataFrame([("../x", bytearray(b"x"))], "path string, content binary")
    with pytest.raises(Exception, match="not a path inside"):
        folders.write_folder(bad, str(tmp_path / "t"))
