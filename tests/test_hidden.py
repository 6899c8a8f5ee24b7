"""Files with names that Spark hides."""

import pytest

from evalspark.functions import text as tx
from evalspark.sources import files, hidden


@pytest.fixture
def folder(tmp_path):
    for name, text in {
        "plain.txt": "plain",
        "_index.md": "# Index\n*of* all",
        ".notes.md": "notes",
        "sub/_draft.TXT": "draft",
        ".private/deep/er/a.txt": "a b",
        "_part=1/b.txt": "seen by Spark",
        "sub/_blank.txt": " \n",
        "_scan.pdf": "pages",
        "_table.csv": "1,2",
        "_big.txt": "x" * 60,
    }.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return tmp_path


def names(rows, root):
    return {r[0].removeprefix(f"file:{root}/"): r[1] for r in rows}


def test_loaded_or_rejected(spark, folder):
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 50)
    try:
        documents, rejects = files.load_files(spark, str(folder))
        rows = documents.orderBy("doc_id").collect()
        rejected = rejects.collect()
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert names([(r.source, r.text) for r in rows], folder) == {
        "plain.txt": "plain",
        "_index.md": "Index\nof all",
        ".notes.md": "notes",
        "sub/_draft.TXT": "draft",
        ".private/deep/er/a.txt": "a b",
        "_part=1/b.txt": "seen by Spark",
    }
    assert [r.doc_id for r in rows] == list(range(6))
    assert [r.source for r in rows] == sorted((r.source for r in rows), key=lambda s: s.split("/"))
    assert names(rejected, folder) == {
        "sub/_blank.txt": "empty",
        "_scan.pdf": "no loader",
        "_table.csv": "unsupported",
        "_big.txt": "too large",
    }


def test_loader_of_the_user(spark, folder):
    documents, _ = files.load_files(spark, f"file://{folder}", {".pdf": tx.decode_utf8})
    assert [(r.filename, r.text) for r in documents.collect()] == [("_scan.pdf", "pages")]


def test_same_files_however_listed(folder, monkeypatch):
    """Folders listed by the driver or by tasks, each file comes once."""
    found = []
    for most in (1, 3, 1000):
        monkeypatch.setattr(hidden, "FOLDERS", most)
        reader = hidden.HiddenFilesReader({"path": str(folder), "suffixes": ".md,.txt", "limit": "50"})
        rows = [row for part in reader.partitions() for row in reader.read(part)]
        assert len({row[0] for row in rows}) == len(rows) == 8
        found.append(sorted(rows, key=lambda row: row[0]))
    assert found[0] == found[1] == found[2]
    content = {row[0].rsplit("/", 1)[1]: row[2] for row in found[0]}
    assert content["_draft.TXT"] == b"draft" and content["_scan.pdf"] is None and content["_big.txt"] is None


def test_file_that_cannot_be_read(folder):
    """It was listed, but is gone or closed to the task: a row without content."""
    from pyarrow import fs

    system, root, _ = hidden.opened(str(folder))
    info = system.get_file_info(f"{root}/_index.md")
    reader = hidden.HiddenFilesReader({"path": str(folder), "suffixes": ".md"})
    assert info.type == fs.FileType.File and reader.content(system, info) == b"# Index\n*of* all"
    (folder / "_index.md").unlink()
    assert reader.content(system, info) is None


def test_rule_of_names():
    hiding = [n for n in ("a", "_a", ".a", "_a=1", "a._COPYING_", "_metadata", "_common_metadata.md", "a_b") if hidden.hides(n)]
    assert hiding == ["_a", ".a", "a._COPYING_"]
