import io
import json
import logging
import os
import subprocess
import sys

import pytest
from pyspark.errors import PySparkException

from sievelake import DiffResult, ReportSummary, ScanResult, scan, scanning
from sievelake.operators import inventory, reports
from sievelake.scanning import ScanMetadata, progress_bar
from sievelake.sources.file_tree import FileTreeReader, list_files, read_tree


def make(root, files):
    for name, content in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return root


def test_groups_order_and_filters(spark, tmp_path):
    make(tmp_path, {"a/b.txt": "two", "a.txt": "two", "c.TXT": "three", "d.jpg": "three", "e e.png": "three", ".hidden": "", "empty.tar.gz": "", "Makefile": "own", "x/" * 10 + "deep": "own2"})
    whole = scan(root=tmp_path, spark=spark)
    assert whole.file_count == 9 and whole.total_bytes == 2 * 3 + 3 * 5 + 3 + 4
    assert whole.duplicates == [["c.TXT", "d.jpg", "e e.png"], [".hidden", "empty.tar.gz"], ["a/b.txt", "a.txt"]]
    count = lambda **f: scan(root=tmp_path, spark=spark, **f).file_count
    assert count(extensions={"txt"}) == 3 and count(extensions={"gz"}) == 1 and count(extensions={"tar"}) == 0
    assert count(extensions={""}) == 3 and count(extensions=set()) == 0
    small = scan(root=tmp_path, max_file_size=3, spark=spark)
    assert (small.file_count, small.skipped_oversized) == (5, 4)
    assert scan(root=tmp_path, max_file_size=0, spark=spark).file_count == 2
    assert whole.metadata.to_json().keys() == {"tool_version", "scanned_root", "timestamp"}
    with pytest.raises(AttributeError):
        whole.file_count = 1


def test_links(spark, tmp_path):
    root = make(tmp_path / "r", {"real.txt": "same", "sub/in.txt": "in"})
    (root / "link.bin").symlink_to(root / "real.txt")
    (root / "broken").symlink_to(root / "nowhere")
    (root / "folder").symlink_to(root / "sub")
    assert [p.name for p in list_files(root)] == ["link.bin", "real.txt", "in.txt"]
    assert scan(root=root, spark=spark).duplicates == [["link.bin", "real.txt"]]
    skipped = scan(root=root, extensions={"txt"}, follow_symlinks=False, spark=spark)
    assert (skipped.file_count, skipped.skipped_symlinks) == (2, 1)


def test_many_large_and_unreadable_files(spark, tmp_path, monkeypatch):
    make(tmp_path, {f"{i}.bin": bytes([i % 10]) * 10 for i in range(100)} | {"big": b"\0" * (2 << 20), "big2": b"\0" * (2 << 20)})
    result = scan(root=tmp_path, spark=spark)
    assert [len(g) for g in result.duplicates] == [10] * 10 + [2] and result.file_count == 102
    assert read_tree(spark, tmp_path, files_in_partition=7, hashed=False).select("sha256").distinct().count() == 1
    reader = FileTreeReader({"path": str(tmp_path)})
    monkeypatch.setattr("sievelake.sources.file_tree.sha256_file", lambda p: (_ for _ in ()).throw(PermissionError(p)))
    rows = [r for part in reader.partitions() for r in reader.read(part)]
    assert {r[5] for r in rows} == {"error"}
    files = spark.createDataFrame(rows, "path string, ext string, size_bytes long, is_symlink boolean, sha256 string, status string")
    assert inventory.scan_counters(files).first().asDict() == {"file_count": 0, "total_bytes": 0, "skipped_count": 102, "skipped_oversized": 0, "skipped_symlinks": 0}


def test_roots_and_limits(spark, tmp_path):
    (tmp_path / "f").write_text("x")
    with pytest.raises(FileNotFoundError):
        scan(root=tmp_path / "none", spark=spark)
    with pytest.raises(NotADirectoryError):
        scan(root=tmp_path / "f", spark=spark)
    with pytest.raises(ValueError):
        scan(root=tmp_path, max_file_size=-1, spark=spark)
    (tmp_path / "f").unlink()
    assert scan(root=tmp_path, spark=spark).to_json()["duplicates"] == []
    assert ScanMetadata("1", "/", "t", ("a",), 0).to_json() == {"tool_version": "1", "scanned_root": "/", "timestamp": "t", "extensions_filter": ["a"], "max_file_size": 0}


def test_progress_bar():
    out = io.StringIO()
    progress_bar(0, 0, stream=out)
    progress_bar(1, 4, stream=out)
    progress_bar(4, 4, stream=out)
    assert out.getvalue() == "\r[#######-----------------------] 25% (1/4)\r[##############################] 100% (4/4)\n"


def test_status_precedence(spark):
    rows = [("a", "jpg", 9, True, "h"), ("b", "jpg", 9, False, "h"), ("c", "txt", 9, False, "h"), ("d", "txt", 1, False, None), ("e", "txt", 5, False, "h")]
    files = spark.createDataFrame(rows, "path string, ext string, size_bytes long, is_symlink boolean, sha256 string")
    got = inventory.with_status(files, extensions=["txt"], max_file_size=5, follow_symlinks=False).orderBy("path").collect()
    assert [r.status for r in got] == ["symlink", "extension", "oversized", "error", "ok"]
    assert {r.status for r in inventory.with_status(files).collect()} == {"ok", "error"}


def test_reports_as_tables_equal_those_of_dictionaries(spark):
    old = {"file_count": 9, "total_bytes": 100, "duplicates": [["a", "b"], ["y", "x", "z"]]}
    new = {"file_count": 7, "total_bytes": 0, "duplicates": [["x", "y", "z"], ["c", "d"], ["e", "f"]]}
    groups = lambda d: spark.createDataFrame([(g, len(g)) for g in d["duplicates"]], "members array<string>, size long")
    counters = lambda d: spark.createDataFrame([(d["file_count"], d["total_bytes"])], "file_count long, total_bytes long")
    for d in (old, new):
        assert reports.report(counters(d), groups(d)).first().asDict() == vars(reports.generate_report(d))
    want = reports.diff_scans(old, new)
    got = {}
    for r in reports.diff_groups(groups(old), groups(new)).orderBy("group_key").collect():
        got.setdefault(r.status, []).append(r.members)
    assert got == {"added": want.added_duplicate_groups, "removed": want.removed_duplicate_groups, "unchanged": [["y", "x", "z"]]} and want.unchanged_duplicate_groups == [["y", "x", "z"]]
    assert reports.diff_counts(counters(old), counters(new)).first().asDict() == {"added_files": want.added_files, "removed_files": want.removed_files} == {"added_files": -2, "removed_files": 2}
    none = reports.generate_report({"file_count": 0, "total_bytes": 0, "duplicates": []})
    assert (none.avg_file_size, none.largest_group_size) == (0.0, 0)
    assert reports.report(counters({"file_count": 0, "total_bytes": 0}), groups({"duplicates": []})).first().asDict() == vars(none)
    with pytest.raises(KeyError):
        reports.generate_report({})


def test_module_runs():
    out = subprocess.run([sys.executable, "-m", "sievelake", "--version"], capture_output=True, text=True, cwd=os.path.dirname(os.path.dirname(__file__)))
    assert out.returncode == 0 and out.stdout.startswith("sievelake ")


def test_results_by_position():
    assert ScanResult(3, 9, [["a", "b"]], 1, 2, 4).to_json() == {"file_count": 3, "total_bytes": 9, "duplicates": [["a", "b"]], "skipped_count": 1, "skipped_oversized": 2, "skipped_symlinks": 4}
    assert ReportSummary(1, 2, 3, 4, 5, 6.0, 7).largest_group_size == 7 and DiffResult(1, 2, [["a"]], [], []).added_duplicate_groups == [["a"]]
    with pytest.raises(TypeError):
        ScanResult(1, 2)


def test_names_that_are_not_utf8(spark, tmp_path):
    for name in (b"\xff.txt", b"ok.txt", b"dir\xfe"):
        if name.startswith(b"dir"):
            os.mkdir(os.path.join(os.fsencode(tmp_path), name))
            name += b"/in.t\xfc"
        with open(os.path.join(os.fsencode(tmp_path), name), "wb") as file:
            file.write(b"same")
    found = scan(root=tmp_path, spark=spark)
    assert (found.file_count, found.skipped_count) == (3, 0) and len(found.duplicates[0]) == 3
    json.dumps(found.to_json()).encode()


def test_progress_is_drawn_while_the_scan_runs(spark, tmp_path, capsys):
    for i in range(40):
        (tmp_path / f"f{i}").write_text(str(i))
    assert scan(root=tmp_path, spark=spark, progress=True).file_count == 40
    shown = capsys.readouterr().err
    assert "(0/40)" in shown and shown.rstrip(" ").endswith("100% (40/40)\n")


def test_skips_are_logged(spark, tmp_path, caplog, monkeypatch):
    monkeypatch.setattr(logging.getLogger("sievelake"), "propagate", True)
    (tmp_path / "small").write_text("a")
    (tmp_path / "large").write_text("a" * 50)
    os.symlink(tmp_path / "small", tmp_path / "link")
    with caplog.at_level(logging.DEBUG, logger="sievelake"):
        scan(root=tmp_path, spark=spark, max_file_size=10, follow_symlinks=False)
    text = caplog.text
    assert "large (50 bytes) is above the size limit" in text and "link is a link" in text and "1 files above the size limit were skipped" in text and "1 links were skipped" in text


def test_a_listing_that_is_refused(spark, tmp_path, monkeypatch, caplog):
    def refused(*_, **__):
        raise PySparkException("worker: PermissionError: [Errno 13] Permission denied")

    monkeypatch.setattr(logging.getLogger("sievelake"), "propagate", True)
    monkeypatch.setattr(scanning, "read_tree", refused)
    with pytest.raises(PermissionError):
        scan(root=tmp_path, spark=spark)
    assert "can't be listed" in caplog.text
