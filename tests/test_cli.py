import json

import pytest

import sievelake
from sievelake import control, signing
from sievelake.cli import main, parse_extensions
from sievelake.sources.scan_json import load_scan_file, read_scans


@pytest.fixture
def tree(spark, tmp_path):
    root = tmp_path / "data"
    root.mkdir()
    for name, text in {"a.txt": "same", "b.txt": "same", "c.jpg": "c" * 500}.items():
        (root / name).write_text(text)
    return root


def test_scan_report_diff(tree, tmp_path, capsys):
    first, second = tmp_path / "out" / "1.json", tmp_path / "2.json"
    assert main(["scan", "--root", str(tree), "--out", str(first)]) == 0
    (tree / "d.txt").write_text("c" * 500)
    assert main(["scan", "--root", str(tree), "--out", str(second), "--extensions", ".TXT, jpg", "--max-file-size", "500", "--progress"]) == 0
    data = json.loads(second.read_text())
    assert data["duplicates"] == [["a.txt", "b.txt"], ["c.jpg", "d.txt"]] and data["metadata"]["extensions_filter"] == ["jpg", "txt"]
    capsys.readouterr()
    assert main(["report", "--input", str(second)]) == 0
    assert json.loads(capsys.readouterr().out) == {"file_count": 4, "total_bytes": 1008, "duplicate_group_count": 2, "duplicate_file_count": 4, "unique_file_count": 0, "avg_file_size": 252.0, "largest_group_size": 2}
    assert main(["diff", "--old", str(first), "--new", str(second)]) == 0
    out = json.loads(capsys.readouterr().out)
    assert (out["added_files"], out["removed_files"], out["added_duplicate_groups"]) == (1, 0, [["c.jpg", "d.txt"]])
    assert out["unchanged_duplicate_groups"] == [["a.txt", "b.txt"]]


def test_signed_scans(tree, tmp_path, capsys):
    keys = signing.generate_ed25519_keypair()
    (tmp_path / "k").write_text(keys.private_key_pem)
    (tmp_path / "p").write_text(keys.public_key_pem)
    path = tmp_path / "s.json"
    args = ["verify", "--input", str(path), "--public-key", str(tmp_path / "p")]
    assert main(["scan", "--root", str(tree), "--out", str(path), "--sign", "--sign-key", str(tmp_path / "k")]) == 0
    assert main(args) == 0 and "VALID" in capsys.readouterr().out
    data = json.loads(path.read_text())
    path.write_text(json.dumps(data | {"file_count": 99}))
    assert main(args) == 2 and "INVALID" in capsys.readouterr().out
    path.write_text(json.dumps(data | {"signature": "%%%"}))
    assert main(args) == 2
    data.pop("signature")
    path.write_text(json.dumps(data))
    assert main(args) == 2
    assert main(["scan", "--root", str(tree), "--sign"]) == 2
    assert main(["scan", "--root", str(tree), "--sign", "--sign-key", str(tmp_path / "none")]) == 2
    assert main(["scan", "--root", str(tree), "--sign", "--sign-key", str(path)]) == 2


def test_payloads(spark):
    assert signing.canonical_json_bytes({"b": 2, "a": "é"}) == '{"a":"é","b":2}'.encode()
    keys, other = signing.generate_ed25519_keypair(), signing.generate_ed25519_keypair()
    signature = signing.sign_payload(payload=b"x", private_key_pem=keys.private_key_pem)
    check = lambda payload, s, k: signing.verify_payload(payload=payload, signature_b64=s, public_key_pem=k.public_key_pem)
    assert check(b"x", signature, keys) and not check(b"y", signature, keys) and not check(b"x", signature, other) and not check(b"x", "?", keys)
    with pytest.raises(ValueError):
        signing.sign_payload(payload=b"x", private_key_pem="junk")
    with pytest.raises(ValueError):
        signing.verify_payload(payload=b"x", signature_b64=signature, public_key_pem=keys.private_key_pem)


@pytest.mark.parametrize("args,code", [(["scan", "--root", "{}/none"], 2), (["scan", "--root", "{}/data/a.txt"], 2), (["scan", "--root", "{}/data", "--out", "/proc/x/y"], 2), (["scan", "--root", "{}/data", "--max-file-size", "-1"], 2),
    (["report", "--input", "{}/none"], 2), (["report", "--input", "{}/bad"], 2), (["report", "--input", "{}/part"], 2), (["report", "--input", "{}/odd"], 3), (["report", "--input", "{}/latin"], 2), (["diff", "--old", "{}/part", "--new", "{}/none"], 2),
    (["verify", "--input", "{}/part", "--public-key", "{}/none"], 2), (["--log-format", "json", "-v", "report", "--input", "{}/none"], 2)])
def test_exit_codes(tree, tmp_path, args, code):
    (tmp_path / "bad").write_text("{")
    (tmp_path / "part").write_text('{"file_count": 1}')
    (tmp_path / "odd").write_text('{"file_count": 1, "total_bytes": 1, "duplicates": 5}')
    (tmp_path / "latin").write_bytes(b"\xff\xfe{")
    assert main([a.format(tmp_path) for a in args]) == code


def test_bad_usage():
    for args in ([], ["none"], ["scan"], ["--log-format", "xml", "scan", "--root", "."]):
        with pytest.raises(SystemExit) as stop:
            main(args)
        assert stop.value.code == 2


def test_extension_lists():
    assert [parse_extensions(x) for x in ("", "txt", " .TXT ,jpg,", ",", "..a")] == [None, {"txt"}, {"txt", "jpg"}, set(), {"a"}]


def test_scan_files(spark, tmp_path):
    path = tmp_path / "s.json"
    path.write_text('{\n"file_count": 2, "total_bytes": 3, "duplicates": [["a", "b"]], "other": 1}')
    assert load_scan_file(path)["other"] == 1
    row = read_scans(spark, path).first()
    assert (row.file_count, row.duplicates, row.skipped_count) == (2, [["a", "b"]], None)
    path.write_text('{"file_count": 2}')
    with pytest.raises(KeyError):
        read_scans(spark, path)


def test_config_tiers():
    plain = control.build_config_hierarchy()
    assert (plain.log_format, plain.hash_algorithm, plain.max_file_size_mb, plain.extra) == ("json", "sha256", 0, {})
    mixed = control.build_config_hierarchy({"log_format": "text", "own": 1, "max_file_size_mb": 5}, {"max_file_size_mb": None, "own": 2, "more": 3})
    assert (mixed.log_format, mixed.max_file_size_mb, mixed.extra) == ("text", None, {"own": 2, "more": 3})
    given = {"a": 1}
    assert control.build_config_hierarchy({"extra": given, "b": 2}).extra == {"a": 1, "b": 2} and given == {"a": 1}


def test_permissions_and_tools():
    scope, policy = control.PermissionScope, control.ApprovalPolicy
    bound = control.AuthorityBoundary(scope.WORKSPACE_WRITE, policy.REQUIRE_APPROVAL)
    assert bound.scope_allows(scope.READ_ONLY) and bound.scope_allows(scope.WORKSPACE_WRITE) and not bound.scope_allows(scope.FULL_ACCESS)
    assert bound.needs_approval() and not bound.is_denied() and control.AuthorityBoundary(scope.READ_ONLY, policy.DENY).is_denied()
    specs = control.tool_specs()
    assert specs.keys() == {"scan", "report", "diff", "verify"} and control.get_tool_spec("none") is None
    scan = control.get_tool_spec("scan").spec
    assert scan.input_schema["required"] == ["root"] and scan.input_schema["properties"]["max_file_size"]["type"] == "integer" and scan.permission_scope is scope.READ_ONLY
    assert sievelake.__version__ == scan.version
