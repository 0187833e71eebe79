"""The command line: scan, report, diff, verify."""

from __future__ import annotations

import logging
import sys
from argparse import ArgumentParser, Namespace, _SubParsersAction
from json import JSONDecodeError, dumps, loads
from pathlib import Path

from sievelake.operators.reports import diff_scans, generate_report
from sievelake.scanning import checked_root, scan
from sievelake.signing import canonical_json_bytes, sign_payload, verify_payload
from sievelake.sources.scan_json import load_scan_file, save_json, to_text
from sievelake.version import __version__

OK, CLI_ERROR, UNEXPECTED = 0, 2, 3
log = logging.getLogger("sievelake")


class JsonLines(logging.Formatter):
    default_time_format = "%Y-%m-%dT%X"

    def format(self, record) -> str:
        values = (self.formatTime(record), record.levelname, record.name, record.getMessage())
        line = dict(zip(("timestamp", "level", "logger", "message"), values))
        trace = record.exc_info
        if trace and trace[0]:
            line |= {"exception": self.formatException(trace)}
        return dumps(line, ensure_ascii=False)


class _Refused(Exception):
    """Ends a command with CLI_ERROR."""


def parse_extensions(listed: str) -> set[str] | None:
    """``".TXT, jpg"`` to {txt, jpg}; nothing means no filter, only commas mean that nothing passes."""
    if not listed:
        return None
    return {part.strip().lstrip(".").lower() for part in listed.split(",")} - {""}


def _root(path: str) -> Path:
    try:
        return checked_root(path)
    except NotADirectoryError as error:
        raise _Refused(error) from error


def _existing(path: str, what: str) -> Path:
    found = Path(path).resolve()
    if not found.exists():
        raise _Refused(f"the {what} {found} doesn't exist")
    return found


def _loaded(path: Path) -> dict:
    try:
        return load_scan_file(path)
    except (KeyError, JSONDecodeError) as error:
        raise _Refused(f"{path} can't be used: {error}") from error


def _deliver(data: dict, out: str) -> int:
    if not out:
        print(to_text(data))
        return OK
    try:
        log.info("wrote %s", save_json(data, out))
    except OSError as error:
        raise _Refused(f"{out} can't be written: {error}") from error
    return OK


def run_scan(args: Namespace) -> int:
    result = scan(spark=None, root=_root(args.root), extensions=parse_extensions(args.extensions), max_file_size=args.max_file_size, follow_symlinks=args.follow_symlinks, progress=args.progress)
    data = result.to_json()
    if args.sign:
        key = _existing(args.sign_key, "signing key")
        try:
            data["signature"] = sign_payload(payload=canonical_json_bytes(data), private_key_pem=key.read_text(encoding="utf-8"))
        except Exception as error:
            raise _Refused(f"the scan can't be signed: {error}") from error
    return _deliver(data, args.out)


def run_report(args: Namespace) -> int:
    return _deliver(generate_report(_loaded(_existing(args.input, "scan file"))).to_json(), args.out)


def run_diff(args: Namespace) -> int:
    old, new = _existing(args.old, "old scan file"), _existing(args.new, "new scan file")
    return _deliver(diff_scans(_loaded(old), _loaded(new)).to_json(), args.out)


def run_verify(args: Namespace) -> int:
    path, key = _existing(args.input, "scan file"), _existing(args.public_key, "public key")
    try:
        data = loads(path.read_bytes().decode())
        signature = data.pop("signature", None)
        if signature is None:
            raise _Refused(f"{path} has no signature")
        fits = verify_payload(payload=canonical_json_bytes(data), signature_b64=signature, public_key_pem=key.read_text(encoding="utf-8"))
    except _Refused:
        raise
    except Exception as error:
        raise _Refused(f"the signature can't be checked: {error}") from error
    print("Signature is VALID" if fits else "Signature is INVALID")
    return OK if fits else CLI_ERROR


#: For each command: what it does, and its options as (name, help, settings).
COMMANDS = {
    "scan": (run_scan, "Find duplicate files in a folder.", [
        ("root", "the folder", {"required": True}),
        ("out", "where to write the result, if not to stdout", {"default": ""}),
        ("extensions", "comma-separated extensions to scan, if not all", {"default": ""}),
        ("max-file-size", "bytes; larger files are skipped", {"type": int}),
        ("follow-symlinks", "scan linked files, as is done anyway", {"action": "store_true", "default": True}),
        ("skip-symlinks", "skip linked files", {"action": "store_false", "dest": "follow_symlinks"}),
        ("progress", "show a progress bar", {"action": "store_true"}),
        ("sign", "sign the result", {"action": "store_true"}),
        ("sign-key", "the Ed25519 private key, as PEM, to sign with", {"default": ""}),
    ]),
    "report": (run_report, "Summarise a scan file.", [
        ("input", "the scan file", {"required": True}),
        ("out", "where to write the report, if not to stdout", {"default": ""}),
    ]),
    "diff": (run_diff, "Compare two scan files.", [
        ("old", "the earlier scan file", {"required": True}),
        ("new", "the later scan file", {"required": True}),
        ("out", "where to write the difference, if not to stdout", {"default": ""}),
    ]),
    "verify": (run_verify, "Check the signature of a scan file.", [
        ("input", "the signed scan file", {"required": True}),
        ("public-key", "the Ed25519 public key, as PEM", {"required": True}),
    ]),
}


def build_parser() -> ArgumentParser:
    parser = ArgumentParser(prog="sievelake", description="Duplicates and near duplicates in large datasets.")
    parser.add_argument("--version", version="sievelake " + __version__, action="version")
    parser.add_argument("-v", "--verbose", action="store_true", help="log all there is")
    parser.add_argument("--log-format", choices=("text", "json"), default="text", help="lines of text, or of JSON")
    commands = parser.add_subparsers(dest="cmd", required=True)
    for command, (run, does, options) in COMMANDS.items():
        sub = commands.add_parser(command, help=does, description=does)
        sub.set_defaults(run=run)
        for option, says, settings in options:
            sub.add_argument("--" + option, help=says, **settings)
    return parser


def command_parsers() -> dict[str, ArgumentParser]:
    subs = next(a for a in build_parser()._actions if isinstance(a, _SubParsersAction))
    return dict(subs.choices)


def _set_up_logging(as_json: bool, verbose: bool) -> None:
    lines = JsonLines() if as_json else logging.Formatter("{asctime} {levelname}: {message}", style="{")
    to_stderr = logging.StreamHandler()
    to_stderr.setFormatter(lines)
    log.handlers = [to_stderr]
    log.propagate = False
    log.setLevel(logging.DEBUG if verbose else logging.WARNING)


def main(arguments=None) -> int:
    args = build_parser().parse_args(arguments)
    _set_up_logging(args.log_format == "json", args.verbose)
    if getattr(args, "sign", False) and not args.sign_key:
        log.error("--sign needs --sign-key")
        return CLI_ERROR
    try:
        return args.run(args)
    except (_Refused, ValueError, FileNotFoundError, PermissionError) as error:
        log.error("%s", error)
        return CLI_ERROR
    except KeyboardInterrupt:
        log.warning("interrupted")
        return UNEXPECTED
    except Exception:
        log.exception("unexpected error")
        print("Something unexpected went wrong; the log says what.", file=sys.stderr)
        return UNEXPECTED
