"""Configuration tiers, permissions and the commands described as tools."""

from __future__ import annotations

from argparse import ArgumentParser
from collections.abc import Mapping
from dataclasses import dataclass, field, fields
from enum import StrEnum, auto
from typing import Any

from sievelake.version import __version__


Settings = Mapping[str, Any] | None


class PermissionScope(StrEnum):
    """From the smallest to the largest."""

    READ_ONLY = auto()
    WORKSPACE_WRITE = auto()
    FULL_ACCESS = auto()


class ApprovalPolicy(StrEnum):
    AUTO = auto()
    REQUIRE_APPROVAL = auto()
    DENY = auto()


@dataclass
class AuthorityBoundary:
    scope: PermissionScope
    approval: ApprovalPolicy
    sandbox: dict[str, Any] | None = None

    def scope_allows(self, required: PermissionScope) -> bool:
        """A larger scope includes the smaller."""
        ladder = list(PermissionScope)
        return ladder.index(required) <= ladder.index(self.scope)

    def needs_approval(self) -> bool:
        return ApprovalPolicy.REQUIRE_APPROVAL is self.approval

    def is_denied(self) -> bool:
        return ApprovalPolicy.DENY is self.approval


@dataclass
class ToolSpec:
    name: str
    description: str
    category: str
    version: str
    owner: str
    permission_scope: PermissionScope
    input_schema: dict[str, Any] | None = None
    output_schema: dict[str, Any] | None = None
    sandbox_requirement: dict[str, Any] | None = None
    aliases: list[str] | None = None


@dataclass
class CommandSpec:
    command: str
    spec: ToolSpec
    boundary: AuthorityBoundary


@dataclass
class ToolkitConfig:
    toolkit_id: str = "SIEVELAKE"
    toolkit_name: str = "sievelake"
    version: str = __version__
    log_format: str = "json"
    structured_logging: bool = True
    output_format: str = "json"
    hash_algorithm: str = "sha256"
    follow_symlinks: bool = True
    max_file_size_mb: int = 0
    #: what has none of the names above
    extra: dict = field(default_factory=dict)


CONFIG_LEVELS = {tier: level for level, tier in enumerate(("platform_default", "toolkit_config", "cli_override"))}


def build_config_hierarchy(toolkit_config: Settings = None, cli_overrides: Settings = None) -> ToolkitConfig:
    """Defaults, below the toolkit's configuration, below the command line's; unknown names go to ``extra``."""
    config, known = ToolkitConfig(), {f.name for f in fields(ToolkitConfig)}
    for tier in (toolkit_config, cli_overrides):
        for name, value in (tier or {}).items():
            if name == "extra":
                config.extra = dict(value)
            elif name in known:
                setattr(config, name, value)
            else:
                config.extra[name] = value
    return config


def _schema(parser: ArgumentParser) -> dict[str, Any]:
    kinds = {int: "integer", bool: "boolean"}
    options = [a for a in parser._actions if a.dest != "help"]
    typed = {a.dest: {"type": "boolean" if a.nargs == 0 else kinds.get(a.type, "string"), "description": a.help or ""} for a in options}
    return {"type": "object", "properties": typed, "required": [a.dest for a in options if a.required]}


def tool_specs() -> dict[str, CommandSpec]:
    """The commands, with input schemas taken from the parsers of the command line itself."""
    from sievelake.cli import command_parsers

    boundary = AuthorityBoundary(PermissionScope.READ_ONLY, ApprovalPolicy.AUTO)
    return {
        name: CommandSpec(name, ToolSpec(name, parser.description or "", "tool", __version__, "sievelake", PermissionScope.READ_ONLY, _schema(parser)), boundary)
        for name, parser in command_parsers().items()
    }


def get_tool_spec(name: str) -> CommandSpec | None:
    return tool_specs().get(name)
