"""Configuration: frozen sections with the reference defaults, and the layers above them."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass, replace
from pathlib import Path
from typing import Any

from guardframe.operators.detect import Entities

ACTIONS = ("block", "log", "ignore", "redact")


def parse_action(value: str | None, default: str) -> str:
    """An action's name trimmed and in small letters; anything unknown is the default."""
    found = (value or "").strip().lower()
    return found if found in ACTIONS else default


@dataclass(frozen=True)
class Category:
    """Thresholds and actions of a threat category; an empty action is unset."""

    warn: float = 0.60
    block: float = 0.80
    regex_enabled: bool = True
    ml_enabled: bool = True
    on_regex: str = ""
    on_block: str = "block"
    on_ml: str = "log"


@dataclass(frozen=True)
class Security:
    """The merge of signals into decisions."""

    enabled: bool = True
    prompt_injection: Category = Category()
    jailbreak: Category = Category()
    data_exfil: Category = Category(warn=0.55, block=0.75)
    pii: Category = Category(warn=0.50, block=0.0, on_regex="redact")
    secrets: Category = Category(warn=0.50, block=0.85, on_regex="block_and_redact")


@dataclass(frozen=True)
class Legacy:
    """Actions of the regex-only path."""

    banned_words: str = "block"
    injection: str = "block"
    pii: str = "block"
    prompt_injection: str = "block"
    jailbreak: str = "block"
    toxicity: str = "log"
    words: tuple[str, ...] = ()
    entities: Entities = Entities()


@dataclass(frozen=True)
class ToolGate:
    enabled: bool = True
    mode: str = "elevated_only"
    hosts: tuple[str, ...] = ()
    commands: tuple[str, ...] = ()


@dataclass(frozen=True)
class Guard:
    """Response guard: a mode and overrides by instruction category."""

    enabled: bool = True
    mode: str = "warn"
    overrides: dict[str, str] = field(default_factory=dict)

    def action(self, category: str) -> str:
        chosen = (self.overrides.get(category) or "").strip() or self.mode
        return "ignore" if chosen.strip().lower() == "ignore" else "warn"


@dataclass(frozen=True)
class Limits:
    messages: int = 64
    message_bytes: int = 32_000
    body_bytes: int = 2 << 20
    response_bytes: int = 4 << 20
    in_flight: int = 200


@dataclass(frozen=True)
class Provider:
    type: str = ""
    base_url: str = ""
    api_key: str = ""
    api_key_env: str = ""
    allow_private_networks: bool = False


@dataclass(frozen=True)
class Project:
    id: str = ""
    provider: str = ""
    api_keys: tuple[str, ...] = ()


@dataclass(frozen=True)
class SinkConfig:
    type: str = ""
    path: str = ""
    url: str = ""


@dataclass(frozen=True)
class Telemetry:
    enabled: bool = False
    endpoint: str = ""
    protocol: str = ""


@dataclass(frozen=True)
class Config:
    addr: str = ":8080"
    providers: dict[str, Provider] = field(default_factory=lambda: {"echo": Provider(type="echo")})
    projects: tuple[Project, ...] = (Project("default", "echo", ("local-dev-key",)),)
    sinks: tuple[SinkConfig, ...] = ()
    telemetry: Telemetry = Telemetry()
    security: Security = Security()
    legacy: Legacy = Legacy()
    tool_gate: ToolGate = ToolGate()
    guard: Guard = Guard()
    limits: Limits = Limits()
    default_provider: str = "echo"
    preview_level: str = "redacted"


#: Settings that hold sections of a kind, by name or in a list.
_KINDS = {"providers": Provider, "projects": Project, "sinks": SinkConfig}


def _layered(section: Any, values: dict) -> Any:
    """A section with given values on top; sections below it keep what isn't given."""
    known = {f.name: getattr(section, f.name) for f in fields(section)}
    out = {}
    for name, value in values.items():
        if name not in known:
            raise ValueError(f"unknown setting {name!r} in {type(section).__name__}")
        if name in _KINDS and isinstance(value, dict):
            out[name] = {k: _layered(_KINDS[name](), v or {}) for k, v in value.items()}
        elif name in _KINDS:
            out[name] = tuple(_layered(_KINDS[name](), v or {}) for v in value or ())
        elif is_dataclass(known[name]):
            out[name] = _layered(known[name], value or {})
        else:
            out[name] = tuple(value) if isinstance(known[name], tuple) else value
    return replace(section, **out)


def _parsed(text: str) -> dict:
    try:
        import yaml
    except ImportError:
        import json

        return json.loads(text or "{}")
    return yaml.safe_load(text) or {}


#: What holds where there is no file at all: no kind of personal data is looked for.
NO_ENTITIES = Entities(email=False, phone=False, credit_card=False, iban=False, tokens=False)


def load(path: str | None = None, text: str | None = None) -> Config:
    """Defaults, then the YAML (or JSON) file.

    Personal-data toggles that are all off in a file are all on again, so a file
    can't switch every kind off; a missing file gives the bare defaults, in which
    they are off.
    """
    if text is None:
        if path is None or not Path(path).exists():
            return replace(Config(), legacy=replace(Legacy(), entities=NO_ENTITIES))
        text = Path(path).read_text()
    config = _layered(Config(), _parsed(text))
    if not any(vars(config.legacy.entities).values()):
        config = replace(config, legacy=replace(config.legacy, entities=Entities()))
    return config


@dataclass(frozen=True)
class Specialist:
    """A single-purpose model: its kind (sequence or token classification), files and length."""

    kind: str = ""
    onnx: str = ""
    tokenizer_dir: str = ""
    max_tokens: int = 0


def specialists(path: str | None = None, text: str | None = None) -> dict[str, Specialist]:
    """The models that a YAML file lists under ``specialists``. The file must exist."""
    if text is None:
        if not (path or "").strip():
            raise ValueError("the path of the specialists' file is empty")
        text = Path(path).read_text()
    return {name: _layered(Specialist(), values or {}) for name, values in (_parsed(text).get("specialists") or {}).items()}


def _host(url: str) -> tuple[str, str]:
    """Scheme and authority of a URL, empty where it has none."""
    from urllib.parse import urlsplit

    try:
        parts = urlsplit(url.strip())
    except ValueError:
        return "", ""
    return parts.scheme, parts.netloc


def private_address(authority: str) -> bool:
    """Whether a host, with or without a port, is local or an address in a private range."""
    from ipaddress import ip_address, ip_network

    host = authority.strip().lower().rpartition("@")[2]
    if host.startswith("["):
        host = host[1:].partition("]")[0]
    elif host.count(":") == 1:
        host = host.partition(":")[0]
    if host == "localhost":
        return True
    try:
        found = ip_address(host)
    except ValueError:
        return False
    found = getattr(found, "ipv4_mapped", None) or found
    return any(found.version == net.version and found in net for net in map(ip_network, PRIVATE_NETWORKS))


#: Networks that providers may not be in.
PRIVATE_NETWORKS = ("127.0.0.0/8", "10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "169.254.0.0/16", "::1/128", "fc00::/7", "fe80::/10")


def _provider_problems(name: str, p: Provider) -> list[str]:
    if not p.type.strip():
        return [f"provider {name!r} has no type"]
    out = []
    if p.type.lower() == "openai" and not p.api_key_env.strip() and not p.api_key.strip():
        out.append(f"provider {name!r} has no api key")
    if p.base_url:
        scheme, host = _host(p.base_url)
        if not scheme or not host:
            out.append(f"provider {name!r} has an invalid base_url")
        elif scheme not in ("http", "https"):
            out.append(f"provider {name!r} base_url must be http or https")
        elif not p.allow_private_networks and private_address(host):
            out.append(f"provider {name!r} base_url is in a private network")
    return out


def _sink_problems(i: int, sink: SinkConfig) -> list[str]:
    kind = sink.type.strip().lower()
    if kind == "file_jsonl":
        return [] if sink.path.strip() else [f"sink {i} (file_jsonl) has no path"]
    if kind != "webhook":
        return [f"sink {i} has unknown type {sink.type!r}"]
    if not sink.url.strip():
        return [f"sink {i} (webhook) has no url"]
    scheme, host = _host(sink.url)
    if not scheme or not host:
        return [f"sink {i} (webhook) has an invalid url"]
    return [] if scheme in ("http", "https") else [f"sink {i} (webhook) url must be http or https"]


def problems(config: Config) -> list[str]:
    """What is wrong with a configuration, in a fixed order."""
    found = [] if config.addr.strip() else ["addr must be set"]
    if not config.providers:
        found.append("at least one provider must be configured")
    if not config.default_provider.strip():
        found.append("default_provider must be set")
    elif config.default_provider not in config.providers:
        found.append(f"default_provider {config.default_provider!r} isn't a provider")
    for name, provider in config.providers.items():
        found += _provider_problems(name, provider)
    if not config.projects:
        found.append("at least one project must be configured")
    owners: dict[str, str] = {}
    for project in config.projects:
        if not project.id.strip():
            found.append("a project's id must be set")
            continue
        if (project.provider or config.default_provider) not in config.providers:
            found.append(f"project {project.id!r} names an unknown provider {project.provider!r}")
        if config.security.enabled and not project.api_keys:
            found.append(f"project {project.id!r} must have an api key")
        for key in project.api_keys:
            if owners.setdefault(key, project.id) != project.id:
                found.append(f"an api key is that of the projects {owners[key]!r} and {project.id!r}")
    for i, sink in enumerate(config.sinks):
        found += _sink_problems(i, sink)
    if config.telemetry.enabled:
        if not config.telemetry.endpoint.strip():
            found.append("telemetry is enabled but has no endpoint")
        if config.telemetry.protocol and config.telemetry.protocol.strip().lower() not in ("grpc", "http"):
            found.append("telemetry.protocol must be grpc or http")
    for name in ("prompt_injection", "jailbreak", "data_exfil", "pii", "secrets"):
        section = getattr(config.security, name)
        for level in ("warn", "block"):
            if not 0 <= getattr(section, level) <= 1:
                found.append(f"security.{name}.{level} must be between 0 and 1")
        if section.block and section.warn > section.block:
            found.append(f"security.{name}.warn must not exceed block")
    for name in ("banned_words", "injection", "pii", "prompt_injection", "jailbreak", "toxicity"):
        if getattr(config.legacy, name) not in ACTIONS:
            found.append(f"legacy.{name} must be one of {', '.join(ACTIONS)}")
    if config.tool_gate.mode.strip().lower() not in ("", "elevated_only", "all_tools"):
        found.append("tool_gate.mode must be elevated_only or all_tools")
    if config.guard.mode.strip().lower() not in ("", "warn", "ignore"):
        found.append("guard.mode must be warn or ignore")
    for category, action in config.guard.overrides.items():
        if action.strip().lower() not in ("", "warn", "ignore"):
            found.append(f"guard.overrides.{category} must be warn or ignore")
    found += [f"limits.{f.name} must be positive" for f in fields(config.limits) if getattr(config.limits, f.name) <= 0]
    if config.preview_level not in ("full", "redacted", "metadata"):
        found.append("preview_level must be full, redacted or metadata")
    return found
