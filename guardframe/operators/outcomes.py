"""How requests, licences and bundles end: statuses, error types, reasons, readiness."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What ends a request, its HTTP status, and the error's type on the chat path
#: and on the responses path (with a code where that path gives one).
OUTCOMES = (
    ("invalid_body", 400, "invalid_request_error", "invalid_request_error", None),
    ("unauthorized", 401, "authentication_error", "authentication_error", None),
    ("policy", 403, "policy_error", "policy_violation", "policy_blocked"),
    ("body_too_large", 413, "invalid_request_error", "invalid_request_error", None),
    ("in_flight", 429, "rate_limit_exceeded", "rate_limit_exceeded", None),
    ("no_provider", 500, "configuration_error", "configuration_error", None),
    ("provider", 502, "provider_error", "provider_error", None),
)
#: What errors of the network say.
NETWORK_WORDS = ("timeout", "deadline", "temporary", "connection reset", "connection refused", "dial tcp", "tls handshake", "503", "502")
INVALID_WORDS = ("invalid", "unknown", "unauthorized")


def http_error(outcome: Column, path: Column, vendor: str = "acme") -> Column:
    """(status, type, code) of how a request ended; null if it succeeded. On the responses path
    the type of a policy violation begins with the vendor's name."""
    out = None
    for name, status, chat, responses, code in OUTCOMES:
        on_responses = f"{vendor}_{responses}" if code else responses
        error = F.struct(F.lit(status).alias("status"), F.when(path == "responses", on_responses).otherwise(chat).alias("type"), F.when(path == "responses", F.lit(code).cast("string")).alias("code"))
        out = F.when(outcome == name, error) if out is None else out.when(outcome == name, error)
    return out


def _says(text: Column, words: tuple[str, ...]) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    found = F.lit(False)
    for word in words:
        found = found | low.contains(word)
    return found


def network_like(error: Column) -> Column:
    """Whether an error's text is that of a failing network; null is no error."""
    return _says(error, NETWORK_WORDS)


def fallback_reason(error: Column) -> Column:
    """Why an online validation gave no answer, from its error's text."""
    return F.when(error.isNull(), "validate_failed_network").when(_says(error, INVALID_WORDS), "invalid_license").when(network_like(error), "validate_failed_network").otherwise("validate_failed")


def placeholder_key(key: Column, samples: tuple[str, ...] = ("ACME-FREE-XXXX", "ACME-FREE-XXXX-PLACEHOLDER", "YOUR_LICENSE_KEY")) -> Column:
    """Whether a licence key is blank or one of the samples, in any case."""
    own = F.upper(F.trim(F.coalesce(key, F.lit(""))))
    return (own == "") | own.isin([s.upper() for s in samples])


def bundle_family(family: Column, default: str = "guard_v1") -> Column:
    """A bundle family without outer slashes; the default if it is blank."""
    own = F.trim(F.coalesce(family, F.lit("")))
    return F.when(own == "", default).otherwise(F.trim(own, F.lit("/")))


def bundle_family_variants(family: Column, default: str = "guard_v1") -> Column:
    """The names under which a family may be listed."""
    own = bundle_family(family, default)
    return F.array_distinct(F.filter(F.array(own, F.concat(own, F.lit("/")), F.concat(own, F.lit("//"))), lambda v: v != ""))


def readiness(config_loaded: bool, providers: int, projects: int, require_ml: bool, has_model: bool, has_specialists: bool) -> dict[str, str]:
    """status, mode, and the first reason for not being ready. Only the model that scores all
    labels gives mode ml; specialists alone are enough where a model is required."""
    faults = (
        (not config_loaded, "config_not_loaded"),
        (not providers, "no_providers_configured"),
        (not projects, "no_projects_configured"),
        (require_ml and not has_model and not has_specialists, "ml_inactive"),
    )
    reason = next((r for bad, r in faults if bad), "")
    return {"status": "not_ready" if reason else "ready", "mode": "ml" if has_model else "regex_only", "reason": reason}


def setting(yaml: int, env: str | None, default: int) -> tuple[int, str]:
    """A runtime setting above zero and where it comes from: the file, else the environment, else the default."""
    if yaml > 0:
        return yaml, "yaml"
    try:
        found = int((env or "").strip())
    except ValueError:
        found = 0
    return (found, "env") if found > 0 else (default, "default")


#: Where a provider is reached if its configuration doesn't say.
BASE_URLS = {"openai": "https://api.openai.com/v1", "mock": "http://127.0.0.1:18080"}


def provider_key(env_name: str, key: str, environment: Mapping[str, str]) -> str:
    """A provider's key: from the environment, else from the file."""
    return environment.get(env_name, "").strip() or key.strip()


def provider_url(kind: str, url: str) -> str:
    return url.strip() or BASE_URLS.get(kind.strip().lower(), "")


def noop_scan() -> dict[str, Column]:
    """The engine that finds nothing: no category is hit."""
    return {}
