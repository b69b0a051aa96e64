"""Model strings and settings."""

from __future__ import annotations


def parse_model(text: str) -> tuple[str, dict[str, bool | int | str]]:
    """``name@key=value@...``: true, false and digits are typed, parts without ``=`` are ignored."""
    name, *parts = text.split("@")
    out: dict[str, bool | int | str] = {}
    for part in parts:
        key, found, value = part.partition("=")
        if found:
            low = value.lower()
            out[key] = low == "true" if low in ("true", "false") else int(value) if value.isdigit() else value
    return name, out


def cache_key(query: str) -> tuple[str, str]:
    """Type and key under which a query's expansion is cached; case and outer blanks do not matter."""
    import hashlib

    return "expansion", hashlib.md5(query.strip().lower().encode(), usedforsecurity=False).hexdigest()


def smart_routing(mode: str | None) -> bool:
    """Whether PDF pages are routed by their detection; unset means yes."""
    return (mode if mode is not None else "smart").strip().lower() not in ("vlm_only", "vlm", "disabled", "off", "false", "0")


def least_confidence(value: str | None) -> float:
    """The minimum confidence of a local extraction, 0.90 if unset."""
    raw = (value if value is not None else "0.90").strip()
    try:
        out = float(raw)
    except ValueError as e:
        raise ValueError(f"the minimum confidence must be a number, got {raw!r}") from e
    if not 0 <= out <= 1:
        raise ValueError("the minimum confidence must be between 0.0 and 1.0")
    return out


def batch_size(setting: str | None, argument: int = 8) -> int:
    """Texts a call of an embedding provider: the setting wins over the argument, at least 1."""
    return max(1, int(setting.strip()) if setting else argument)
