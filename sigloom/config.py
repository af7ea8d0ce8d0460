"""Settings: case-insensitive keys from files and command lines, with typed access."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path

TRUE, FALSE = {"true", "1", "yes"}, {"false", "0", "no"}
#: Old names of keys, and old keys that mean nothing any more.
RENAMED = {
    "DINESHA-TERMWEIGHTS": "TERMWEIGHT-SUFFIXES", "DUPLICATES_OK": "ALLOW-DUPLICATES", "ISL_SLICEWIDTH": "ISSL-SLICEWIDTH", "ISL-PATH": "ISSL-PATH",
    "ISL_PATH": "ISSL-PATH", "ISL-MAX-DIST": "ISSL-EXPANSION", "ISL-MAX-DIST-NONEW": "ISSL-CONSIDERATION-RADIUS", "TERMSTATS-PATH-OUTPUT": "TERMSTATS-PATH",
    **dict.fromkeys(["QUERY-TOP-K", "TOPIC-OUTPUT-K", "SEARCH-DOC-RERANK", "SEARCH-DOC-K"], "K"), **dict.fromkeys(["QUERY-TOP-K-OUTPUT", "SEARCH-DOC-TOPK"], "K-OUTPUT"),
    "TOPIC-OUTPUT-PATH": "RESULTS-PATH", "OUTPUT-PROGRESS-DOCUMENTS": "TOTAL-DOCUMENTS",
    **dict.fromkeys(["SEARCH-DOC-JOBS", "SEARCH-JOBS"], "JOBS"), **dict.fromkeys(["SEARCH-DOC-THREADS", "SEARCH-THREADS", "INDEX-THREADS"], "THREADS"),
}
IGNORED = {"SEARCH-THREADING", "INDEX-THREADING"}


@dataclass(frozen=True)
class EngineConfig:
    """An immutable set of settings; a later value of a key replaces an earlier one."""

    values: Mapping[str, str] = field(default_factory=dict)

    def with_values(self, pairs: Mapping[str, str] | list[tuple[str, str]]) -> EngineConfig:
        out = dict(self.values)
        for key, value in pairs.items() if isinstance(pairs, Mapping) else pairs:
            key = RENAMED.get(key.strip().upper(), key.strip().upper())
            if key not in IGNORED:
                out[key] = str(value).strip()
        return EngineConfig(out)

    def with_file(self, path: str | Path) -> EngineConfig:
        """Lines ``key = value``; # begins a comment line; ``config = FILE`` includes another file."""
        out = self
        for line in Path(path).read_text().splitlines():
            key, mark, value = line.partition("=")
            if line.lstrip().startswith("#") or not mark:
                continue
            if key.strip().upper() == "CONFIG":
                out = out.with_file(value.strip())
            else:
                out = out.with_values([(key, value)])
        return out

    def with_arguments(self, args: list[str]) -> EngineConfig:
        """Pairs ``-key value``; a last key without a value is dropped; ``-config FILE`` includes a file."""
        out = self
        for key, value in zip(args[::2], args[1::2], strict=False):
            key = key.lstrip("-")
            out = out.with_file(value) if key.upper() == "CONFIG" else out.with_values([(key, value)])
        return out

    def get(self, key: str, default: str | None = None) -> str | None:
        return self.values.get(key.upper(), default)

    def required(self, key: str) -> str:
        value = self.get(key)
        if value is None:
            raise KeyError(f"{key} must be set")
        return value

    def boolean(self, key: str, default: bool = False) -> bool:
        value = self.get(key)
        if value is None:
            return default
        if value.lower() in TRUE:
            return True
        if value.lower() in FALSE:
            return False
        raise ValueError(f"{key}: {value!r} is neither true nor false")

    def integer(self, key: str, default: int = 0) -> int:
        """Decimal, 0x hexadecimal, or octal with a leading 0."""
        value = self.get(key)
        if value is None:
            return default
        digits = value.lstrip("+-")
        base = 16 if digits.lower().startswith("0x") else 8 if len(digits) > 1 and digits.startswith("0") else 10
        return int(value, base)
