"""Rules of the secret scan: a name, a version, and what finds a text's spans."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    """``find`` gives spans ``(start, end)`` in code points.  A new version makes every blob unseen by this rule."""

    name: str
    version: int
    find: Callable[[str], list[tuple[int, int]]]


_ASSIGN = re.compile(r"""(?:(?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")   # a run of at least 32, whole, since it starts where the run starts


def assigned(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]


def access_keys(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]


def hex_runs(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _HEX.finditer(text)]


def spans(pattern: str, mark: str) -> Callable[[str], list[tuple[int, int]]]:
    """Matches of a pattern that all hold ``mark``."""
    compiled = re.compile(pattern)

    def find(text: str) -> list[tuple[int, int]]:
        return [m.span() for m in compiled.finditer(text)] if mark in text else []
    return find


_WORD = "(?<![A-Za-z0-9_-])"
BASE = (Rule("assign", 1, assigned), Rule("access", 1, access_keys), Rule("hex", 1, hex_runs))
#: Further credentials of public formats.  Each pattern starts at a fixed mark or where a word starts, so long texts cost their length.
ADDED = (
    Rule("private_key", 1, spans(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END (?:[A-Z]+ )*PRIVATE KEY-----)?", "-----BEGIN ")),
    Rule("jwt", 1, spans(_WORD + r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "eyJ")),
    Rule("code_host", 1, spans(_WORD + r"gh[opsur]_[A-Za-z0-9]{36,}", "gh")),
    Rule("chat", 1, spans(_WORD + r"xox[abeoprs]-[A-Za-z0-9-]{10,}", "xox")),
    Rule("maps", 1, spans(_WORD + r"AIza[A-Za-z0-9_-]{35}(?![A-Za-z0-9_-])", "AIza")),
    Rule("payment", 1, spans(_WORD + r"[sr]k_(?:live|test)_[A-Za-z0-9]{16,}", "k_")),
    Rule("url_login", 1, spans(r"(?<=://)[^\s:/@]{1,128}:[^\s:/@]{1,128}(?=@)", "://")),
)
RULES = BASE + ADDED
