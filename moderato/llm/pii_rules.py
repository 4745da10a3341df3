"""The base patterns of personal data and the checks of found spans."""

from __future__ import annotations

import re

KINDS = ("email", "ip", "card", "phone")
#: Every span of every kind holds one of these; a text without them has none.
ANCHOR = re.compile("[0-9@]")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match of whole numbers can only start where a run of digits starts.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the e-mail pattern, found from each ``@``, so long
    runs of letters cost no more than their length."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            end = m.end()
        else:
            end = max(end, at + 1)
        at = text.find("@", max(end, at + 1))
    return out


def is_ip(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))


def is_card(s: str) -> bool:
    d = digits(s)
    return 12 <= len(d) <= 19 and luhn(d)


def is_phone(s: str) -> bool:
    return 9 <= len(digits(s)) <= 15


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """``kind, start, end`` of all base matches, by start, then kind as listed."""
    if not ANCHOR.search(text):
        return []
    out = [("email", a, b) for a, b in emails(text)]
    for kind, pattern, holds in (("ip", _IP, is_ip), ("card", _CARD, is_card), ("phone", _PHONE, is_phone)):
        out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if holds(m[0])]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


_SHAPE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+ ?@ ?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]{1,3}(?: ?\. ?[0-9]{1,3}){3}"),
    "card": re.compile(r"[0-9](?:[\x20.-]?[0-9])+"),
    "phone": re.compile(r"(?:00|[+(0-9])[0-9]*(?:[\x20().-]+[0-9]+){2,}"),
}


def plausible(kind: str, s: str, before: str, after: str) -> bool:
    """Whether a tagged span can be added to the base ones: whole, and of its kind's form."""
    if before.isalnum() or after.isalnum() or not _SHAPE[kind].fullmatch(s):
        return False
    if kind == "ip":
        return is_ip(s.replace(" ", ""))
    return kind == "email" or (is_card(s) if kind == "card" else is_phone(s))
