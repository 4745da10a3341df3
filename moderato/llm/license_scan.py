"""Licence scan (operator 8): Aho-Corasick phrases and licence expressions.

A text's words are runs of letters, digits and non-ASCII characters, A-Z
lower-cased.  One automaton finds every phrase in one pass over the words, wherever it
starts: the base phrases, names of licences, and the anchors after which an
expression stands (``SPDX-License-Identifier:``, "licensed under",
"released under").  An anchor's expression is read from the text
that follows it on its line, and over line ends while it ends in an operator or has an open
bracket: names and identifiers (those of the SPDX list 3.27.0 too, ``spdx_ids.txt``) are operands, ``and``,
``or`` and ``with`` operators, and a shunting-yard parser brings them into postfix order and
evaluates them.  An operand is the set of its labels and a grade
of restriction; ``and`` takes the stricter grade, ``or`` the milder, ``with`` an exception
lowers its left side by one grade; labels always add up.  After an identifier tag any
identifier is an operand; one without a grade here is its own label and "unknown", stricter than all
grades.  Operators in small letters join listed identifiers only there, since prose may follow.

``labels`` holds the base labels of all base places and those of all
licences found (outside of expressions only names of several words, since single ones
are also words of languages); ``score`` is 1 if an expression was evaluated, 0.8 if a licence
was named outside of one, 0.5 if only rights are reserved, else 0.  Null texts are
empty; every row gives one row, whatever its id.
"""

from __future__ import annotations

import functools
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moderato.llm.common import documents
from moderato.llm.textbytes import utf8

#: Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Restriction, mildest first.
GRADES = ("public domain", "permissive", "weak copyleft", "copyleft", "non-commercial", "reserved", "unknown")
UNKNOWN = len(GRADES) - 1

#: Names and identifiers as words, their label and grade.
LICENCES = {
    "cc0": ("cc0-1.0", 0), "cc0 1 0": ("cc0-1.0", 0), "public domain": ("public-domain", 0), "unlicense": ("unlicense", 0),
    "mit": ("mit", 1), "mit license": ("mit", 1), "isc": ("isc", 1), "isc license": ("isc", 1), "zlib": ("zlib", 1),
    "bsd 2 clause": ("bsd-2-clause", 1), "bsd 3 clause": ("bsd-3-clause", 1), "bsd license": ("bsd", 1),
    "apache 2 0": ("apache-2.0", 1), "apache license": ("apache", 1), "apache license version 2 0": ("apache-2.0", 1),
    "apache license 2 0": ("apache-2.0", 1), "boost software license": ("bsl-1.0", 1),
    "cc by 3 0": ("cc-by-3.0", 1), "cc by 4 0": ("cc-by-4.0", 1),
    "cc by sa 3 0": ("cc-by-sa-3.0", 3), "cc by sa 4 0": ("cc-by-sa-4.0", 3),
    "cc by nc 4 0": ("cc-by-nc-4.0", 4), "cc by nd 4 0": ("cc-by-nd-4.0", 4),
    "cc by nc sa 4 0": ("cc-by-nc-sa-4.0", 4), "cc by nc nd 4 0": ("cc-by-nc-nd-4.0", 4),
    "mpl 2 0": ("mpl-2.0", 2), "mozilla public license": ("mpl", 2), "mozilla public license version 2 0": ("mpl-2.0", 2),
    "epl 2 0": ("epl-2.0", 2), "eclipse public license": ("epl", 2),
    "lgpl 2 1": ("lgpl-2.1", 2), "lgpl 3 0": ("lgpl-3.0", 2), "gnu lesser general public license": ("lgpl", 2),
    "gpl 2 0": ("gpl-2.0", 3), "gpl 3 0": ("gpl-3.0", 3), "gnu general public license": ("gpl", 3),
    "gnu general public license version 2": ("gpl-2.0", 3), "gnu general public license version 3": ("gpl-3.0", 3),
    "agpl 3 0": ("agpl-3.0", 3), "gnu affero general public license": ("agpl", 3),
    "all rights reserved": ("reserved", 5),
}

#: Words that open well-known notices, their label and grade.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": ("mit", 1),
    "permission to use copy modify and or distribute this software for any purpose": ("isc", 1),
    "redistribution and use in source and binary forms with or without modification": ("bsd", 1),
    "you may not use this file except in compliance with the license": ("apache-2.0", 1),
    "this source code form is subject to the terms of the mozilla public license": ("mpl-2.0", 2),
    "this program is free software you can redistribute it and or modify": ("gpl", 3),
    "this is free and unencumbered software released into the public domain": ("unlicense", 0),
}

#: Exceptions that may stand after ``with``.
EXCEPTIONS = {"classpath exception 2 0": "classpath-exception-2.0", "gcc exception 3 1": "gcc-exception-3.1",
              "llvm exception": "llvm-exception", "linking exception": "linking-exception"}

#: After one of these an expression stands.
ANCHORS = ("spdx license identifier", "licensed under", "released under", "distributed under")

#: Words that may stand around a name in a notice.
FILLERS = {"the", "terms", "of", "either", "a", "an", "license", "licence", "version", "v", "only", "later", "copyleft", "at", "your", "option"}

PRECEDENCE = {"or": 1, "and": 2, "with": 3}

_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[()\n]")
_ID = re.compile(rb"[0-9A-Za-z][0-9A-Za-z.\-]*(?::[0-9A-Za-z][0-9A-Za-z.\-]*)?\+?|[()]")
_LEAD = re.compile(rb"[^0-9A-Za-z\x80-\xff(\n]*")
_BLANKS = re.compile(rb"[ \t\r]*")
_NEXT_LINE = re.compile(rb"[ \t\r]*(?:\n[^0-9A-Za-z\x80-\xff()\n]*)?")      # with the marks of a comment


@functools.cache
def _automaton():
    import ahocorasick
    a = ahocorasick.Automaton()
    for phrase in {*BASE, *LICENCES, *NOTICES, *ANCHORS}:
        a.add_word(f" {phrase} ", phrase)
    a.make_automaton()
    return a


@functools.cache
def _listed() -> dict[str, str]:
    """The SPDX identifiers as words."""
    ids = (Path(__file__).parent / "spdx_ids.txt").read_text().lower().split()
    return {" ".join(re.findall("[0-9a-z]+", i)): i for i in ids}


@functools.cache
def _grades() -> dict[str, int]:
    return dict(LICENCES.values())


@functools.cache
def _names() -> dict[str, list[tuple[str, ...]]]:
    """By first word the names and exceptions that start with it, longest first."""
    out: dict[str, list[tuple[str, ...]]] = {}
    for p in sorted({*LICENCES, *EXCEPTIONS, *(p for p in _listed() if " " in p and " with " not in p)}, key=lambda p: (-len(p.split()), p)):
        out.setdefault(p.split()[0], []).append(tuple(p.split()))
    return out


def _known(name: str) -> str:
    """A name without "only" or "or later" where that is in the tables."""
    short = re.sub(" (only|or later)$", "", name)
    return short if short in LICENCES else name


def _closed(out: list[str], depth: int) -> list[str]:
    while out and (out[-1] in PRECEDENCE or out[-1] == "("):
        depth -= out.pop() == "("
    return out + [")"] * depth


def operands(text: bytes, at: int = 0) -> list[str]:
    """Names, operators and brackets of the expression that starts at ``at``."""
    out, depth, held = [], 0, []
    found = _WORD.finditer(text, at)

    def ahead(n):
        """The next n words; line ends inside a name end it."""
        while len(held) < n and (m := next(found, None)):
            held.append(m[0].lower().decode("utf-8", "replace"))
        return held[:n]
    last = ""
    while ahead(1):
        w = held[0]
        operand_next = not out or out[-1] in PRECEDENCE or out[-1] == "("
        name = operand_next and next((n for n in _names().get(w, ()) if tuple(ahead(len(n))) == n), None)
        if w == "\n":
            if not (out and (last in PRECEDENCE or last == "(" or depth)):
                break
            w = last
        elif w == "(" and operand_next or w == ")" and depth and not operand_next:
            depth += 1 if w == "(" else -1
            out.append(w)
        elif name:
            out.append(_known(" ".join(name)))
            del held[:len(name) - 1]
        elif w in PRECEDENCE and not operand_next:
            out.append(w)
        elif w not in FILLERS:
            break
        last = w
        del held[0]
    return _closed(out, depth)


def tag_operands(text: bytes, at: int = 0) -> list[str]:
    """The same after an identifier tag, where any identifier is an operand."""
    out, depth, at = [], 0, _LEAD.match(text, at).end()
    loose = False               # after an operator in small letters
    while m := _ID.match(text, at):
        raw = m[0].rstrip(b".").decode()
        w, ends = raw.lower(), m[0].endswith(b".")
        operand_next = not out or out[-1] in PRECEDENCE or out[-1] == "("
        if w in "()":
            if (w == "(") != operand_next or w == ")" and not depth:
                break
            depth += 1 if w == "(" else -1
            out.append(w)
        elif operand_next:
            name = " ".join(re.findall("[0-9a-z]+", w))
            known = _known(name)
            if loose and not (known in LICENCES or known in EXCEPTIONS or name in _listed() or "licenseref-" in w):
                break
            out.append(known if known in LICENCES or known in EXCEPTIONS else w)
        elif w in PRECEDENCE:
            out.append(w)
        else:
            break
        if w not in "()":
            loose = w in PRECEDENCE and raw.islower()
        if ends:
            break
        more = out[-1] in PRECEDENCE or out[-1] == "(" or depth
        at = (_NEXT_LINE if more else _BLANKS).match(text, m.end()).end()
    return _closed(out, depth)


def _label(t: str) -> tuple[str, int, bool]:
    """Label and grade of an operand, and whether it is an exception with a known effect."""
    if t in EXCEPTIONS:
        return EXCEPTIONS[t], 1, True
    if t in LICENCES:
        return *LICENCES[t], False
    label = _listed().get(t, t)
    return label, _grades().get(label, UNKNOWN), False


def postfix(tokens: list[str]) -> list[str]:
    """Shunting-yard: operands in order, operators after what they join."""
    out, held = [], []
    for t in tokens:
        if t in PRECEDENCE:
            while held and held[-1] != "(" and PRECEDENCE[held[-1]] >= PRECEDENCE[t]:
                out.append(held.pop())
            held.append(t)
        elif t == "(":
            held.append(t)
        elif t == ")":
            while held[-1] != "(":
                out.append(held.pop())
            held.pop()
        else:
            out.append(t)
    return out + held[::-1]


def evaluate(tokens: list[str]) -> tuple[set[str], int] | None:
    """Labels and grade of an expression; None if there is none."""
    held: list[tuple[set[str], int, bool]] = []
    for t in postfix(tokens):
        if t in PRECEDENCE:
            right, left = held.pop(), held.pop()
            if t == "with":     # what an exception that isn't known permits isn't known either
                grade = max(1, left[1] - 1) if right[2] and left[1] != UNKNOWN else left[1]
            else:
                grade = {"or": min, "and": max}[t](left[1], right[1])
            held.append((left[0] | right[0], grade, False))
        else:
            label, grade, exception = _label(t)
            held.append(({label}, grade, exception))
    return held[0][:2] if held else None


def scan(text: bytes) -> dict:
    """All findings in one text."""
    words = text.translate(_TO_WORDS).split()
    line = " " + b" ".join(words).decode("utf-8", "replace") + " "
    base, base_labels, named, best = [], set(), {}, None
    grade, expressions, hits = None, [], list(_automaton().iter(line))
    if hits:        # a hit's word is as many as there are spaces before it
        spaces = np.flatnonzero(np.frombuffer(line.encode("utf-32-le"), np.uint32) == 32)
        word = lambda start: int(np.searchsorted(spaces, start))
    for end, phrase in hits:
        start = end - len(phrase) - 1
        if phrase in BASE:
            base.append(word(start))
            base_labels.add(BASE[phrase])
        if (phrase in NOTICES or phrase in LICENCES and " " in phrase) and phrase != "all rights reserved":
            named[start] = phrase                   # ends go up, so the longest from a place stays
        if phrase in ANCHORS:
            expressions.append((word(start) + len(phrase.split()), phrase == ANCHORS[0]))
    known = LICENCES | NOTICES
    labels, evaluated = set(base_labels) | {known[p][0] for p in named.values()}, []
    if expressions:
        at = [m.end() for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", text)]
        for k, tag in expressions:
            tokens = (tag_operands if tag else operands)(text, at[k - 1])
            best = evaluate(tokens) if tokens else None
            if best:
                evaluated.append(" ".join(tokens))
                labels |= best[0]
                grade = best[1] if grade is None else max(grade, best[1])
    if grade is None and named:
        grade = max(known[p][1] for p in named.values())
    if grade is None and "reserved" in base_labels:     # a copyright line beside a licence reserves nothing that it grants
        grade = 5
    score = 1.0 if evaluated else 0.8 if labels - {"reserved"} else 0.5 if labels else 0.0
    return {"n_words": len(words), "n_base": len(base), "first_word": min(base, default=None), "last_word": max(base, default=None),
            "base_labels": ",".join(sorted(base_labels)), "labels": ",".join(sorted(labels)), "score": score,
            "expressions": evaluated, "terms": None if grade is None else GRADES[grade]}


_FOUND = [("n_words", pa.int64(), "long"), ("n_base", pa.int64(), "long"), ("first_word", pa.int64(), "long"),
          ("last_word", pa.int64(), "long"), ("base_labels", pa.string(), "string"), ("labels", pa.string(), "string"),
          ("score", pa.float64(), "double"), ("expressions", pa.list_(pa.string()), "array<string>"), ("terms", pa.string(), "string")]


def _scan(batches):
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        raw, ends = memoryview(np.ascontiguousarray(data)), offsets.tolist()
        rows = [scan(bytes(raw[a:b])) for a, b in zip(ends, ends[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], t) for k, t, _ in _FOUND)],
                                         names=["id", *(k for k, _, _ in _FOUND)])


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id and all findings."""
    ins = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return ins.mapInArrow(_scan, "id long, " + ", ".join(f"{k} {t}" for k, _, t in _FOUND))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score, expressions, terms``."""
    out = scan_licences(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")
    return out.withColumn("expressions", F.array_join("expressions", "; "))
