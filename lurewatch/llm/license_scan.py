"""Licence scans: Aho-Corasick finds identifier tags and notice phrases, a shunting-yard parser evaluates expressions.

Texts are normalised to words (A-Z lower-cased; everything ASCII but digits and letters separates).  One automaton over
all phrases runs once over each whole text; it reports every place, also overlapping ones.  Where it reports an identifier
tag, the licence expression after the tag is read from the raw text and evaluated: ``or`` lets the reader choose the
milder side, ``and`` binds to both, ``with`` adds an exception that softens a licence by one step.

An identifier of no known family has obligation "unknown" and, where it has the shape of an identifier (a digit in it, or
``LicenseRef-``), its own name as label; other words behind a tag are prose and no label.  ``or`` with an unknown side is
the known side, ``and`` with one is unknown.

Edge cases: a null text is empty; a broken expression gives the labels of the identifiers read so far, no obligation, and
half the certainty of a tag; no phrase found: empty labels, null first_word and last_word, score 0; repeated rows are
scanned alike.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from lurewatch.llm.common import id_text

# Base phrases of the contract and their labels
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Notice phrases of the method, label and how sure a notice makes it
NOTICES = {
    "apache license": ("apache", 0.8), "licensed under the apache license": ("apache", 0.95), "mit license": ("mit", 0.8),
    "released under the mit license": ("mit", 0.95), "permission is hereby granted free of charge": ("mit", 0.9), "bsd license": ("bsd", 0.8),
    "redistribution and use in source and binary forms": ("bsd", 0.9), "mozilla public license": ("mpl", 0.9), "lesser general public license": ("lgpl", 0.9),
    "affero general public license": ("agpl", 0.9), "gnu general public license": ("gpl", 0.95), "eclipse public license": ("epl", 0.9),
    "cc by sa": ("cc-by-sa", 0.9), "cc by nc": ("cc-by-nc", 0.9), "cc by nd": ("cc-by-nd", 0.9), "cc by nc sa": ("cc-by-nc-sa", 0.9),
    "creative commons": ("cc", 0.6), "public domain": ("public-domain", 0.6), "unlicense": ("unlicense", 0.6), "copyright c": ("copyright", 0.4),
    "no rights reserved": ("public-domain", 0.7), "isc license": ("isc", 0.8), "zlib license": ("zlib", 0.8),
}
BASE_SURE = {"cc-by": 0.8, "gpl": 0.8, "reserved": 0.7}
TAGS = ("spdx license identifier",)
# Identifier prefixes, label and obligation (0 none, 1 notice, 2 file-level sharing, 3 sharing, 4 network sharing, 5 closed)
FAMILIES = {"apache": ("apache", 1), "mit": ("mit", 1), "bsd": ("bsd", 1), "isc": ("isc", 1), "zlib": ("zlib", 1), "mpl": ("mpl", 2), "epl": ("epl", 2), "lgpl": ("lgpl", 2), "agpl": ("agpl", 4),
            "gpl": ("gpl", 3), "cc0": ("public-domain", 0), "cc-by-sa": ("cc-by-sa", 3), "cc-by-nc": ("cc-by-nc", 5), "cc-by-nd": ("cc-by-nd", 5), "cc-by": ("cc-by", 1), "unlicense": ("public-domain", 0), "proprietary": ("reserved", 5),
            "0bsd": ("bsd", 0), "artistic": ("artistic", 1)}
ABSENT = ("NONE", "NOASSERTION")  # fixed values: identifiers that name no licence
OBLIGATIONS = ("none", "notice", "file sharing", "sharing", "network sharing", "closed")
_TAG = re.compile(rb"(?i)SPDX-License-Identifier\s*:[ \t]*([^\n\r]*)")
_TOKEN = re.compile(rb"[()]|[A-Za-z0-9.+:-]+")
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_BINDS = {"or": 1, "and": 2, "with": 3}


def family(identifier: str) -> tuple[str | None, int | None]:
    """Label and obligation of an identifier; (None, None) for a word that is none."""
    name = identifier.lower().rstrip("+")
    best = max((f for f in FAMILIES if name == f or name.startswith(f + "-")), key=len, default=None)
    if best:
        return FAMILIES[best]
    return name if any(c.isdigit() for c in name) or name.startswith("licenseref-") else None, None


def to_postfix(tokens: list[str]) -> list[str] | None:
    """Shunting-yard: infix tokens to postfix; None where operands, operators or brackets do not fit."""
    out: list[str] = []
    ops: list[str] = []
    operand = True
    for t in tokens:
        low = t.lower()
        if low in _BINDS:
            if operand:
                return None
            while ops and ops[-1] != "(" and _BINDS[ops[-1]] >= _BINDS[low]:
                out.append(ops.pop())
            ops.append(low)
            operand = True
        elif t == "(":
            if not operand:
                return None
            ops.append(t)
        elif t == ")":
            if operand:
                return None
            while ops and ops[-1] != "(":
                out.append(ops.pop())
            if not ops:
                return None
            ops.pop()
        else:
            if not operand:
                return None
            out.append(t)
            operand = False
    if operand or "(" in ops:
        return None
    return out + ops[::-1]


def evaluate(postfix: list[str]) -> int | None:
    """Obligation of an expression (None: unknown): or = the milder side, and = the stricter, with = one step milder than the licence."""
    stack: list[int | None] = []
    for t in postfix:
        if t in _BINDS:
            b, a = stack.pop(), stack.pop()
            if t == "with":
                stack.append(a and max(1, a - 1))
            elif a is None or b is None:
                stack.append((b if a is None else a) if t == "or" else None)
            else:
                stack.append(min(a, b) if t == "or" else max(a, b))
        else:
            stack.append(family(t)[1])
    return stack[-1]


def read_expressions(text: bytes) -> tuple[set[str], str | None, list[str]]:
    """Labels, strictest obligation (unknown where no expression has a known one) and postfix forms of the identifier tags of a text."""
    labels: set[str] = set()
    levels, forms = [], []
    for m in _TAG.finditer(text):
        tokens = [t.decode() for t in _TOKEN.findall(m[1])]
        # the expression ends where two operands meet: prose may follow the tag
        end, operand = 0, True
        for end, t in enumerate([*tokens, ""]):
            if not t or (not operand and t != ")" and t.lower() not in _BINDS):
                break
            operand = t == "(" or t.lower() in _BINDS
        tokens = tokens[:end]
        after = [None, *tokens]
        labels |= {family(t)[0] for p, t in zip(after, tokens, strict=False) if t not in "()" and t.lower() not in _BINDS and (p or "").lower() != "with"}
        post = to_postfix(tokens)
        if post and not (len(post) == 1 and family(post[0]) == (None, None) and post[0].upper() not in ABSENT):
            levels.append(evaluate(post))
            forms.append(" ".join(post))
    known = [x for x in levels if x is not None]
    return labels - {None}, OBLIGATIONS[max(known)] if known else "unknown" if levels else None, forms


def automaton():
    """One automaton over base phrases, notices and tags: phrase -> (phrase, base label, notice)."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for p in {*BASE, *NOTICES, *TAGS}:
        a.add_word(f" {p} ", (len(p) + 1, BASE.get(p), NOTICES.get(p), p in TAGS))
    a.make_automaton()
    return a


FOUND = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_notices long, expressions string, obligation string"


def scan_text(text: bytes, a) -> tuple:
    words = text.translate(_TABLE).split()
    line = f" {b' '.join(words).decode('utf-8', 'replace')} "
    places, base, labels, doubt, notices, tagged = [], set(), set(), 1.0, 0, False
    seen: set[str] = set()
    for end, (back, label, notice, tag) in a.iter(line):
        if label:
            places.append(end - back)
            base.add(label)
            if label not in seen:
                doubt *= 1 - BASE_SURE[label]
                seen.add(label)
        if notice:
            notices += 1
            labels.add(notice[0])
            if notice[0] not in seen:
                doubt *= 1 - notice[1]
                seen.add(notice[0])
        tagged = tagged or tag
    forms, level = [], None
    if tagged:
        more, level, forms = read_expressions(text)
        labels |= more
        doubt *= 0.02 if more and forms else 0.5 if more else 0.9
    starts = [line.count(" ", 0, p) - 1 for p in (min(places) + 1, max(places) + 1)] if places else [None, None]
    score = 1 - doubt if labels or base or tagged else 0.0
    return len(words), len(places), *starts, ",".join(sorted(base)), ",".join(sorted(labels | base)), score, notices, "; ".join(forms), level


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base places and labels, the method's labels and score, one row per input row; nothing is shuffled."""

    def run(batches):
        a = automaton()
        kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), pa.int64()] + [pa.string()] * 2
        names = [x.split()[0] for x in FOUND.split(", ")]
        for b in batches:
            out = [(d, *scan_text(t, a)) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return id_text(docs, id_col, text_col).mapInArrow(run, FOUND)
