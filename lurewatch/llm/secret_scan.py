"""Secret scans: assignment-aware lexing of source and configuration text.

Three fixed kinds of match (``assign``, ``access``, ``hex``) are always reported.  On top, a lexer parses name-literal
pairs from the common shapes of code and configuration (``name = "x"``, ``name: x``, ``"name": "x"``, ``export NAME=x``,
``name := 'x' + 'y'``, ``name: type = "x"``, ``label: name = "x"``, ``name: Bearer x``), reads unquoted values to the next
blank, and follows names assigned to names: with ``a = "x"`` and ``db_password = a``, in either order, the literal of
``a`` ends in ``db_password``.  A literal scores by the most sensitive name that it
reaches times how much it looks like a secret (length, character kinds, entropy; placeholders score nothing); literals of
at least ``MIN_SCORE`` become spans of kind ``literal``.

Names are judged by their parts (``author``, ``tokenizer`` and ``max_tokens`` are not sensitive).  Triple quotes, back
quotes and element texts hold literals too; in ``x + y`` and ``x or y`` every literal and every name counts, a call none.

Offsets are code points of the whole text.  Edge cases: a null text is empty; no match gives counts of 0, the digest of
the empty string and empty spans; names assigned in a circle end where the circle closes; repeated rows are scanned alike.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from lurewatch.llm.common import id_text

# The three base kinds of the contract, in their order, and their least lengths
ASSIGN = re.compile(rb"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "literal")
LEAST_VALUE, LEAST_ACCESS = 6, 20
# Parts of names that make a target sensitive
# anywhere in a name, at the end of a part of it, or as whole parts
ANYWHERE = {b"password": 1.0, b"passwd": 1.0, b"passphrase": 1.0, b"apikey": 1.0}
AT_END = {b"pwd": 0.9, b"secret": 1.0, b"token": 0.9}
WHOLE = {b"private_key": 1.0, b"api_key": 1.0, b"access_key": 1.0, b"credential": 0.9, b"credentials": 0.9, b"auth": 0.7, b"bearer": 0.9, b"signing_key": 1.0,
         b"encryption_key": 1.0, b"connection_string": 0.8, b"conn_str": 0.8}
# Literals that stand for another one, as a whole part; and marks of one
PLACEHOLDERS = frozenset((b"example", b"changeme", b"your", b"placeholder", b"none", b"null", b"true", b"false", b"dummy", b"todo"))
MARKS = (b"xxxx", b"****")
MIN_SCORE = 0.45
_WORDS = (b"pass", b"secret", b"token", b"key", b"pwd", b"credential", b"auth", b"bearer", b"conn")
_HEX_RUN = bytes(120 if 48 <= b <= 57 or 97 <= b <= 102 else 32 for b in range(256))
# a name and its separator; names start at a word's first letter and have no length limit, so each word is read once
_TARGET = re.compile(rb"""(?<![A-Za-z0-9_.\-])[0-9.\-]*+(?P<name>[A-Za-z_][A-Za-z0-9_.\-]*+)(?:["']\]?)?+[ \t]*+(?P<sep>:=|=>|=(?!=)|:(?![:=]))[ \t]*+""")
_QUOTED = re.compile(
    rb"""[bBrRuUfF]{0,2}(?P<value>\"{3}(?:[^"\\]|\\.|"(?!""))*+\"{3}|'{3}(?:[^'\\]|\\.|'(?!''))*+'{3}|`[^`\n]*+`|"(?:[^"\\\n]|\\.)*+"(?:[ \t]*+\+[ \t]*+"(?:[^"\\\n]|\\.)*+")*+|'(?:[^'\\\n]|\\.)*+'(?:[ \t]*+\+[ \t]*+'(?:[^'\\\n]|\\.)*+')*+)""", re.S)
# what joins a value to a further one, a name or call that stands for one, and an element with its text
_OP = re.compile(rb"[ \t]*+(?:\+|\|\||\?\?|or(?![A-Za-z0-9_]))[ \t]*+")
_OPERAND = re.compile(rb"\$?[A-Za-z_][A-Za-z0-9_.]*+(?:\([^()\n]*+\)|\[[^\[\]\n]*+\])?+")
_ELEMENT = re.compile(rb"<(?P<name>[A-Za-z_][A-Za-z0-9_.:\-]*+)(?:[ \t][^<>\n]*+)?>(?P<value>[^<>]++)</(?P=name)>")
# an unquoted value goes to the next blank, or to a mark behind which a further pair starts
_RUN = re.compile(rb"""(?:[^\x20\t\r\n\x0b\x0c;,&]|[;,&](?!["']?[A-Za-z_][A-Za-z0-9_.\-]*+["']?(?::=|=>|[:=])))++""")
_ONE_TYPE = rb"(?:&(?:'[a-z]\w*+[ \t]++)?)?[A-Za-z_][A-Za-z0-9_.]*+(?:\[[^\[\]\n=]*+(?:\[[^\[\]\n=]*+\][^\[\]\n=]*+)*+\]|<[^<>\n=]*+>)?"
# what stands between a colon and the assignment that follows: a type, or a name that the colon labels
_TYPE = re.compile(rb"(?P<type>" + _ONE_TYPE + rb"(?:[ \t]*+\|[ \t]*+" + _ONE_TYPE + rb")*+\??)(?P<gap>[ \t]*+)(?::=|=(?![=>]))(?P<after>[ \t]*+)(?=[^\x20\t\r\n\x0b\x0c])")
_TYPES = {b"str", b"string", b"String", b"bytes", b"SecretStr", b"SecretBytes", b"any", b"Any", b"char", b"text"}
_SCHEME = re.compile(rb"(?i)(?P<scheme>bearer|basic|token|digest|apikey)[ \t]++(?=[^\x20\t\r\n\x0b\x0c])")
_NAME = re.compile(rb"\$?\{?([A-Za-z_][A-Za-z0-9_.\-]*+)\}?\Z")
_JOIN = re.compile(rb"""["'][ \t]*\+[ \t]*["']""")


def name_weight(name: bytes) -> float:
    """How sensitive a target name is, by its parts: camel case, dots and dashes are read as underscores."""
    low = b"_" + re.sub(rb"([a-z0-9])([A-Z])", rb"\1_\2", name).lower().replace(b"-", b"_").replace(b".", b"_") + b"_"
    found = [w for part, w in ANYWHERE.items() if part in low] + [w for part, w in AT_END.items() if part + b"_" in low]
    return max(found + [w for part, w in WHOLE.items() if b"_" + part + b"_" in low], default=0.0)


def literal_weight(value: bytes) -> float:
    """How much a literal looks like a secret, 0 to 1."""
    value = value.strip()
    low = value.lower()
    if len(value) < 6 or b" " in value or len(set(value)) < 4 or low[:1] == b"<" or any(p in low for p in MARKS) or not PLACEHOLDERS.isdisjoint(re.split(rb"[^a-z0-9]+", low)):
        return 0.0
    counts = Counter(value)
    entropy = -sum(c / len(value) * math.log2(c / len(value)) for c in counts.values())
    kinds = sum(bool(re.search(p, value)) for p in (rb"[a-z]", rb"[A-Z]", rb"[0-9]", rb"[^A-Za-z0-9]"))
    return min(1.0, 0.2 * min(kinds, 3) + 0.1 * min(entropy, 4.0) + (0.1 if len(value) >= 16 else 0.0))


class _Run:
    """An unquoted stretch of the text; values inside end before the marks that close what is around them."""

    def __init__(self, text: bytes = b"", start: int = 0, end: int = 0):
        self.text, self.start, self.end = text, start, end
        self.last = [(text.rfind(o, start, end), c) for o, c in ((b"(", b")"), (b"{", b"}"), (b"[", b"]"))]
        self.ends: dict[bytes, int] = {}

    def end_from(self, at: int) -> int:
        closing = b",;'\"`" + b"".join(c for i, c in self.last if i < at)
        if closing not in self.ends:
            self.ends[closing] = self.start + len(self.text[self.start : self.end].rstrip(closing))
        return self.ends[closing]


def _inside(text: bytes, q: re.Match) -> tuple[int, int]:
    """Where a quoted value's text is, without its outer quotes."""
    start, end = q.span("value")
    n = 3 if end - start >= 6 and text[start : start + 3] in (b'"""', b"'''") else 1
    return start + n, end - n


def _chain(text: bytes, at: int) -> tuple[list[tuple[tuple[int, int], bool]], int]:
    """Further operands of ``x + y`` and ``x or y`` from ``at`` on, as spans (quoted or not), and where they end."""
    out: list[tuple[tuple[int, int], bool]] = []
    while o := _OP.match(text, at):
        if q := _QUOTED.match(text, o.end()):
            out.append((_inside(text, q), True))
        elif not (q := _OPERAND.match(text, o.end())):
            break
        else:
            out.append((q.span(), False))
        at = q.end()
    return out, at


def _pairs(text: bytes) -> list[tuple[bytes, tuple[int, int], bool]]:
    """Names with the spans of their values, in text order, and whether the value is quoted.

    A quoted value is passed over.  An unquoted one is passed over if its name is sensitive; otherwise further pairs may
    start inside (``env: DB_PWD=x``).  A name in front of a colon and a type or name with an assignment of its own gets
    the value of that assignment (``db_pwd: SecretStr = "x"``); so does a name in front of ``Bearer`` and the like.
    """
    out: list[tuple[bytes, tuple[int, int], bool]] = []
    if b"</" in text:
        out += [(m["name"], m.span("value"), True) for m in _ELEMENT.finditer(text) if name_weight(m["name"])]
    pos, types, run = 0, -1, _Run()
    while m := _TARGET.search(text, pos):
        pos, name, at = m.end("sep"), m["name"], m.end()
        if m.start("name") == types:  # the type of the name before, which has the value already
            if q := _QUOTED.match(text, at):
                pos = q.end()
            continue
        after = None
        if m["sep"] == b":" and (t := _TYPE.match(text, at)) and (t["gap"] or not t["after"]) and (m.end("sep") < at or t["gap"] or text[t.end() : t.end() + 1] in (b'"', b"'")):
            after, at = t, t.end()
            if t["type"] in _TYPES:
                types = t.start("type")
        if q := _QUOTED.match(text, at):
            start, end = _inside(text, q)
            names = [name]
            if s := _SCHEME.match(text, start, end):
                names.append(s["scheme"])
                start = s.end()
            out += [(x, (start, end), True) for x in names]
            more, stop = _chain(text, q.end())
            out += [(x, *operand) for x in names for operand in more]
            # behind a simple type, that name's own pair comes next
            if after is None or not _NAME.match(after["type"]):
                pos = stop
            continue
        names = [name]
        if s := _SCHEME.match(text, at):
            names.append(s["scheme"])
            at = s.end()
        if (o := _OPERAND.match(text, at)) and (o.end() > at):
            more, stop = _chain(text, o.end())
            if more or (text[o.end() - 1 : o.end()] in (b")", b"]") and text[o.end() : o.end() + 1] in (b"", b"\n", b"\r", b";", b",", b" ", b")", b"}")):
                # an expression: its names may be known, its calls are no literals
                out += [(x, *operand) for x in names for operand in (((at, o.end()), False), *more) if operand[1] or _NAME.match(text, *operand[0])]
                pos = max(pos, stop) if more else pos
                continue
        if not run.start <= at < run.end:
            r = _RUN.match(text, at)
            if r is None or text[at : at + 1] in (b'"', b"'"):
                continue
            run = _Run(text, *r.span())
        passed = after is None and max(map(name_weight, names)) > 0
        end = run.end_from(at)
        if end > at:
            out += [(x, (at, end), False) for x in names]
            if passed:
                pos = max(pos, end)
    return out


def lexed_literals(text: bytes) -> list[tuple[int, int, float, bytes]]:
    """Literals with a score of at least MIN_SCORE: start, end (bytes), score, most sensitive name reached."""
    pairs = _pairs(text)
    defined: dict[bytes, list[int]] = {}
    for i, (name, _, _) in enumerate(pairs):
        defined.setdefault(name, []).append(i)
    # a value that is a name means that name's last definition before, or the first one behind
    refers: list[int | None] = []
    for i, (name, (start, end), quoted) in enumerate(pairs):
        other = None if quoted else _NAME.match(text, start, end)
        known = defined.get(other[1]) if other else None
        k = bisect_left(known, i) if known else 0
        if known and (other[1] != name or k):
            refers.append(known[k - 1] if k else known[0])
        else:
            refers.append(-1 if quoted or text[start : start + 1] != b"$" else None)
    ends: list[int | None] = [None] * len(pairs)
    state = bytearray(len(pairs))  # 1: on the path, 2: settled
    for i in range(len(pairs)):
        path, at = [], i
        while at is not None and at >= 0 and not state[at]:
            state[at] = 1
            path.append(at)
            at = refers[at]
        end = None if at is None or (at >= 0 and state[at] == 1) else path[-1] if at < 0 else ends[at]
        for x in path:
            ends[x], state[x] = end, 2
    best: dict[tuple[int, int], tuple[float, bytes]] = {}
    for (name, _, _), end in zip(pairs, ends, strict=True):
        if end is not None and (w := name_weight(name)) > best.get(pairs[end][1], (0.0, b""))[0]:
            best[pairs[end][1]] = (w, name)
    found = [(*at, w * literal_weight(_JOIN.sub(b"", text[at[0] : at[1]])), name) for at, (w, name) in best.items()]
    return sorted(x for x in found if x[2] >= MIN_SCORE)


def find_secrets(text: bytes) -> tuple[int, int, int, str, str, float]:
    """n_assign, n_access, n_hex, digest of the base spans, all spans, highest score of a literal."""
    low = text.lower()
    spans: list[tuple[int, int, int]] = []
    if any(k in low for k in (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if b"AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    if b"x" * 24 in text.translate(_HEX_RUN):
        spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    n = Counter(k for _, k, _ in spans)
    more = lexed_literals(text) if (b"=" in text or b":" in text or b"</" in text) and any(w in low for w in _WORDS) else []
    ascii_only = text.isascii()
    at = (lambda i: i) if ascii_only else (lambda i: len(text[:i].decode("utf-8", "replace")))
    show = lambda some: ",".join(f"{KINDS[k]}:{at(i)}:{at(j)}" for i, k, j in sorted(some))
    base = show(spans)
    every = show(spans + [(i, 3, j) for i, j, _, _ in more]) if more else base
    return n[0], n[1], n[2], hashlib.sha256(base.encode()).hexdigest(), every, max((s for _, _, s, _ in more), default=0.0)


FOUND = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, literal_score double"


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, digest and spans for every row; nothing is shuffled."""

    def run(batches):
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        names = [x.split()[0] for x in FOUND.split(", ")]
        for b in batches:
            out = [(d, *find_secrets(t)) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return id_text(docs, id_col, text_col).mapInArrow(run, FOUND)
