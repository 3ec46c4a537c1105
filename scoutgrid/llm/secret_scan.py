"""Secret scans: assignment-aware lexing of whole texts.

Source and configuration lines are read as name-literal pairs, names that stand for literals are propagated, and each literal is
scored by the name it ends up under. Fixed patterns (``BASE``) are found beside it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from scoutgrid.llm.text import packed

KINDS = ("assign", "access", "hex", "named")

# The base patterns and their least lengths.
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 8, "access": 16, "hex": 32}
# A hexadecimal run of the least length, found without stopping at every letter.
LONG_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")

# Scores of the parts of a target name; a literal under a name that reaches NAME_SCORE is reported.
NAME_SCORE = 2
PART_SCORES = {
    "password": 3, "passwd": 3, "pwd": 3, "passphrase": 3, "secret": 3, "token": 2, "apikey": 3, "credential": 3, "credentials": 3,
    "private": 1, "access": 1, "api": 1, "auth": 1, "key": 1, "bearer": 2, "client": 0, "signing": 1, "encryption": 1,
    "public": -2, "id": -1, "name": -2, "url": -2, "path": -2, "file": -2, "count": -2, "length": -2, "max": -2, "min": -2,
}
PLACEHOLDERS = ("example", "changeme", "placeholder", "your", "dummy", "xxxx", "redacted", "none", "null", "true", "false")

# No repeat has an upper bound and none is given back; a stretch of name signs is entered only at its start, so that none is scanned twice.
PLACEHOLDER = re.compile("|".join(PLACEHOLDERS), re.I | re.A)
PAIR = re.compile(r"""(?<![A-Za-z0-9_.-])["']?[0-9.-]*+([A-Za-z_][A-Za-z0-9_.-]*+)["']?+\]?+[\x20\t]*+
    (?::[\x20\t]*+(?:&(?:'[a-z]+\x20)?)?TYPE(?:[\x20\t]*+\|[\x20\t]*+TYPE)*+(?:[\x20\t]++=|=(?=["']))|:=|=>|[=:])(?![=:/])[\x20\t]*+"""
                  .replace("TYPE", r"[A-Za-z_][A-Za-z0-9_.]*+(?:\[[^\]=\n]*+\]|<[^>=\n]*+>)?+\??"), re.A | re.X)
# Quoted literals, with a prefix of one or two letters or none, over several lines with three quotes; a name; an unquoted literal.
QUOTE = re.compile(r"""(?:[A-Za-z]{1,2}(?=["'`]))?["'`]""", re.A)
PIECE = re.compile(r"""(?:(?:[A-Za-z]{1,2}(?=["'`]))?(?:\"{3}((?:[^"\\]|\\.|"(?!""))*+)\"{3}|'{3}((?:[^'\\]|\\.|'(?!''))*+)'{3}
    |"((?:[^"\\\n]|\\[^\n])*+)"|'((?:[^'\\\n]|\\[^\n])*+)'|`((?:[^`\\]|\\.)*+)`)
    |(?P<name>[A-Za-z_][A-Za-z0-9_.]*)(?![A-Za-z0-9_+/=(-])|([A-Za-z0-9+/_=-]{8,}))[\x20\t]*+""", re.A | re.S | re.X)
# A block of indented lines below a YAML key, its lines, a name and a literal as the first two arguments of a call, and a literal in an element of its name.
BLOCK = re.compile(r"[|>][+-]?[0-9]?[\x20\t]*+(?:\#[^\n]*+)?\r?\n(?=([\x20\t]++)\S)", re.A)
BLOCK_LINE = re.compile(r"([\x20\t]++)([^\s][^\r\n]*+)\r?\n?", re.A)
CALL = re.compile(r"""\(\s*+["']([A-Za-z_][A-Za-z0-9_.-]*+)["']\s*+,\s*+(?=(?:[A-Za-z]{1,2})?["'`])""", re.A)
ELEMENT = re.compile(r"<([A-Za-z_][A-Za-z0-9_.-]*+)(?:\x20[^<>\n]*+)?>[\x20\t]*+([^<>\s]++)[\x20\t]*+</(?=\1>)", re.A)
JOINT = re.compile(r"[+.][\x20\t]*+")
# An unquoted stretch, what may follow it at the end of a line, and stretches that are calls, look-ups or references instead of literals.
STRETCH = re.compile(r"[^\s]*+", re.A)
LINE_END = re.compile(r"[\x20\t]*+(?=[\r\n]|\Z)|[\x20\t]++(?:\#|;|//)", re.A)
CODE = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*+(?:\(.*\)|\[.*\]|[(\[{])[;,]?|\$[({].*|<.*>|\{\{.*", re.A)
BLANK = re.compile(r"\s")
PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


def name_score(name: str) -> int:
    return sum(PART_SCORES.get(p.lower(), 0) for p in PARTS.findall(name))


def plausible(literal: str) -> bool:
    """Eight or more signs of which four differ, no blank, no placeholder."""
    low = literal.lower()
    return len(literal) >= 8 and len(set(literal)) >= 4 and not BLANK.search(literal) and not any(p in low for p in PLACEHOLDERS)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns: leftmost matches that do not overlap within a kind, too short ones dropped."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end() - m.start(1) >= LEAST["assign"]]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    found += [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text)]
    return sorted(found)


class Literals:
    """What a name stands for: spans, and the literals of the names it was made from. A chain shares its links, however long it is."""

    __slots__ = ("parts", "told")

    def __init__(self, parts: list):
        self.parts, self.told = parts, False

    def tell(self) -> Iterator[tuple[int, int, bool]]:
        """Its spans, but for those that were told before."""
        stack = [self]
        while stack:
            link = stack.pop()
            if not link.told:
                link.told = True
                for part in link.parts:
                    if isinstance(part, Literals):
                        stack.append(part)
                    else:
                        yield part


def _value(text: str, at: int, known: dict[str, Literals]) -> tuple[list, int, list[str]]:
    """Parts of the expression at ``at``, where it ends, and its unknown names."""
    parts: list = []
    unknown: list[str] = []
    while m := PIECE.match(text, at):
        if name := m["name"]:
            if name in known:
                parts.append(known[name])
            else:
                unknown.append(name)
        else:
            parts.append((*m.span(m.lastindex), False))
        at = m.end()
        joint = JOINT.match(text, at)
        if not joint:
            break
        at = joint.end()
    return parts, at, unknown


def _sensitive(name: str) -> bool:
    return name_score(name.rpartition(".")[2]) >= NAME_SCORE


def _block_lines(text: str, at: int, indent: str) -> Iterator[tuple[int, int, bool]]:
    while (line := BLOCK_LINE.match(text, at)) and line[1].startswith(indent):
        yield *line.span(2), False
        at = line.end()


def named_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of literals under sensitive names, directly or through constants.

    A name keeps the literals of its last assignment; a chain a = "..."; b = a; password = b leads to the first literal, and a constant
    may stand below its use. Targets may be subscripts, arguments of a call and elements; values may have a prefix, three quotes or
    back quotes, or be an indented block. An unquoted value up to the end of its line (.env, INI, YAML) is one literal, whatever its signs,
    unless it is an expression of known names and literals or looks like code.
    """
    known: dict[str, Literals] = {}
    found: set[tuple[int, int, int]] = set()
    waiting: set[str] = set()

    def report(spans) -> bool:
        hits = [(s, 3, e) for s, e, unquoted in spans if plausible(text[s:e]) and not (unquoted and CODE.fullmatch(text, s, e))]
        found.update(hits)
        return bool(hits)

    at = stop = 0
    doubtful = -1  # where the last placeholder of the stretch begins: no value that reaches the stretch's end and holds it is plausible
    ends_line = False
    while m := PAIR.search(text, at):
        parts, end, unknown = _value(text, m.end(), known)
        if m.end() >= stop:
            stop = STRETCH.match(text, m.end()).end()
            ends_line = LINE_END.match(text, stop) is not None
            doubtful = max((x.start() for x in PLACEHOLDER.finditer(text, m.end(), stop)), default=-1) if ends_line else -1
        sensitive = _sensitive(m[1])
        if sensitive and (block := BLOCK.match(text, m.end())):
            report(_block_lines(text, block.end(), block[1]))
        bare = ends_line and m.end() < len(text) and not QUOTE.match(text, m.end()) and (bool(unknown) or end < stop)
        known[m[1]] = value = Literals([(m.end(), stop, True)] if bare else parts)
        at = max(end, m.end())
        if sensitive:
            waiting.update(unknown)
        if bare and m.end() <= doubtful:
            continue
        if sensitive and report(value.tell()) and bare:
            at = max(at, stop)
    for name in waiting & known.keys():
        report(known[name].tell())
    if "(" in text:
        for m in CALL.finditer(text):
            if _sensitive(m[1]) and (piece := PIECE.match(text, m.end())):
                report([(*piece.span(piece.lastindex), False)])
    if "</" in text:
        for m in ELEMENT.finditer(text):
            if _sensitive(m[1]):
                report([(*m.span(2), False)])
    return sorted(found)


def spans_of(text: str | None) -> list[tuple[int, int, int]]:
    """All spans as (start, kind, end), sorted: base ones and those of the lexer, in code points."""
    if not text:
        return []
    named = named_spans(text) if ":" in text or "=" in text or "</" in text or "(" in text else []
    return sorted(base_spans(text) + named)


def redacted_text(text: str | None, mark: str = "[SECRET]") -> str | None:
    """The text with every covered stretch replaced by the mark; overlapping spans become one mark."""
    out, at, end = [], 0, -1
    for start, _, stop in spans_of(text):
        if start >= end:
            out += [text[at:start], mark]
            at = stop
        at = end = max(at, stop)
    return "".join([*out, text[at:]]) if out else text


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        spans = [[{"start": s, "end": e, "kind": KINDS[k]} for s, k, e in spans_of(t)] for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, SPANS)], ["row", "spans"])


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))


def scanned(docs: DataFrame, text: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """``row`` (the columns ``keep``, default all) and ``spans``, an array of (start, end, kind) ordered by start and kind.

    Null and empty texts have no spans; every row is scanned alone and whole, so repeated rows and long texts need
    nothing special (the time grows with the length). An empty table gives an empty result; the input row travels as one struct, so that
    names of other columns cannot clash.
    """
    columns = list(keep or docs.columns)
    kept = docs.select(F.struct(*[docs[f"`{c}`"] for c in columns]).alias("row"), docs[f"`{text}`"].cast("string").alias("t"))
    kind = kept.schema["row"].dataType.simpleString()
    return kept.mapInArrow(_scan, f"row {kind}, spans array<struct<start:int,end:int,kind:string>>")


def redacted(docs: DataFrame, text: str = "text", length: str | None = "n_chars", mark: str = "[SECRET]") -> DataFrame:
    """The input rows with secrets replaced by ``mark`` and ``length`` (if such a column exists) counted anew.

    Null texts stay null; repeated rows change alike, very long ones are read whole; an empty table gives none; other columns pass through.
    """
    @F.pandas_udf("string")
    def clean(texts):
        return texts.map(lambda t: redacted_text(t, mark))

    out = packed(docs, clean=clean(docs[f"`{text}`"].cast("string")))
    fresh = {text: F.col("clean")}
    if length in docs.columns:
        fresh[length] = F.when(F.col("clean").isNull(), F.col(f"row.`{length}`")).otherwise(F.length("clean")).cast(docs.schema[length].dataType)
    return out.select(*[fresh.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
