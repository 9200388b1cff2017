"""Secret scan by assignment-aware lexing.

Besides three plain patterns, source and configuration syntax is read into name-literal pairs: at every
assignment sign (``=``, ``:``, ``:=``, ``=>``, XML attributes, YAML and INI keys, JSON members, keyword arguments)
the name to its left and the expression to its right are lexed, where an expression is a chain of
literals and names joined by ``+`` or ``.``. Names that hold constants are propagated in text order, so
a literal is judged by every name it reaches: ``a = "..."`` followed by ``db_password = a`` reports the
literal of the first line. The score is the target name's sensitivity times the literal's strength.
"""
from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# The plain patterns and the order in which kinds are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "literal")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20

#: How sensitive a word of a target name is; neighbouring words are tried joined as well.
SENSITIVE = {
    "password": 1.0,
    "passwd": 1.0,
    "passphrase": 1.0,
    "passcode": 0.9,
    "pwd": 0.9,
    "pw": 0.7,
    "pass": 0.7,
    "secret": 1.0,
    "token": 0.9,
    "apikey": 1.0,
    "accesskey": 1.0,
    "privatekey": 1.0,
    "secretkey": 1.0,
    "signingkey": 0.9,
    "encryptionkey": 0.9,
    "credential": 0.9,
    "credentials": 0.9,
    "bearer": 0.8,
    "auth": 0.7,
    "authorization": 0.8,
    "jwt": 0.9,
    "key": 0.6,
    "salt": 0.5,
}
#: Reported from this product of name and literal on.
LEAST_SCORE = 0.4
LEAST_LITERAL = 6

_SIGN = re.compile(r":=|=>|=(?![=~])|:(?![:/])")
#: Characters before a sign that make it another operator.
_NOT_BEFORE = frozenset("=!<>:+-*/%&|^~")
_KEYWORD_LEFT = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*$""", re.I | re.A)
#: A name, what may close it, and a type after it, all read from the sign to the left.
_NAME_LEFT = re.compile(r"""[ \t]*(?:[\w.\[\]<>]*[A-Za-z_][ \t]*:[ \t]*)?(?:["'\]]|\)[ \t]*)?([\w$]*[A-Za-z_$](?:[.\-][\w$]*[A-Za-z_$])*)""", re.A)
_TERM = re.compile(
    r"""[ \t]*(?:[\[({]\s*)?(?:[rbuf]{1,2}(?=["']))?(?:\"""(?P<t>(?:[^"\\]|\\.|"(?!""))*)\"""|\'\'\'(?P<u>(?:[^'\\]|\\.|'(?!''))*)\'\'\'|"(?P<d>(?:[^"\\\n]|\\.)*)"|'(?P<s>(?:[^'\\\n]|\\.)*)'|`(?P<b>[^`\n]*)`|(?P<name>[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*)(?![\w+/=\-.@:$])|(?P<word>[^\s"'`,;(){}\[\]<>]+))""",
    re.A | re.S,
)
_JOIN = re.compile(r"[ \t]*\+[ \t]*(?=[\"'`A-Za-z_$])|[ \t]+\.\.?[ \t]+(?=[\"'`A-Za-z_$])")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_PLACEHOLDER = re.compile(r"(?:\$[({].*|\{\{.*|%\(.*|<.*|x+|\*+|\.+|null|none|true|false|changeme|example|your.*|todo|placeholder|undefined)$", re.I)

#: kind ("name" or "literal"), value, start, end
Term = tuple[str, str, int, int]


def base_spans(text: str, signs: list[int]) -> list[tuple[str, int, int]]:
    """The plain patterns' spans. ``signs`` are the places of ``:`` and ``=``: every assignment match has
    one right after its keyword, so only those places are tried, from left to right."""
    spans, end = [], 0
    for at in signs:
        blanks = at
        while blanks and text[blanks - 1] == " ":
            blanks -= 1
        near = text[max(0, blanks - 9) : blanks]  # the longest keyword and a quote
        keyword = _KEYWORD_LEFT.search(near)
        if not keyword:
            continue
        start = blanks - len(near) + keyword.start()
        match = ASSIGN.match(text, start) if start >= end else None
        if match:
            end = match.end()
            if len(match[2]) >= LEAST_ASSIGN:
                spans.append(("assign", start, end))
    spans += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    spans += [("hex", *m.span()) for m in HEX.finditer(text)]
    return spans


def name_score(name: str) -> float:
    words = [w.lower() for w in _WORDS.findall(name)]
    joined = words + [a + b for a, b in zip(words, words[1:])]
    return max((SENSITIVE.get(w, 0.0) for w in joined), default=0.0)


def literal_score(value: str) -> float:
    """Strength from 0 to 1: length and entropy; placeholders are no secrets, prose hardly one."""
    if len(value) < LEAST_LITERAL or _PLACEHOLDER.match(value):
        return 0.0
    n = len(value)
    bits = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    return min(1.0, bits / 3.0) * min(1.0, 0.5 + n / 16) * (0.3 if any(c.isspace() for c in value) else 1.0)


def assignments(text: str) -> Iterator[tuple[str, list[Term]]]:
    """(name, terms) in text order.

    A name lies between its sign and the sign before the last one (which may belong to a type), on one
    line. An unquoted value reaches to the end of its run; signs within that run get what lies before the
    next sign. So every stretch of text is looked at a fixed number of times.
    """
    signs = [m.span() for m in _SIGN.finditer(text)]
    line = run_end = 0
    for i, (start, end) in enumerate(signs):
        line = max(line, text.rfind("\n", signs[i - 1][1] if i else 0, start) + 1)
        if start == 0 or text[start - 1] in _NOT_BEFORE:
            continue
        name = _NAME_LEFT.match(text[max(line, signs[i - 2][1] if i > 1 else 0) : start][::-1])
        if not name:
            continue
        stop = signs[i + 1][0] if end < run_end and i + 1 < len(signs) else len(text)
        terms: list[Term] = []
        at = end
        while term := _TERM.match(text, at, stop):
            kind = term.lastgroup
            terms.append(("name" if kind == "name" else "literal", term[kind], *term.span(kind)))
            at = term.end()
            if kind == "word":
                run_end = max(run_end, at)
            join = _JOIN.match(text, at, stop) if kind != "word" else None
            if not join:
                break
            at = join.end()
        if terms:
            yield name[1][::-1], terms


def literals(text: str) -> dict[tuple[int, int], tuple[float, str]]:
    """Span -> (score, name) of every literal that reaches a sensitive name."""
    found: dict[tuple[int, int], tuple[float, str]] = {}
    # A constant is made of each span once, however often it is put into itself.
    constants: dict[str, dict[Term, None]] = {}
    for name, terms in assignments(text):
        grows = terms[0][0] == "name" and terms[0][1] == name and name in constants
        pieces: dict[Term, None] = constants[name] if grows else {}
        for term in terms[grows:]:
            if term[0] == "literal":
                pieces[term] = None
            elif term[1] in constants:
                pieces.update(constants[term[1]])
            elif any(c.isdigit() for c in term[1]):
                pieces[term] = None  # an unquoted value of configuration syntax
        constants[name] = pieces
        weight = name_score(name)
        score = weight * literal_score("".join(p[1] for p in pieces)) if weight else 0.0
        if score >= LEAST_SCORE:
            for _, _, start, end in pieces:
                if end > start and found.get((start, end), (0.0, ""))[0] < score:
                    found[start, end] = (score, name)
    return found


def spans_of(text: str) -> list[dict]:
    """All spans of one text by start, then kind as listed."""
    signs = [m.start() for m in re.finditer("[:=]", text)]
    rows = [(start, KINDS.index(kind), end, None, None) for kind, start, end in base_spans(text, signs)]
    if signs:
        rows += [(start, KINDS.index("literal"), end, score, name) for (start, end), (score, name) in literals(text).items()]
    return [{"kind": KINDS[kind], "start": start, "end": end, "score": score, "name": name} for start, kind, end, score, name in sorted(rows, key=lambda r: r[:3])]


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("name", pa.string())]))


def scan_secrets(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """One row per document: its id as ``doc_id`` and ``spans``, an array of struct<kind, start, end, score, name>.

    Positions count code points, the end is exclusive. ``assign``, ``access`` and ``hex`` are the plain
    patterns; ``literal`` spans come from the lexer, with their score and the name that gave it.

    A null text is empty and has no spans; a null id is kept. Repeated rows are scanned each on its own,
    texts of any length whole. No rows give no rows. Other columns are not read.
    """
    picked = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    id_type = picked.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = pa.array([spans_of(t) for t in batch.column("text").to_pylist()], type=_SPANS)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), spans], names=["doc_id", "spans"])

    schema = f"doc_id {id_type}, spans array<struct<kind: string, start: int, end: int, score: double, name: string>>"
    return picked.mapInArrow(scan, schema)


def mask_secrets(text: str, spans: list[tuple[int, int]], mark: str = "[secret]") -> str:
    """``text`` with each stretch covered by spans replaced by ``mark`` once."""
    out, at = [], 0
    for start, end in sorted(spans):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]
