"""Secret scans by assignment-aware lexing.

Base patterns find assignments to a few telling words, access keys and long hexadecimal runs. Beyond
them a lexer reads the text as source or configuration: at each assignment sign it takes the name on
the left (several before an equals sign take several values) and the value on the right: a quoted literal,
over several lines in three quotes, a bare one, or names and literals joined by plus signs or standing side
by side, in brackets too. Names in braces of formatted literals count as joined. The text of an element is
assigned to its tag. Names stand for what was last assigned to them: an assignment is a node that links
back to the nodes of the names it reads, and names' sensitivities flow back along the links once the text is
read, so the work grows with the text however often constants are joined. A literal is a secret where the
sensitivity of a name that it reaches times the randomness of the literal is high enough. So
``K = "x9…"; cfg.db_pwd = K`` marks the literal.

Defined results: a null text is empty; spans count code points, the end exclusive; a text without
findings has an empty list and the hash of the empty string; rows are scanned one by one, so repeated
rows get equal results, and an empty table none; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
import string
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")

#: Words of names, and how much each tells. Names are lower-cased and split into words.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "pass": 0.9, "passphrase": 1.0, "pin": 0.6, "secret": 1.0, "token": 1.0,
    "apikey": 1.0, "credential": 1.0, "credentials": 1.0, "cred": 0.9, "creds": 0.9, "auth": 0.8, "bearer": 0.9,
    "authorization": 0.9, "jwt": 0.9, "oauth": 0.8, "privatekey": 1.0, "accesskey": 1.0, "secretkey": 1.0, "signature": 0.6,
    "salt": 0.6, "cookie": 0.6, "session": 0.5, "dsn": 0.6, "key": 0.5,
}
#: Words that make a "key" a secret one.
KEY_OF = frozenset(("access", "account", "api", "auth", "client", "deploy", "encryption", "master", "private", "secret", "service", "signing", "ssh", "storage"))
#: What stands where a secret is to be put.
PLACEHOLDERS = re.compile(r"(?i)change.?me|example|placeholder|dummy|sample|your[_-]|x{4,}|\*{3,}|\.{3,}|^(none|null|nil|true|false|undefined|todo|test)$|^[$%<{]|^(.)\2*$")
SIGN = re.compile(r"=>|:=|(?<![=!<>:+*/|&^%-])=(?![=>~])|:(?![:/=])")
NAME = re.compile(r"""([A-Za-z_][A-Za-z0-9_.\-]*)[?!]?(?:["'`]?\]?)[ \t]*$""")
#: A term of a value: a literal in three quotes, in one, or in backticks; a name; or a bare literal.
TERM = re.compile(
    r"""[rbufRBUF]{0,2}(?:\"{3}((?:[^"\\]|\\.|"(?!""))*)"{3}|'{3}((?:[^'\\]|\\.|'(?!''))*)'{3}|"((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)'|`((?:[^`\\]|\\.)*)`)"""
    r"""|([A-Za-z_][A-Za-z0-9_.]*)(?![A-Za-z0-9+/_=~$!@#%^&*-])|([^\s"'`,;()\[\]{}<>]+)""",
    re.DOTALL,
)
BLANKS, ANY_BLANKS, OPEN = re.compile(r"[ \t]*"), re.compile(r"(?:\s|\\\n)*"), re.compile(r"\(\s*(?=[rbufRBUF]{0,2}[\"'])")
HELD = re.compile(r"\{([A-Za-z_][A-Za-z0-9_.]*)\}")
BEFORE = re.compile(r"([A-Za-z_][A-Za-z0-9_.]*)[ \t]*,[ \t]*$")
ELEMENT = re.compile(r"<([A-Za-z_][A-Za-z0-9_.:-]*)(?:\s[^<>]*)?>([^<>]*)</\1\s*>")
IN_NAME = frozenset(string.ascii_letters + string.digits + "_.-")
#: A type between a colon and an equals sign: names with paths, lifetimes and arguments in brackets, and unions of such.
ATOM = r"""(?:&[ \t]*)?(?:'[A-Za-z_]+[ \t]+)?(?:(?:mut|dyn|impl|readonly)[ \t]+)?(?:["']?[A-Za-z_][A-Za-z0-9_.:]*["']?(?:[<\[][^\n=;(){}]{0,96}[>\]])?|\[[^\n=(){}]{0,96}\])(?:\[\])*[?!]?"""
TYPE = re.compile(rf"[ \t]*{ATOM}(?:[ \t]*[|&][ \t]*{ATOM}){{0,8}}[ \t]*(?==(?![=>~]))")
#: What is read before a sign at a time; a name that fills it is read to its start.
LOOK = 128
THRESHOLD = 0.5


def name_weight(name: str) -> float:
    words = [w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+", name)]
    joined = {a + b for a, b in zip(words, words[1:], strict=False)}
    weight = max([0.0, *(SENSITIVE[w] for w in {*words, *joined} & SENSITIVE.keys())])
    return 1.0 if "key" in words and KEY_OF & {*words} else weight


def literal_weight(literal: str) -> float:
    """0 to 1: length and entropy, with a share for mixed kinds of characters; placeholders and words weigh nothing."""
    if len(literal) < 6 or PLACEHOLDERS.search(literal) or " " in literal and len(literal.split()) > 3:
        return 0.0
    n = len(literal)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(literal).values())
    kinds = sum(bool(re.search(x, literal)) for x in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    if kinds == 1 and literal.isalpha():
        return min(1.0, entropy / 4) * 0.4
    return min(1.0, entropy / 3) * min(1.0, 0.4 + 0.2 * kinds + n / 80)


def name_before(text: str, end: int) -> tuple[str, int] | None:
    """The name that ends where a sign begins, and its start."""
    low = max(0, end - LOOK)
    found = NAME.search(text, low, end)
    if not found:
        return None
    start = found.start(1)
    if start == low:
        while start > 0 and text[start - 1] in IN_NAME:
            start -= 1
        while not (text[start].isalpha() or text[start] == "_"):
            start += 1
    return text[start : found.end(1)], start


def value_at(text: str, at: int) -> tuple[list[tuple[int, int]], list[str], int]:
    """Spans of the literals of the value that begins there, the names it reads, and its end."""
    spans: list[tuple[int, int]] = []
    names: list[str] = []
    at = BLANKS.match(text, at).end()
    bracket = OPEN.match(text, at)
    blanks, at = (ANY_BLANKS, bracket.end()) if bracket else (BLANKS, at)
    end, quoted, joined = at, False, True
    while term := TERM.match(text, at):
        kind = term.lastindex
        if not joined and not (quoted and kind <= 5):
            break  # only quoted literals join by standing side by side
        if kind == 6:
            if text[term.end() : term.end() + 1] in ("(", "["):
                break  # a call or a lookup, not a literal
            names.append(term[6])
        spans.append(term.span(kind))
        if kind <= 5 and (kind == 5 or "f" in text[term.start() : term.start(kind)].lower()):
            names += HELD.findall(term[kind])
        end, quoted = term.end(), kind <= 5
        at = blanks.match(text, end).end()
        joined = text.startswith("+", at)
        if joined:
            at = blanks.match(text, at + 1).end()
    return spans, names, end


def assigned_literals(text: str) -> dict[tuple[int, int], float]:
    """Literals by span, with the greatest weight of the names that they reach, directly or through constants.

    Where a type stands between name and sign, the name before the colon is assigned to. As "log: auth=..."
    looks the same, the word before the sign is told as well, but is no constant.
    """
    constants: dict[str, int] = {}
    weights: list[float] = []
    reads: list[set[int]] = []
    literals: list[list[tuple[int, int]]] = []

    def assign(names: list[str], spans: list[tuple[int, int]], read: list[str]) -> None:
        known = {constants[x] for x in read if x in constants}
        own = [x for x in spans if text[x[0] : x[1]] not in constants]  # a bare word that is a constant stands for it
        if names and (own or known):
            constants[names[0]] = len(weights)
            weights.append(max(map(name_weight, names)))
            reads.append(known)
            literals.append(own)

    typed, owner = -1, ""
    for sign in SIGN.finditer(text):
        found = name_before(text, sign.start())
        if found and sign[0] == ":" and (kind := TYPE.match(text, sign.end())):
            typed, owner = kind.end(), found[0]
            continue
        names = [owner] * (sign.start() == typed) + ([found[0]] if found else [])
        if not names:
            continue
        spans, read, end = value_at(text, sign.end())
        if found and sign[0] == "=" and text.startswith(",", BLANKS.match(text, end).end()):
            targets, start = [names[-1]], found[1]
            while (more := BEFORE.search(text, max(0, start - LOOK), start)) and len(targets) < LOOK:
                targets.append(more[1])
                start = more.start(1)
            values = [(spans, read)]
            while len(values) < len(targets) and text.startswith(",", at := BLANKS.match(text, end).end()):
                *value, end = value_at(text, at + 1)
                values.append(tuple(value))
            if len(values) == len(targets) > 1:
                for target, value in zip(reversed(targets), values, strict=True):
                    assign([target], *value)
                continue
        assign(names, spans, read)
    if "</" in text:
        for m in ELEMENT.finditer(text):
            inner = m[2].strip()
            start = m.start(2) + m[2].find(inner)
            assign([m[1]], [(start, start + len(inner))] if inner else [], [inner])
    best: dict[tuple[int, int], float] = {}
    for k in range(len(weights) - 1, -1, -1):
        for span in literals[k]:
            best[span] = max(best.get(span, 0.0), weights[k])
        for older in reads[k]:
            weights[older] = max(weights[older], weights[k])
    return best


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by the base patterns."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and those with the method's added, both in order; literals inside a base span are not told twice."""
    base = sorted(base_spans(text))
    more = set()
    if "=" in text or ":" in text or "</" in text:
        for (start, end), weight in assigned_literals(text).items():
            if weight >= THRESHOLD and weight * literal_weight(text[start:end]) >= THRESHOLD and not any(a <= start and end <= b for a, _, b in base):
                more.add((start, 3, end))
    return base, sorted(base + list(more))


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_spans and spans (kind:start:end, comma-joined)."""
    fields = [("n_assign", T.LongType()), ("n_access", T.LongType()), ("n_hex", T.LongType()), ("base_spans", T.StringType()), ("spans", T.StringType())]
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *(T.StructField(*x) for x in fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1):
                base, spans = scan(text.as_py() or "")
                n = Counter(k for _, k, _ in base)
                out.append((n[0], n[1], n[2], listed(base), listed(spans)))
            columns = zip(*out, strict=True) if out else [()] * 5
            types = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(columns, types, strict=True))], names=schema.names)

    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")).mapInArrow(run, schema)


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
