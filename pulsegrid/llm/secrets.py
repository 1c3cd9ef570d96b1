"""Secret scans: base patterns, and assignment-aware lexing with constant propagation.

A text is lexed as source or configuration (strings, names, operators, brackets, tags).  Each
assignment gives a target name and a value: ``name = value`` and ``name: value`` with or without
a type, subscripts, keyword arguments, quoted keys, XML elements and attributes, calls that name
what they set, command line flags.  A value is a literal, several literals joined, or the name
of a constant, which stands for what that constant holds, defined before or after.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import defaultdict
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, text_or_empty

#: Kinds in the order that breaks ties of a start.
KINDS = ("assign", "access", "hex", "literal")
#: Fixed values of the base patterns: a sensitive name with its value, access key ids, hexadecimal runs.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST, ACCESS_LEAST = 12, 18

#: How much a part of a target name says about its value.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "pass": 0.8, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "credential": 0.9, "credentials": 0.9, "private": 0.6, "auth": 0.6, "key": 0.5, "access": 0.4, "api": 0.4, "signature": 0.5,
}
#: One of these is in every text with a sensitive name: all parts but those that hold a shorter one.
_SENSITIVE_BYTES = tuple(sorted(w.encode() for w in SENSITIVE if not any(v != w and v in w for v in SENSITIVE)))
_MARKS = (b"=", b":", b"(", b"</", b"--")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_PLACEHOLDER = re.compile(r"(?i)^(x+|\*+|\.+|none|null|true|false|todo|changeme|example.*|your.*|dummy.*|test|<.*>|\$\{?.*|%.*%|\{\{.*)$")
#: A literal is reported if the weight of its target name times its look reaches this.
REPORT = 0.45
LITERAL_LEAST = 8

#: Tokens of source and configuration.  A quote opens a string only where no word stands before it.
_TOKEN = re.compile(
    r'''(?P<str>(?<![\w\\])(?:[rbufRBUF]{1,2}|[@$])?(?:"""(?:[^\\"]|\\.|"(?!""))*+"""|\'\'\'(?:[^\\']|\\.|'(?!''))*+\'\'\''''
    r'''|"(?:[^"\\\n]|\\.)*+"|(?<![&<])'(?:[^'\\\n]|\\.)*+'|`(?:[^`\\]|\\.)*+`)|\\"(?:[^"\\\n]|\\[^"\n])*+\\")'''
    r"|(?P<life>(?<=[&<])'\w++)"
    r"|(?P<flag>(?<![\w-])--[A-Za-z][\w-]*+(?=[\x20\t]+[^\s=-]))"
    r"|(?P<name>[A-Za-z_$][\w$]*+(?:(?:[.-]|->|::)\w++)*+)"
    r"|(?P<cmp>[=!]==?|[<>]=|=~)"
    r"|(?P<op>:=|=>|<-|[+?|]*=|:)"
    r"|(?P<open>[(\[{<])|(?P<close>[)\]}>])|(?P<plus>\+|\.\.?)|(?P<comma>,)|(?P<end>[;\n])|(?P<mark>[&*?!|])",
    re.DOTALL,
)
_CLOSERS = {")": "(", "]": "[", "}": "{", ">": "<"}
_BARE = re.compile(r"""[^\s"',;#()\[\]{}<>&`]+""")
_BLOCK = re.compile(r"[|>][+-]?[\x20\t]*\n")
_ELEMENT = re.compile(r"<([A-Za-z_][\w.:-]*)(?:\s[^<>]*)?>([^<>]+)</\1\s*>")
#: Words that open a statement: what their colon ends is no type.  Declarations name type or target first.
_OPENERS = frozenset("if elif while case when not and or in is for with else try finally default do except return".split())
_DECLARES = frozenset(("const", "var"))
_PLAIN_TYPE = re.compile(r"(?:string|byte|rune|any|error|bool|u?int\d*|float\d+)\Z")
#: Calls that hand their literal on, calls that set what their first literal names, and fields of a name and its value.
_WRAPS = frozenset("str bytes string bytearray b64decode frombase64 atob fromhex unhexlify encode decode from quote secretstr securestring of strip trim buffer".split())
_SETS = re.compile(r"(?i)(?:^|[._>:])(?:set|put|add|define|with|use)\w*\Z")
_LOOKS_UP = re.compile(r"(?i)(?:^|[._>:])(?:get|env)\w*\Z")
_KEYS, _VALUES = frozenset(("name", "key", "id", "field", "variable")), frozenset(("value", "val", "content", "default", "stringvalue"))


def name_weight(name: str) -> float:
    """The weight of a target name: its parts' weights combined as independent hints, or 0 without a hint."""
    miss = 1.0
    for part in _PARTS.findall(name):
        miss *= 1 - SENSITIVE.get(part.lower(), 0.0)
    return 1 - miss


def look(literal: str) -> float:
    """How much a literal looks like a secret: length, entropy and mixed kinds of characters, 0 to 1."""
    if "PRIVATE KEY-----" in literal:
        return 1.0
    n = len(literal)
    if n < LITERAL_LEAST or any(c.isspace() for c in literal) or _PLACEHOLDER.match(literal):
        return 0.0
    counts = [literal.count(c) for c in set(literal)]
    bits = -sum(k / n * math.log2(k / n) for k in counts)
    kinds = sum(map(bool, (re.search("[a-z]", literal), re.search("[A-Z]", literal), re.search("[0-9]", literal), re.search("[^A-Za-z0-9]", literal))))
    return min(1.0, n / 16) * min(1.0, bits / 3.5) * (0.4 if kinds < 2 else 1.0)


def is_words(bare: str) -> bool:
    """Whether an unquoted value reads as an identifier: words of letters joined by points, underscores or capitals."""
    parts = _PARTS.findall(bare.rstrip("0123456789"))
    joined = any(c in "._-:/" for c in bare) or not any(c.isdigit() for c in bare)
    return joined and bool(parts) and all(p.isalpha() for p in parts) and sum(map(len, parts)) >= 3.5 * len(parts)


Span = tuple[int, int]


@dataclass
class Value:
    """What is assigned: spans of literals and names of constants, in order; ``bare``: an unquoted value, a literal unless it names a constant."""

    parts: list[Span | str] = field(default_factory=list)
    bare: Span | None = None


class Lexer:
    """Pairs of target names and values in a text, with all constants it defines."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.pairs: list[tuple[int, tuple[str, ...], Value]] = []
        self.constants: dict[str, list[tuple[int, Value]]] = defaultdict(list)
        todo = [(0, len(text))]
        while todo:  # strings may hold assignments themselves (commands, JSON, connection strings)
            todo += self._lex(*todo.pop())
        for m in _ELEMENT.finditer(text):
            s, e = self._trim(m.start(2), m.end(2))
            self.pairs.append((m.start(), (m[1],), Value([(s, e)])))
        for at, names, value in self.pairs:
            for name in names:
                self.constants[name.rsplit(".", 1)[-1]].append((at, value))
        for held in self.constants.values():
            held.sort(key=lambda x: x[0])

    def _trim(self, s: int, e: int) -> Span:
        part = self.text[s:e]
        return s + len(part) - len(part.lstrip()), e - len(part) + len(part.rstrip())

    def _lex(self, first: int, last: int) -> list[Span]:
        self.tokens = [(m.lastgroup, m.start(), m.end()) for m in _TOKEN.finditer(self.text, first, last)]
        self.last = last
        self.run = (0, 0, False)  # the unquoted run seen last, and whether it is the value of a sensitive name
        inner = [self._content(t) for t in self.tokens if t[0] == "str"]
        inner = [(s, e) for s, e in inner if ("=" in self.text[s:e] or ":" in self.text[s:e])]
        self.partner = self._brackets()
        targets, annotations = {}, set()
        for i, (kind, s, e) in enumerate(self.tokens):
            if kind == "op" and i and self.text[s:e] != ":":
                targets[i] = self._targets(i, annotations)
        named: tuple[int, str] | None = None
        for i, (kind, s, _) in enumerate(self.tokens):
            if kind == "op" and i and i not in annotations:
                names = targets.get(i) or self._targets(i, annotations)
                value = self._value(i + 1, names)
            elif kind == "flag":
                names = (self._word(i).lstrip("-"),)
                value = self._value(i + 1, names)
            elif kind == "open" and i and self.text[s] == "(" and self.tokens[i - 1][0] == "name":
                names, value = self._call(i)
            else:
                continue
            if not names or not (value.parts or value.bare):
                continue
            short = names[-1].lower()
            if short in _KEYS and len(value.parts) < 2:
                named = (i, value.parts[0] if value.parts and isinstance(value.parts[0], str) else self.text[slice(*(value.bare or value.parts[0]))])
            elif short in _VALUES and named and i - named[0] < 12:
                names = (*names, named[1])
            self.pairs.append((s, names, value))
        return inner

    def _brackets(self) -> dict[int, int]:
        """The opening bracket of each closing one."""
        out, stack = {}, []
        for i, (kind, s, _) in enumerate(self.tokens):
            if kind == "open":
                stack.append((self.text[s], i))
            elif kind == "close":
                want = _CLOSERS[self.text[s]]
                if want != "<":
                    while stack and stack[-1][0] == "<":
                        stack.pop()
                if stack and stack[-1][0] == want:
                    out[i] = stack.pop()[1]
        return out

    def _word(self, i: int) -> str:
        return self.text[self.tokens[i][1] : self.tokens[i][2]]

    def _content(self, token) -> Span:
        """What stands between the quotes of a string."""
        _, s, e = token
        while self.text[s] not in "\"'`":
            s += 1
        quote = self.text[s]
        wide = 3 if e - s >= 6 and self.text.startswith(quote * 3, s) else 1
        end = e - wide
        if self.text.startswith('\\"', token[1]):
            end -= 1
        return s + wide, max(s + wide, end)

    def _name(self, i: int) -> str:
        return self.text[slice(*self._content(self.tokens[i]))] if self.tokens[i][0] == "str" else self._word(i)

    def _targets(self, i: int, annotations: set[int]) -> tuple[str, ...]:
        """The names that the operator at token i may assign to; colons found to open a type are noted."""
        j = i - 1
        kind = self.tokens[j][0]
        first: tuple[str, ...] = ()
        if kind == "str":
            return (self._name(j),)
        if kind == "close" and self._word(j) == "]" and j in self.partner:
            at = self.partner[j]  # a subscript: the words in it, after what it is taken from
            words = [self._name(k) for k in range(at, j) if self.tokens[k][0] in ("str", "name")]
            base = [self._word(at - 1)] if at and self.tokens[at - 1][0] == "name" else []
            first = (".".join(base + words),) if words else ()
        op, space = self._word(i), self.tokens[i][1] > self.tokens[j][2]
        if op == ":":
            while j > 0 and self.tokens[j][0] == "mark":
                j -= 1
            return first or ((self._word(j),) if self.tokens[j][0] in ("name", "flag") else ())
        k, names = j, 0
        while k >= 0 and self.tokens[k][0] in ("name", "close", "mark", "life"):
            names += self.tokens[k][0] == "name"
            k = self.partner[k] - 1 if k in self.partner else k - 1 if self.tokens[k][0] != "close" else -1
        colon = k > 0 and self.tokens[k][0] == "op" and self._word(k) == ":" and names + len(first) > 0
        if colon and (space or self.text[self.tokens[i][2] : self.tokens[i][2] + 2].lstrip()[:1] in ('"', "'")):
            annotations.add(k)
            q = k - 1
            while q > 0 and self.tokens[q][0] == "mark":
                q -= 1
            opener = q > 0 and self.tokens[q - 1][0] == "name" and self._word(q - 1) in _OPENERS or self._word(q) in _OPENERS
            if not opener and self.tokens[q][0] == "name" and not (q and self.tokens[q - 1][0] == "cmp"):
                return (self._word(q),)
        if first or kind != "name":
            return first
        here, q = self._word(j), j - 1
        while q > 0 and self.tokens[q][0] in ("mark", "open", "close") and self._word(q) in "*[]":
            q -= 1
        if q >= 0 and self.tokens[q][0] == "name" and "\n" not in self.text[self.tokens[q][2] : self.tokens[j][1]]:
            declared = q > 0 and self.tokens[q - 1][0] == "name" and self._word(q - 1) in _DECLARES
            if _PLAIN_TYPE.match(here):
                return (self._word(q),)
            if declared:
                return (self._word(q), here)
        return (here,)

    def _value(self, i: int, names: tuple[str, ...] = ()) -> Value:
        """The value that begins at token i: literals and constants joined by signs of concatenation."""
        out, depth, at = Value(), 0, self.tokens[i - 1][2]
        while i < len(self.tokens):
            kind, s, e = self.tokens[i]
            if kind == "str":
                out.parts.append(self._trim(*self._content(self.tokens[i])))
            elif kind == "open" and self._word(i) == "(" and not out.parts:
                depth += 1
            elif kind == "end" and (depth or not out.parts) and i + 1 < len(self.tokens) and self.tokens[i + 1][0] in ("str", "end") and self.text[s] == "\n":
                pass
            elif kind == "name" and i + 1 < len(self.tokens) and self.tokens[i + 1][1:] == (e, e + 1) and self._word(i + 1) == "(":
                if self._word(i).rsplit(".", 1)[-1].lower() not in _WRAPS:
                    break
                i, depth = i + 1, depth + 1
            elif kind == "name" and (out.parts or self._whole(s, e)) and not (out.parts and self.tokens[i - 1][0] != "plus"):
                out.parts.append(self._word(i))
            elif kind == "plus" and out.parts and self.tokens[i - 1][0] in ("str", "name"):
                if self._word(i) == "." and self.tokens[i - 1][2] == s and i + 1 < len(self.tokens) and self.tokens[i + 1][0] == "name":
                    break  # a method of the value
            else:
                break
            i += 1
        if out.parts:
            if len(out.parts) == 1 and isinstance(out.parts[0], str):
                out.bare = self.tokens[i - 1][1:]
            return out
        while at < self.last and self.text[at] in " \t":
            at += 1
        if m := _BLOCK.match(self.text, at, self.last):
            return self._block(at, m.end())
        return self._run(at, names)

    def _run(self, at: int, names: tuple[str, ...]) -> Value:
        """An unquoted value; what is assigned inside the value of a sensitive name is part of that value."""
        first, end, taken = self.run
        if not first <= at < end:
            m = _BARE.match(self.text, at, self.last)
            if m is None:
                return Value()
            end, taken = m.end(), False
        if taken or self.text.startswith("(", end):
            return Value()
        self.run = (at, end, bool(names) and max(map(name_weight, names)) >= REPORT)
        return Value(bare=(at, end))

    def _block(self, at: int, first: int) -> Value:
        """The lines below a key that stand deeper than it."""
        line = self.text.rfind("\n", 0, at) + 1
        indent = len(self.text[line:at]) - len(self.text[line:at].lstrip())
        m = re.compile(rf"(?:[\x20\t]{{{indent + 1},}}[^\n]*\n?)+").match(self.text, first, self.last)
        return Value([self._trim(*m.span())]) if m else Value()

    def _whole(self, s: int, e: int) -> bool:
        """Whether a name ends where an unquoted value ends."""
        return e == self.last or _BARE.match(self.text, e, e + 1) is None

    def _call(self, i: int) -> tuple[tuple[str, ...], Value]:
        """A call that sets what it names: set_secret("..."), or put("secret", "...")."""
        name, n = self._word(i - 1), len(self.tokens)
        if i + 1 >= n or self.tokens[i + 1][0] != "str":
            return (), Value()
        sets = _SETS.search(name)
        if i + 3 < n and self.tokens[i + 2][0] == "comma" and (sets or _LOOKS_UP.search(name)):
            return (self._name(i + 1),), self._value(i + 3)
        return ((name,), self._value(i + 1)) if sets else ((), Value())

    def literal(self, value: Value, at: int) -> tuple[list[Span], str]:
        """The spans of the literals a value stands for, and what they say together.

        Constants are followed along chains: a name stands for its last value before, else its first one after,
        and for nothing where its chain comes back to it.
        An unquoted value that reads as an identifier is no literal.
        """
        spans, said, bare, seen = [], [], value.bare, set()
        todo = [(p, at) for p in reversed(value.parts)]
        while todo:
            part, at = todo.pop()
            if not isinstance(part, str):
                spans.append(part)
                said.append(self.text[slice(*part)])
                continue
            held = self.constants.get(part.rsplit(".", 1)[-1])
            if held is None or part in seen:
                continue
            seen.add(part)
            at, value = held[max(0, bisect_left(held, at, key=lambda x: x[0]) - 1)]
            bare = value.bare or bare
            todo += [(p, at) for p in reversed(value.parts)]
        if not spans and bare:
            word = self.text[slice(*bare)]
            return ([], "") if is_words(word) else ([bare], word)
        return spans, "".join(said)


def literals(text: str) -> list[Span]:
    """Spans of literals that reach a sensitive name, directly, joined with others, or through constants."""
    lexer = Lexer(text)
    best: dict[Span, float] = {}
    looks: dict[tuple[Span, ...], float] = {}
    for at, names, value in lexer.pairs:
        weight = max(map(name_weight, names))
        if weight >= REPORT:
            spans, said = lexer.literal(value, at)
            key = tuple(spans)
            if key not in looks:
                looks[key] = look(said)
            score = weight * looks[key]
            for s, e in spans:
                if e > s:
                    best[s, e] = max(best.get((s, e), 0.0), score)
    return sorted(s for s, score in best.items() if score >= REPORT)


def scan(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of all spans in code points, in order of start, then kind as listed."""
    low = text.encode("utf-8", "replace").lower()
    out = []
    if any(w in low for w in _ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    if any(w in low for w in _SENSITIVE_BYTES) and any(m in low for m in _MARKS):
        out += [(s, 3, e) for s, e in literals(text)]
    return [(s, KINDS[k], e) for s, k, e in sorted(out)]


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Secrets in the whole text of each document (doc_id, text, ...), one row per input row.

    Returns doc_id, n_assign, n_access, n_hex, base_sha256 (over the spans of these kinds as
    kind:start:end) and spans, which also holds the literals found by lexing.  Null text is
    empty text and has no spans; an empty table gives an empty result.  Each row is scanned on
    its own: repeated rows give repeated results, other columns are not read.  Time and memory
    grow in proportion to a text, however long, but for chains of constants joined to others.
    """
    arrow_batches(docs.sparkSession)
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"

    def run(batches):
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                found = scan(text)
                kinds = [k for _, k, _ in found]
                base = ",".join(f"{k}:{s}:{e}" for s, k, e in found if k != "literal")
                rows.append((*(kinds.count(k) for k in KINDS[:3]), hashlib.sha256(base.encode()).hexdigest(), ",".join(f"{k}:{s}:{e}" for s, k, e in found)))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            types = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], [c.split()[0] for c in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(run, schema)
