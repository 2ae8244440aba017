"""Secret scans by assignment-aware lexing.

Three base patterns find secrets by their shape. Beside them, a lexer reads source and
configuration syntax into name-literal pairs (name = "x", name: x, "name": "x", name := 'x',
name => "x", --name=x, a["name"] = "x", name: type = "x"; strings with a prefix or three quotes
too), folds literals joined by +, propagates constants (KEY = "x" ... password = KEY) and scores
each literal by the sensitive words of the names it reaches and by its own shape. Literals that
score enough add spans of kind "lexed".

The lexer takes time and memory in proportion to the text. Bare words, which may hold many more
assignments, are offsets into the text: those that end at one place are rated together, from the
last start to the first, and each character adds to running sums once.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame

from trackloom.llm.common import map_texts

KINDS = ("assign", "access", "hex", "lexed")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")

OPERATOR = re.compile(r"[ \t]*(:=|=>|==|!=|<=|>=|[=:])")
NAME_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_.-")
PREFIX = r"(?:[bBrRfFuU]{1,2}|[@$L]{1,2})"
#: A prefix; then what stands in three quotes, if it is one word, or in one pair.
QUOTED = re.compile(
    rf"""[ \t]*({PREFIX})?(?:"{{3}}\s*((?:[^\s\\"]|\\.|"(?!""))++)\s*"{{3}}|'{{3}}\s*((?:[^\s\\']|\\.|'(?!''))++)\s*'{{3}}"""
    r"""|"((?:[^"\\\n]|\\.)*+)"|'((?:[^'\\\n]|\\.)*+)')"""
)
BLANKS = re.compile(r"[ \t]*")
BARE = re.compile(r"""[^\s"',;(){}\[\]<>]+""")
PLUS = re.compile(rf"[ \t]*\+[ \t]*(?={PREFIX}?[\"'])")
INSIDE = r"""[^\[\]<>=\n"']"""
NESTED = rf"[\[<](?:{INSIDE}|[\[<](?:{INSIDE}|[\[<]{INSIDE}*+[\]>])*+[\]>])*+[\]>]"
TERM = rf"(?:[&*](?:'\w+[ \t]+)?)?(?:mut[ \t]+)?[A-Za-z_][\w.]*+(?:{NESTED})*+"
#: A type between name: and =, which has a space before it or a quoted literal behind.
TYPED = re.compile(rf"[ \t]*{TERM}(?:[ \t]*\|[ \t]*{TERM})*+(?:[ \t]+(?==(?![=>~]))|[ \t]*(?==[ \t]*{PREFIX}?[\"']))")
FIELDS = re.compile(r"(?:\{[^{}]*\})+")
IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")

#: Parts of names, alone or in a row, and how sensitive what they name is.
SENSITIVE = {
    "password": 3, "passwd": 3, "passphrase": 3, "pwd": 3, "pass": 2, "secret": 3, "token": 3,
    "apikey": 3, "api key": 3, "private key": 3, "access key": 3, "secret key": 3, "signing key": 3,
    "encryption key": 3, "auth key": 3, "account key": 3, "client secret": 3, "credential": 3,
    "credentials": 3, "auth": 2, "bearer": 2, "authorization": 2, "cookie": 1, "key": 1, "salt": 1,
}
#: Literals that stand for a secret that is elsewhere, in lower case, and how others begin.
PLACEHOLDERS = frozenset(("none", "null", "true", "false", "changeme", "change_me", "example", "placeholder", "redacted", "todo", "test"))
PLACEHOLDER_STARTS = ("your_", "your-", "$", "%", "{{")
FILLERS = ("x", "*", ".")
THRESHOLD = 5


def name_score(name: str) -> int:
    parts = [p.lower() for p in PART.findall(name)]
    runs = {" ".join(parts[i : i + n]) for n in (1, 2) for i in range(len(parts) - n + 1)}
    return max((SENSITIVE.get(r, 0) for r in runs), default=0)


_LOWER, _UPPER, _DIGIT = "abcdefghijklmnopqrstuvwxyz".__contains__, "ABCDEFGHIJKLMNOPQRSTUVWXYZ".__contains__, "0123456789".__contains__


class _Characters:
    """How often characters occur, with the sums that a score needs, so that each character is met once
    however many literals end at one place."""

    __slots__ = ("count", "n", "k_log_k", "classes", "blank")

    def __init__(self):
        self.count: dict[str, int] = {}
        self.n, self.k_log_k, self.classes, self.blank = 0, 0.0, set(), False

    def add(self, part: str) -> None:
        self.n += len(part)
        for c, more in Counter(part).items():
            before = self.count.get(c, 0)
            now = self.count[c] = before + more
            self.k_log_k += now * math.log2(now)
            if before:
                self.k_log_k -= before * math.log2(before)
            else:
                self.classes.add("lower" if _LOWER(c) else "upper" if _UPPER(c) else "digit" if _DIGIT(c) else "other")
                self.blank |= c.isspace()

    def score(self, head: str, last: str) -> int:
        """0 for what can't be a secret; up to 4 for length, mixed classes and entropy. head: the
        literal's first 16 characters; last: its last one."""
        low = head.lower()
        if self.n < 8 or (self.n <= len(head) and low in PLACEHOLDERS) or low.startswith(PLACEHOLDER_STARTS) or (low[0] == "<" and last == ">"):
            return 0
        if self.blank or (len(self.count) <= 2 and "".join(sorted(set("".join(self.count).lower()))) in FILLERS):
            return 0
        entropy = math.log2(self.n) - self.k_log_k / self.n
        return (self.n >= 12) + (self.n >= 20) + (len(self.classes) >= 2) + (entropy >= 3.0 - 1e-9)


def literal_score(literal: str) -> int:
    """0 for what can't be a secret; up to 4 for length, mixed classes and entropy."""
    if not literal:
        return 0
    seen = _Characters()
    seen.add(literal)
    return seen.score(literal[:16], literal[-1:])


def _name_before(text: str, end: int) -> str:
    """The name that ends there: a quoted subscript is the name, other subscripts belong to it."""
    behind: list[str] = []
    while end and text[end - 1] == "]":
        quoted = end > 1 and text[end - 2] in "\"'"
        last = start = end - 1 - quoted
        while start and text[start - 1] in NAME_CHARS:
            start -= 1
        head = start - quoted
        if head < 1 or text[head - 1] != "[" or (quoted and text[head] != text[last]):
            return ""
        if quoted:
            return text[start:last].lstrip("-.0123456789")
        behind.append(text[start:last])
        end = head - 1
    if end and text[end - 1] in "\"'":
        end -= 1
    start = end
    while start and text[start - 1] in NAME_CHARS:
        start -= 1
    name = text[start:end].lstrip("-.0123456789")
    return name and ".".join([name, *reversed(behind)])


def _quoted(m: re.Match) -> tuple[str, int, int, bool]:
    """Its value, start and end, and whether it has one pair of quotes and no prefix."""
    group = next(g for g in range(2, 6) if m[g] is not None)
    fields = "f" in (m[1] or "").lower() and FIELDS.fullmatch(m[group])  # holds no text of its own
    return "" if fields else m[group], m.start(group), m.end(group), group in (4, 5) and not m[1]


def assignments(text: str) -> Iterator[tuple[str, str | None, int, int]]:
    """(name, value, start, end) in order. Adjacent quoted literals joined by + are one. The value of a
    bare word is None: it is the text from start to end."""
    at, run, stripped = 0, (0, 0), 0  # run: where the last bare word began and ended; stripped: where without marks
    typed: tuple[int, str] | None = None
    for mark in re.finditer("[=:]", text):
        i = mark.start()
        if i < at:
            continue
        if text[i] == "=" and i and text[i - 1] in ":!<>=":
            j = i - 1
        else:
            j = i
        op = OPERATOR.match(text, j)
        if op[1] in ("==", "!=", "<=", ">="):
            continue
        end = j
        while end and text[end - 1] in " \t":
            end -= 1
        if op[1] == ":" and end and text[end - 1] in "?!":
            end -= 1
        name = _name_before(text, end)
        if name and op[1] == ":" and (kind := TYPED.match(text, op.end())):
            typed, at = (kind.end(), name), kind.end()
            continue
        names = [name] if name else []
        if typed and typed[0] == i:  # the type's own name counts where it is sensitive, as in "note: password = ..."
            names = [typed[1], *(n for n in names if name_score(n))]
        if not names:
            continue
        if lit := QUOTED.match(text, op.end()):
            value, first, last, plain = _quoted(lit)
            values, stop = [value], lit.end()
            while (plus := PLUS.match(text, stop)) and (more := QUOTED.match(text, plus.end())):
                added, _, last, one = _quoted(more)
                values.append(added)
                plain, stop = plain and one, more.end()
            value = "".join(values)
            yield from ((n, value, first, last) for n in names)
            at = stop if plain else first  # assignments within other strings count too
            continue
        first = BLANKS.match(text, op.end()).end()
        if not run[0] <= first < run[1]:
            if not (bare := BARE.match(text, first)):
                continue
            run = bare.span()
            stripped = run[1]
            while stripped > first and text[stripped - 1] in ".,;":
                stripped -= 1
        yield from ((n, None, first, max(first, stripped)) for n in names)
        at = op.end()


def lexed_spans(text: str) -> list[tuple[int, int]]:
    """Spans of the literals that sensitive names hold, themselves or through constants."""
    if "=" not in text and ":" not in text:
        return []
    constants: dict[str, tuple[str | None, int, int]] = {}
    names: dict[tuple[int, int], int] = {}
    literals: dict[tuple[int, int], str | None] = {}
    for name, value, start, end in assignments(text):
        if value is None and (word := IDENTIFIER.match(text, start, end)) and word.end() == end and word[0] in constants:
            value, start, end = constants[word[0]]  # a constant's name stands for its literal
        constants[name] = (value, start, end)
        if (score := name_score(name)) > names.get((start, end), 0):
            names[start, end], literals[start, end] = score, value
    found = []
    behind, counted, seen = -1, 0, _Characters()
    for start, end in sorted(names, key=lambda span: (span[1], -span[0])):  # by end; the shortest first
        value = literals[start, end]
        if value is not None:
            rated = literal_score(value)
        elif start == end:
            continue
        else:
            if end != behind:
                behind, counted, seen = end, end, _Characters()
            seen.add(text[start:counted])
            counted = start
            rated = seen.score(text[start : min(end, start + 16)], text[end - 1])
        if rated and names[start, end] + rated >= THRESHOLD:
            found.append((start, end))
    return sorted(found)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    spans = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    spans += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    return spans + [("hex", *m.span()) for m in HEX.finditer(text)]


def _joined(spans: list[tuple[str, int, int]]) -> str:
    order = {k: i for i, k in enumerate(KINDS)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], order[s[0]], s[2])))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_lexed.

    Spans are kind:start:end in code points, end exclusive, by start and then kind. Null and empty
    texts have none: base_sha256 is then that of the empty string. Repeated rows are scanned one by
    one and other columns are not read; an empty table gives no rows. Texts of any length are scanned
    whole, in time in proportion to it, unbroken ones too.
    """

    def rate(ids, texts):
        out = [[], [], [], [], [], []]
        for text in texts:
            base = base_spans(text := text or "")
            lexed = [("lexed", a, b) for a, b in lexed_spans(text)]
            count = Counter(s[0] for s in base)
            for column, value in zip(out, (count["assign"], count["access"], count["hex"], hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(base + lexed), len(lexed)), strict=True):
                column.append(value)
        return [ids, *out]

    return map_texts(docs, rate, "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_lexed bigint", id_col, text_col)
