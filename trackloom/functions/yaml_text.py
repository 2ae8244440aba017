"""YAML of configurations as flat maps with dotted keys, and back."""

from __future__ import annotations

import re

_KEY = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s#:'"\[\]{},&*!|>%@-][^:#]*?|-[^\s:][^:#]*?)\s*:(?=\s|$)""")
_DOCUMENT = re.compile(r"^---(?:[ \t]+|$)", re.M)
_PLAIN = re.compile(r"[A-Za-z0-9_./+-][A-Za-z0-9_./+\- ]*")


def _bare(line: str) -> str:
    """The line without its comment."""
    quote = None
    for i, c in enumerate(line):
        if quote:
            quote = None if c == quote and (quote == "'" or line[i - 1] != "\\") else quote
        elif c in "\"'" and (i == 0 or line[i - 1] in " \t[{,:-"):
            quote = c
        elif c == "#" and (i == 0 or line[i - 1] in " \t"):
            return line[:i].rstrip()
    return line.rstrip()


def _scalar(text: str) -> str | None:
    if len(text) > 1 and text[0] == text[-1] == '"':
        return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), text[1:-1])
    if len(text) > 1 and text[0] == text[-1] == "'":
        return text[1:-1].replace("''", "'")
    return None if text in ("~", "null", "Null", "NULL", "") else text


def _parts(text: str) -> list[str]:
    """What stands between commas outside quotes and brackets."""
    out, depth, quote, start = [], 0, None, 0
    for i, c in enumerate(text):
        if quote:
            quote = None if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "[{":
            depth += 1
        elif c in "]}":
            depth -= 1
        elif c == "," and not depth:
            out.append(text[start:i].strip())
            start = i + 1
    last = text[start:].strip()
    return [*out, last] if last or out else []


def _put(out: dict, path: tuple, text: str) -> None:
    """The value of a path, a scalar or a list or map on one line, in place of what the path had."""
    name = ".".join(path)
    for old in [k for k in out if k == name or k.startswith(name + ".")]:
        del out[old]
    if text[:1] == "[" and text[-1:] == "]":
        for i, part in enumerate(_parts(text[1:-1])):
            _put(out, (*path, str(i)), part)
    elif text[:1] == "{" and text[-1:] == "}":
        for part in _parts(text[1:-1]):
            key, _, value = part.partition(":")
            _put(out, (*path, _scalar(key.strip()) or ""), value.strip())
    else:
        out[name] = _scalar(text)


def documents(text: str) -> list[str]:
    """The documents of a YAML text, which lines that begin with --- part. Of several, those without content are left out."""
    parts = _DOCUMENT.split(text.replace("\r\n", "\n"))
    if len(parts) > 1:
        parts = [p for p in parts if any(_bare(line).strip() not in ("", "...") for line in p.splitlines())] or parts[:1]
    return parts


def flat(text: str) -> dict[str, str | None]:
    """Every scalar of a YAML text by its dotted key; items of a list are numbered from 0.

    Blocks by indentation, lists, lists and maps on one line, quotes, comments and block texts (| and >)
    are read; of keys that repeat the last counts; ~, null and nothing are None. Anchors and tags are
    not known; several documents are taken apart first, see documents().
    """
    out: dict[str, str | None] = {}
    stack: list[tuple[int, tuple, bool]] = []  # indentation, path, whether it is a list's item
    counts: dict[tuple, int] = {}
    waiting: tuple[int, tuple] | None = None  # a key without a value so far
    lines = text.splitlines()
    at = 0
    while at < len(lines):
        line = _bare(lines[at])
        at += 1
        if not line.strip() or line.strip() in ("---", "..."):
            continue
        indent = len(line) - len(line.lstrip())
        rest = line.strip()
        while rest == "-" or rest.startswith("- "):
            while stack and (stack[-1][0] > indent or (stack[-1][0] == indent and stack[-1][2])):
                stack.pop()
            if waiting and waiting[0] <= indent:
                stack.append((waiting[0], waiting[1], False))
                counts[waiting[1]] = 0
                _put(out, waiting[1], "")
                out.pop(".".join(waiting[1]), None)
            waiting = None
            above = stack[-1][1] if stack else ()
            n = counts.get(above, 0)
            counts[above] = n + 1
            stack.append((indent, (*above, str(n)), True))
            inner = rest[1:]
            indent += 1 + len(inner) - len(inner.lstrip())
            rest = inner.strip()
        if not rest:
            continue
        m = _KEY.match(rest)
        while stack and stack[-1][0] >= indent:
            stack.pop()
        if waiting:
            if m and indent > waiting[0]:
                _put(out, waiting[1], "")
                out.pop(".".join(waiting[1]), None)
                stack.append((waiting[0], waiting[1], False))
            waiting = None
        path = stack[-1][1] if stack else ()
        if not m:
            if stack and stack[-1][2]:
                _put(out, path, rest)
            continue
        key = (*path, _scalar(m[1]) or "")
        value = rest[m.end() :].strip()
        if re.fullmatch(r"[|>][+-]?", value):
            block = []
            while at < len(lines) and (not lines[at].strip() or len(lines[at]) - len(lines[at].lstrip()) > indent):
                block.append(lines[at])
                at += 1
            while block and not block[-1].strip():
                block.pop()
            least = min((len(b) - len(b.lstrip()) for b in block if b.strip()), default=0)
            _put(out, key, "")
            out[".".join(key)] = ("\n" if value[0] == "|" else " ").join(b[least:] for b in block)
        else:
            _put(out, key, value)
            waiting = (indent, key) if not value else None
    return out


def _quoted(value: str | None) -> str:
    if value is None:
        return "null"
    if _PLAIN.fullmatch(value) and value == value.strip() and value not in ("null", "Null", "NULL", "---", "...") and not value.startswith("- "):
        return value
    escaped = value.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\t", "\\t")
    return f'"{escaped}"'


def nested_text(config: dict[str, str | None]) -> str:
    """The YAML text of a flat map: flat() gives it back, but for empty lists and maps."""
    tree: dict = {}
    for name, value in config.items():
        node = tree
        *above, last = name.split(".")
        for part in above:
            node = node.setdefault(part, {})
        node[last] = value

    def lines(node: dict, indent: str):
        numbered = sorted(node, key=lambda k: int(k) if k.isdigit() else -1) if set(node) == {str(i) for i in range(len(node))} else None
        for key in numbered or node:
            head = f"{indent}-" if numbered else f"{indent}{_quoted(key)}:"
            if isinstance(node[key], dict):
                yield head
                yield from lines(node[key], indent + "  ")
            else:
                yield f"{head} {_quoted(node[key])}"

    return "\n".join(lines(tree, "")) + "\n" if tree else ""
