"""Tokens of the brace dialects (JavaScript, TypeScript, TSX, PHP, Go).

Positions are characters; strings are one token each, comments are dropped.  What a template, an interpolated
string or a JSX child computes stands between `{{` and `}}` tokens, so that braces of code stay balanced.  JSX tags with
a capital first letter are `jsx` tokens.
"""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(slots=True)
class Token:
    kind: str  # name, qname, var, num, str, regex, jsx, op, html
    text: str
    start: int
    end: int
    value: str | None = None  # of a string without interpolation


_NAME = {"js": re.compile(r"#?[A-Za-z_$\u0080-\U0010ffff][\w$\u0080-\U0010ffff]*"), "php": re.compile(r"\\?[A-Za-z_\u0080-\U0010ffff][\w\u0080-\U0010ffff]*(?:\\[A-Za-z_\u0080-\U0010ffff][\w\u0080-\U0010ffff]*)*"), "go": re.compile(r"[A-Za-z_\u0080-\U0010ffff][\w\u0080-\U0010ffff]*")}
_NUMBER = re.compile(r"0[xXbBoO][\da-fA-F_]+n?|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?n?|\.\d+(?:[eE][+-]?\d+)?")
_OPS = {
    "js": ("...", "=>", "?.", "===", "!==", "**=", "&&=", "||=", "??=", "==", "!=", "<=", ">=", "&&", "||", "??", "++", "--", "+=", "-=", "*=", "/=", "%=", "|=", "&=", "^="),
    "php": ("?->", "->", "::", "=>", "...", "===", "!==", "<=>", "==", "!=", "<=", ">=", "&&", "||", "??=", "??", "++", "--", ".=", "+=", "-=", "*=", "/="),
    "go": (":=", "...", "&^=", "<<=", ">>=", "==", "!=", "<=", ">=", "&&", "||", "<-", "++", "--", "+=", "-=", "*=", "/=", "%=", "|=", "&=", "^=", "<<", ">>", "&^"),
}
#: After these words an expression starts, so that a slash begins a regular expression and < may begin a tag.
_BEFORE_EXPRESSION = {"return", "typeof", "case", "in", "of", "do", "else", "void", "delete", "throw", "new", "instanceof", "yield", "await", "default", "export"}


class Lexer:
    def __init__(self, text: str, dialect: str, jsx: bool = False):
        self.s, self.n, self.jsx, self.dialect = text, len(text), jsx, dialect
        self.out: list[Token] = []

    def run(self) -> list[Token]:
        at = self._html(0) if self.dialect == "php" else 0
        while at < self.n:
            at = self._step(at)
        return self.out

    def _add(self, kind: str, start: int, end: int, value: str | None = None) -> int:
        self.out.append(Token(kind, self.s[start:end], start, end, value))
        return end

    def _html(self, at: int) -> int:
        m = re.compile(r"<\?(?:php\b|=)", re.I).search(self.s, at)
        if not m:
            return self.n
        if self.out:
            self._add("op", at, at)
            self.out[-1].text = ";"
        return m.end()

    def _expression_starts(self) -> bool:
        if not self.out:
            return True
        t = self.out[-1]
        if t.kind == "name":
            return t.text in _BEFORE_EXPRESSION
        return t.kind == "op" and t.text not in (")", "]", "}", "}}", "++", "--")

    def _step(self, at: int) -> int:
        s, c, d = self.s, self.s[at], self.dialect
        if c.isspace():
            return at + 1
        if c == "/" and s.startswith("//", at) or c == "#" and (d == "php" and not s.startswith("#[", at) or d == "js" and at == 0 and s.startswith("#!")):
            return self._line_comment(at)
        if s.startswith("/*", at):
            end = s.find("*/", at + 2)
            return self.n if end < 0 else end + 2
        if d == "php":
            if s.startswith("?>", at):
                return self._html(at + 2)
            if s.startswith("<<<", at):
                end = self._heredoc(at)
                if end:
                    return end
            if c == "$" and (m := _NAME["go"].match(s, at + 1)):
                return self._add("var", at, m.end())
        if c == "'" or c == '"':
            return self._string(at)
        if c == "`":
            return self._template(at) if d == "js" else self._raw(at)
        if c.isdigit() or c == "." and at + 1 < self.n and s[at + 1].isdigit():
            return self._add("num", at, _NUMBER.match(s, at).end())
        if m := _NAME[d].match(s, at):
            return self._add("qname" if "\\" in m[0] else "name", at, m.end())
        if d == "js":
            if c == "/" and self._expression_starts():
                end = self._regex(at)
                if end:
                    return self._add("regex", at, end)
            if c == "<" and self.jsx and self._expression_starts() and re.compile(r"<(?:>|[A-Za-z_$][\w$.:-]*)").match(s, at) and not re.compile(r"<\s*[A-Za-z_$][\w$]*\s*(?:,|extends\b)").match(s, at):
                return self._element(at)
        for op in _OPS[d]:
            if s.startswith(op, at) and not (op == "?." and s[at + 2 : at + 3].isdigit()):
                return self._add("op", at, at + len(op))
        return self._add("op", at, at + 1)

    def _line_comment(self, at: int) -> int:
        end = self.s.find("\n", at)
        end = self.n if end < 0 else end
        if self.dialect == "php":
            close = self.s.find("?>", at, end)
            end = close if close >= 0 else end
        return end

    def _string(self, at: int) -> int:
        s, quote, i = self.s, self.s[at], at + 1
        parts: list[str] = []
        dynamic = False
        inner: list[tuple[int, int]] = []
        while i < self.n and s[i] != quote:
            if s[i] == "\\":
                nxt = s[i + 1 : i + 2]
                # one-letter escapes stand for their letter, as names never hold control characters
                parts.append(nxt if quote == '"' or nxt in ("'", "\\") or self.dialect != "php" else "\\" + nxt)
                i += 2
                continue
            if s[i] == "\n" and self.dialect != "php":
                break
            if self.dialect == "php" and quote == '"':
                if s[i] == "$" and _NAME["go"].match(s, i + 1):
                    dynamic = True
                elif s.startswith("{$", i):
                    dynamic = True
                    end = self._balanced(i)
                    inner.append((i + 1, end - 1))
                    i = end
                    continue
            parts.append(s[i])
            i += 1
        end = min(self.n, i + 1)
        self._add("str", at, end, None if dynamic else "".join(parts))
        for a, b in inner:
            self._nested(a, b)
        return end

    def _balanced(self, at: int) -> int:
        depth, i = 0, at
        while i < self.n:
            if self.s[i] in "'\"" and depth:
                q = self.s[i]
                i += 1
                while i < self.n and self.s[i] != q:
                    i += 2 if self.s[i] == "\\" else 1
            elif self.s[i] == "{":
                depth += 1
            elif self.s[i] == "}":
                depth -= 1
                if not depth:
                    return i + 1
            i += 1
        return self.n

    def _nested(self, a: int, b: int) -> None:
        self._add("op", a, a)
        self.out[-1].text = "{{"
        n, self.n = self.n, b
        at = a
        while at < b:
            at = self._step(at)
        self.n = n
        self._add("op", b, b)
        self.out[-1].text = "}}"

    def _raw(self, at: int) -> int:
        end = self.s.find("`", at + 1)
        end = self.n if end < 0 else end + 1
        return self._add("str", at, end, self.s[at + 1 : end - 1])

    def _code(self, at: int) -> int:
        """Code up to the brace that closes it; at is behind the opening one."""
        self._add("op", at, at)
        self.out[-1].text = "{{"
        depth = 0
        while at < self.n:
            if self.s[at] == "}" and not depth:
                break
            before = len(self.out)
            at = self._step(at)
            for t in self.out[before:]:
                if t.kind == "op":
                    depth += (t.text == "{") - (t.text == "}")
        self._add("op", at, min(self.n, at + 1))
        self.out[-1].text = "}}"
        return min(self.n, at + 1)

    def _template(self, at: int) -> int:
        s, i, plain, parts = self.s, at + 1, True, []
        slot = len(self.out)
        self._add("str", at, at + 1)
        while i < self.n and s[i] != "`":
            if s[i] == "\\":
                parts.append(s[i + 1 : i + 2])
                i += 2
            elif s.startswith("${", i):
                plain = False
                i = self._code(i + 2)
            else:
                parts.append(s[i])
                i += 1
        end = min(self.n, i + 1)
        t = self.out[slot]
        t.end, t.text, t.value = end, s[at:end], "".join(parts) if plain else None
        return end

    def _regex(self, at: int) -> int | None:
        i, inside = at + 1, False
        while i < self.n and self.s[i] != "\n":
            c = self.s[i]
            if c == "\\":
                i += 2
                continue
            if c == "[":
                inside = True
            elif c == "]":
                inside = False
            elif c == "/" and not inside:
                i += 1
                while i < self.n and self.s[i].isalpha():
                    i += 1
                return i
            i += 1
        return None

    def _heredoc(self, at: int) -> int | None:
        m = re.compile(r"<<<[ \t]*(['\"]?)([A-Za-z_]\w*)\1[ \t]*\r?\n").match(self.s, at)
        if not m:
            return None
        close = re.compile(rf"^[ \t]*{m[2]}\b", re.M).search(self.s, m.end())
        end = close.end() if close else self.n
        body = self.s[m.end() : close.start() if close else self.n]
        self._add("str", at, end, None if m[1] != "'" and re.search(r"\$[A-Za-z_{]", body) else body.rstrip("\r\n"))
        return end

    def _element(self, at: int) -> int:
        """A JSX element; text between tags is no code."""
        s = self.s
        m = re.compile(r"<([A-Za-z_$][\w$.:-]*)?").match(s, at)
        name, i = m[1], m.end()
        if name and name[0].isupper() and re.fullmatch(r"[\w$]+", name):
            self._add("jsx", at + 1, i)
        while i < self.n:
            if s.startswith("/>", i):
                return self._closed(i + 2)
            if s[i] == ">":
                i += 1
                break
            if s[i] == "{":
                i = self._code(i + 1)
            elif s[i] in "'\"":
                end = s.find(s[i], i + 1)
                i = self.n if end < 0 else end + 1
            elif s[i] == "<" and self.out and name and re.compile(r"<[A-Za-z_$]").match(s, i) and s[i - 1] == "=":
                i = self._element(i)
            else:
                i += 1
        while i < self.n:
            if s.startswith("</", i):
                end = s.find(">", i)
                return self._closed(self.n if end < 0 else end + 1)
            if s[i] == "{":
                i = self._code(i + 1)
            elif s[i] == "<" and re.compile(r"<(?:>|[A-Za-z_$])").match(s, i):
                i = self._element(i)
            else:
                i += 1
        return i

    def _closed(self, at: int) -> int:
        # an element is an operand
        self._add("str", at, at)
        return at


def pairs(tokens: list[Token]) -> dict[int, int]:
    """Token number of the bracket that belongs to each bracket; unmatched ones have none."""
    close = {"(": ")", "[": "]", "{": "}", "{{": "}}"}
    stack: list[int] = []
    out: dict[int, int] = {}
    for k, t in enumerate(tokens):
        if t.kind != "op":
            continue
        if t.text in close:
            stack.append(k)
        elif t.text in (")", "]", "}", "}}"):
            for depth in range(len(stack) - 1, -1, -1):
                if close[tokens[stack[depth]].text] == t.text:
                    out[stack[depth]], out[k] = k, stack[depth]
                    del stack[depth:]
                    break
    return out
