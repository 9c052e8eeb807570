"""Ruby facts from tokens and a stack of blocks that end with `end`."""

from __future__ import annotations

import re
from dataclasses import dataclass

from callweave.functions import languages as L
from callweave.parse.rows import Parsed

_IDENT = re.compile(r"[a-z_\u0080-\U0010ffff][\w\u0080-\U0010ffff]*[?!]?(?![=~](?![=~>]))|[a-z_\u0080-\U0010ffff][\w\u0080-\U0010ffff]*")
_CONST = re.compile(r"[A-Z]\w*")
_NUM = re.compile(r"0[xXbBoO][\da-fA-F_]+|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?[ri]?")
_OPS = ("<=>", "===", "**=", "||=", "&&=", "...", "<<=", ">>=", "&.", "::", "=>", "->", "==", "!=", "=~", "!~", "<=", ">=", "&&", "||", "<<", ">>", "**", "..", "+=", "-=", "*=", "/=", "%=", "|=", "&=", "^=")
_KEYWORDS = frozenset("alias and begin BEGIN break case class def defined? do else elsif end END ensure false for if in module next nil not or redo rescue retry return self super then true undef unless until when while yield __FILE__ __LINE__ __method__".split())
_OPENERS = frozenset("class module def begin case for do if unless while until".split())
_MODIFIERS = frozenset("if unless while until rescue".split())
_CLOSING = {"(": ")", "[": "]", "{": "}"}


@dataclass(slots=True)
class Token:
    kind: str  # id, const, kw, num, str, sym, ivar, label, op, nl
    text: str
    start: int
    end: int
    space: bool = False  # white space before it


class Lexer:
    def __init__(self, s: str):
        self.s, self.n, self.out, self.heredocs, self.paren = s, len(s), [], [], 0

    def run(self) -> list[Token]:
        at = 0
        while at < self.n:
            at = self._step(at)
        return self.out

    def _add(self, kind: str, a: int, b: int) -> int:
        self.out.append(Token(kind, self.s[a:b], a, b, a > 0 and self.s[a - 1] in " \t"))
        return b

    def _operand_before(self) -> bool:
        if not self.out:
            return False
        t = self.out[-1]
        return t.kind in ("id", "const", "num", "str", "sym", "ivar") or t.kind == "kw" and t.text in ("end", "self", "true", "false", "nil") or t.kind == "op" and t.text in (")", "]", "}")

    def _argument_may_start(self, at: int) -> bool:
        """After an operand, a sign with space before and none behind begins an argument of a command call."""
        return self.out[-1].kind == "id" and self.s[at - 1] in " \t" and at + 1 < self.n and not self.s[at + 1].isspace()

    def _step(self, at: int) -> int:
        s, c = self.s, self.s[at]
        if c == "\n":
            if self.out and self.out[-1].kind != "nl":
                self._add("nl", at, at + 1)
            at += 1
            for word, squiggly in self.heredocs:
                m = re.compile(rf"^{'[ \t]*' if squiggly else ''}{re.escape(word)}[ \t]*\r?$", re.M).search(s, at)
                at = m.end() if m else self.n
            self.heredocs = []
            return at
        if c.isspace():
            return at + 1
        if c == "\\" and s[at + 1 : at + 2] == "\n":
            return at + 2
        if c == "#":
            end = s.find("\n", at)
            return self.n if end < 0 else end
        if s.startswith("=begin", at) and (at == 0 or s[at - 1] == "\n"):
            m = re.compile(r"^=end.*$", re.M).search(s, at)
            return m.end() if m else self.n
        if s.startswith("__END__", at) and (at == 0 or s[at - 1] == "\n"):
            return self.n
        operand = self._operand_before()
        if c == "<" and (m := re.compile(r"<<([~-]?)(['\"`]?)([A-Za-z_]\w*)\2").match(s, at)) and (not operand or m[1] or m[2] and self._argument_may_start(at)):
            self.heredocs.append((m[3], bool(m[1])))
            return self._add("str", at, m.end())
        if c in "'\"`":
            end = self._quoted(at + 1, c, c, c != "'")
            if c != "`" and s[end : end + 1] == ":" and s[end + 1 : end + 2] != ":" and self.out and self.out[-1].text in ("{", ",", "(", "|"):
                end += 1
            return self._add("str", at, end)
        if c == "%" and (m := re.compile(r"%([qQwWiIrsx]?)([^\w\s])").match(s, at)) and (not operand or self._argument_may_start(at) and m[2] != "="):
            close = {"(": ")", "[": "]", "{": "}", "<": ">"}.get(m[2], m[2])
            end = self._quoted(m.end(), m[2], close, m[1] not in ("q", "w", "i", "s"))
            if m[1] == "r":
                end = re.compile(r"[a-z]*").match(s, end).end()
            return self._add("str", at, end)
        if c == "/" and (not operand or self._argument_may_start(at)):
            end = self._quoted(at + 1, "/", "/", True)
            return self._add("str", at, re.compile(r"[a-z]*").match(s, end).end())
        if c == ":" and s[at + 1 : at + 2] == '"':
            return self._add("sym", at, self._quoted(at + 2, '"', '"', True))
        if c == ":" and s[at + 1 : at + 2] != ":" and (m := re.compile(r":(?:[A-Za-z_]\w*[?!=]?|\[\]=?|[+\-*/<>=!~%&|^]+)").match(s, at)):
            end = m.end()
            if m[0].endswith("=") and s[end : end + 1] in (">", "~"):
                end -= 1
            return self._add("sym", at, end)
        if c == "?" and not operand and re.compile(r"\?\S(?!\w)").match(s, at):
            return self._add("str", at, at + 2)
        if m := re.compile(r"@@?[A-Za-z_]\w*|\$(?:[A-Za-z_]\w*|\W|\d+)").match(s, at):
            return self._add("ivar", at, m.end())
        if c.isdigit():
            return self._add("num", at, _NUM.match(s, at).end())
        after_dot = bool(self.out) and self.out[-1].kind == "op" and self.out[-1].text in (".", "&.")
        for kind, rule in (("const", _CONST), ("id", _IDENT)):
            if m := rule.match(s, at):
                end = m.end()
                if not after_dot and s[end : end + 1] == ":" and s[end + 1 : end + 2] != ":" and not (self.out and self.out[-1].text == "?"):
                    return self._add("label", at, end + 1)
                if not after_dot and m[0] in _KEYWORDS and not (self.out and self.out[-1].kind == "kw" and self.out[-1].text == "def" and m[0] != "self"):
                    kind = "kw"
                if s.startswith("defined?", at) and not after_dot:
                    return self._add("kw", at, at + 8)
                return self._add(kind, at, end)
        for op in _OPS:
            if s.startswith(op, at):
                return self._add("op", at, at + len(op))
        return self._add("op", at, at + 1)

    def _quoted(self, at: int, opening: str, close: str, interpolated: bool) -> int:
        """The end of a string body; code in #{...} becomes tokens between {{ and }}."""
        s, depth = self.s, 0
        while at < self.n:
            if s[at] == "\\":
                at += 2
                continue
            if interpolated and s.startswith("#{", at):
                self.out.append(Token("op", "{{", at, at))
                at += 2
                level = 0
                while at < self.n and not (s[at] == "}" and level == 0):
                    before = len(self.out)
                    at = self._step(at)
                    level += sum((t.text == "{") - (t.text == "}") for t in self.out[before:] if t.kind == "op")
                self.out.append(Token("op", "}}", at, at))
                at += 1
                continue
            if s[at] == close and depth == 0:
                return at + 1
            if opening != close:
                depth += (s[at] == opening) - (s[at] == close)
            at += 1
        return self.n


class Ruby:
    def __init__(self, text: str):
        self.s, self.out = text, Parsed()
        self.t = Lexer(text).run()
        self.match: dict[int, int] = {}
        stack: list[int] = []
        for k, t in enumerate(self.t):
            if t.kind == "op" and t.text in ("(", "[", "{", "{{"):
                stack.append(k)
            elif t.kind == "op" and t.text in (")", "]", "}", "}}") and stack:
                self.match[k], self.match[stack[-1]] = stack[-1], k
                stack.pop()

    def at(self, k: int) -> Token:
        return self.t[k] if 0 <= k < len(self.t) else Token("nl", "\n", len(self.s), len(self.s))

    def op(self, k: int, *texts: str) -> bool:
        return self.at(k).kind == "op" and self.at(k).text in texts

    def kw(self, k: int, *texts: str) -> bool:
        return self.at(k).kind == "kw" and self.at(k).text in texts

    def over(self, k: int) -> int:
        return self.match.get(k, len(self.t)) + 1

    def starts(self, k: int) -> bool:
        """Whether a statement starts at k."""
        b = self.at(k - 1)
        return k == 0 or b.kind == "nl" or self.op(k - 1, ";", "{{") or self.kw(k - 1, "then", "else", "do", "begin", "ensure")

    def run(self) -> Parsed:
        # blocks: [keyword, start token, name or None, container of its inside, where its body starts]
        blocks: list[list] = []
        owners: list[str | None] = [None]
        locals_: list[set[str]] = [set()]
        loop_do = 0
        k = 0
        while k < len(self.t):
            t = self.at(k)
            if t.kind == "kw" and not self.op(k - 1, ".", "&."):
                if t.text in ("class", "module"):
                    if t.text == "class" and self.op(k + 1, "<<"):
                        blocks.append(["class<<", k, None, owners[-1]])
                        owners.append(owners[-1])
                        locals_.append(set())
                    else:
                        j = k + 1
                        while self.at(j).kind == "const" and self.op(j + 1, "::"):
                            j += 2
                        if self.op(k + 1, "::"):
                            j = k + 2
                        name = self.s[self.at(k + 1).start : self.at(j).end]
                        blocks.append([t.text, k, name if j == k + 1 else None, owners[-1]])
                        owners.append(name)
                        locals_.append(set())
                        k = j
                elif t.text == "def":
                    k = self._def(k, blocks, owners, locals_)
                    continue
                elif t.text in ("begin", "case", "for"):
                    blocks.append([t.text, k, None, None])
                    if t.text == "for":
                        loop_do += 1
                elif t.text in ("if", "unless", "while", "until"):
                    if self._opens(k):
                        blocks.append([t.text, k, None, None])
                        loop_do += t.text in ("while", "until")
                elif t.text == "do":
                    if loop_do and self._is_loop_do(blocks, k):
                        loop_do -= 1
                    else:
                        blocks.append(["do", k, None, None])
                        self._block_parameters(k + 1, locals_)
                elif t.text == "end" and blocks:
                    b = blocks.pop()
                    if b[0] in ("class", "module", "class<<"):
                        owners.pop()
                        locals_.pop()
                        if b[2]:
                            self.out.defines(b[2], b[0], b[3], self.at(b[1]).start, t.end)
                    elif b[0] == "def":
                        locals_.pop()
                        if b[2]:
                            self.out.defines(b[2], "method", b[3], self.at(b[1]).start, t.end)
                    elif b[0] in ("while", "until", "for") and loop_do and b[-1] is None:
                        loop_do -= 1  # a loop without a do
            elif t.kind == "op" and t.text == "{" and self._is_block(k):
                self._block_parameters(k + 1, locals_)
            elif t.kind == "op" and t.text == "->" and self.op(k + 1, "("):
                self._names(k + 2, self.match.get(k + 1, k + 2), locals_)
            elif t.kind in ("id", "const"):
                self._name(k, blocks, owners, locals_)
            k += 1
        # unclosed blocks run to the end
        for b in reversed(blocks):
            if b[2]:
                self.out.defines(b[2], "method" if b[0] == "def" else b[0], b[3], self.at(b[1]).start, len(self.s))
        return self.out

    def _opens(self, k: int) -> bool:
        """if, unless, while and until open a block unless they follow an expression on their line."""
        b = self.at(k - 1)
        if self.starts(k) or b.kind == "op" and b.text not in (")", "]", "}", "}}"):
            return True
        return b.kind == "kw" and b.text in ("return", "and", "or", "not", "else", "elsif", "when", "in", "do", "then", "yield")

    def _is_loop_do(self, blocks: list, k: int) -> bool:
        if not blocks or blocks[-1][0] not in ("while", "until", "for"):
            return False
        b = blocks[-1]
        if any(self.at(j).kind == "nl" for j in range(b[1], k)):
            return False
        b.append(True)  # its do is found
        return True

    def _is_block(self, k: int) -> bool:
        b = self.at(k - 1)
        return b.kind == "id" or self.op(k - 1, ")") or self.op(k + 1, "|")

    def _def(self, k: int, blocks: list, owners: list, locals_: list) -> int:
        n = k + 1
        while (self.kw(n, "self") or self.at(n).kind in ("const", "id", "ivar")) and self.op(n + 1, "."):
            n += 2
        t = self.at(n)
        named = t.kind in ("id", "kw")
        setter = self.op(n + 1, "=") and not self.at(n + 1).space and (self.op(n + 2, "(") or self.at(n + 2).space and self.at(n + 2).kind == "id")
        name = t.text if named and not setter else None
        locals_.append(set())
        j = n + 1 + bool(setter)
        if self.op(j, "("):
            end = self.match.get(j, j)
            self._names(j + 1, end, locals_)
            j = end + 1
        else:
            stop = j
            while self.at(stop).kind != "nl" and not self.op(stop, ";", "="):
                stop += 1
            self._names(j, stop, locals_)
            j = stop
        if self.op(j, "=") and named:  # endless
            end = j + 1
            while self.at(end).kind != "nl" and not self.op(end, ";"):
                end = self.over(end) if self.op(end, "(", "[", "{", "{{") else end + 1
            if name:
                self.out.defines(name, "method", owners[-1], self.at(k).start, self.at(end - 1).end)
            locals_.pop()
            return j + 1
        blocks.append(["def", k, name, owners[-1]])
        return j

    def _names(self, a: int, b: int, locals_: list) -> None:
        """Parameters between a and b; splats and block parameters are not recorded but are bound."""
        k = a
        while k < b:
            t = self.at(k)
            first = k == a or self.op(k - 1, ",", "|", ";", "(")
            if t.kind == "id" and first:
                self._shadow(t.text, t.start, locals_)
            elif t.kind == "label" and first:
                self._shadow(t.text[:-1], t.start, locals_)
            elif t.kind == "id" and self.op(k - 1, "*", "**", "&"):
                locals_[-1].add(t.text)
            if self.op(k, "[", "{") or self.op(k, "(") and not first:
                k = self.over(k)
                continue
            k += 1

    def _shadow(self, name: str, at: int, locals_: list) -> None:
        locals_[-1].add(name)
        self.out.binds(name, "", at, "shadow")

    def _block_parameters(self, k: int, locals_: list) -> None:
        if self.op(k, "|"):
            end = k + 1
            while end < len(self.t) and not self.op(end, "|"):
                end += 1
            self._names(k + 1, end, locals_)

    def _receiver(self, k: int) -> str:
        """Text of the operand before the dot at k - 1."""
        j = k - 2
        while True:
            if self.op(j, ")", "]", "}") and j in self.match:
                j = self.match[j]
                if self.at(j - 1).kind in ("id", "const") and not self.at(j).space or self.op(j, "{") and self.op(j - 1, ")"):
                    j -= 1
                    continue
                break
            if self.op(j - 1, ".", "&.", "::"):
                j -= 2
                continue
            break
        return self.s[self.at(max(j, 0)).start : self.at(k - 2).end].strip()

    def _name(self, k: int, blocks: list, owners: list, locals_: list) -> None:
        t, nxt = self.at(k), self.at(k + 1)
        dotted = self.op(k - 1, ".", "&.") or self.op(k - 1, "::") and t.kind == "id"
        if t.kind == "const":
            return
        if not dotted and self.op(k + 1, "=") and not self.op(k - 1, "|", ".", "&."):
            self._shadow(t.text, t.start, locals_)
            if self.at(k + 2).kind == "const" and self.op(k + 3, ".") and self.at(k + 4).text == "new":
                after = self.over(k + 5) if self.op(k + 5, "(") and not self.at(k + 5).space else k + 5
                if not self.op(after, ".", "&.", "+", "-", "*", "||", "&&", "?"):
                    self.out.binds(t.text, self.at(k + 2).text, self.at(k + 2).start)
            return
        if self.op(k + 1, "||=", "&&=", "+=", "-=", "*=", "/=", "<<=") and not dotted:
            locals_[-1].add(t.text)
            return
        if self.op(k - 1, "::") or self.kw(k - 1, "alias", "undef") or self.kw(k - 2, "alias"):
            return
        arguments = self.op(k + 1, "(") and not nxt.space
        block = self.kw(k + 1, "do") or self.op(k + 1, "{") and self._is_block(k + 1)
        command = not arguments and t.text not in locals_[-1] and self._command(k) or dotted and not arguments and self._command(k)
        if self.kw(k - 1, "defined?"):
            return
        if dotted:
            if self.op(k + 1, "=") and not self.op(k + 1, "=="):
                return
            self.out.calls(t.text, self._receiver(k), t.start)
        elif arguments or command or block and t.text not in locals_[-1]:
            self.out.calls(t.text, None, t.start)
        elif self._statement(k, blocks):
            self.out.calls(t.text, None, t.start)
        if not dotted and t.text in L.RUBY_MIXINS and (arguments or command):
            self._mixins(k)

    def _command(self, k: int) -> bool:
        """Whether an argument without parentheses follows."""
        n = self.at(k + 1)
        if not n.space or n.kind == "nl":
            return False
        if n.kind in ("id", "const", "num", "str", "sym", "ivar", "label"):
            return True
        if n.kind == "kw":
            return n.text in ("self", "nil", "true", "false", "not", "lambda", "proc", "super", "yield", "__FILE__", "__method__", "case", "defined?")
        tight = self.s[n.end : n.end + 1] not in (" ", "\t", "\n", "")
        return n.text in ("->", "{{") or n.text == "::" and tight or n.text in ("[", "*", "&", "-", "**", "!") and tight and n.text != "[" or n.text == "[" and tight and self.at(k).text not in ("p",)

    def _statement(self, k: int, blocks: list) -> bool:
        """A bare identifier that is a whole statement directly in a method, class, module or do block."""
        if not blocks or blocks[-1][0] not in ("def", "class", "module", "class<<", "do", "begin"):
            return False
        before, after = self.at(k - 1), self.at(k + 1)
        opener = blocks[-1][1]
        starts = before.kind == "nl" or self.op(k - 1, ";") or k - 1 == opener
        return starts and (after.kind == "nl" or self.op(k + 1, ";") or self.kw(k + 1, "end"))

    def _mixins(self, k: int) -> None:
        j = k + 1 + self.op(k + 1, "(")
        while True:
            if self.op(j, "::"):
                j += 1
            if self.at(j).kind != "const":
                return
            while self.op(j + 1, "::") and self.at(j + 2).kind == "const":
                j += 2
            self.out.binds("<mixin>", self.at(j).text, self.at(k).start, "mixin")
            if not self.op(j + 1, ","):
                return
            j += 2


def parse(text: str) -> Parsed:
    return Ruby(text).run()
