"""Facts of the brace dialects: one walk over the tokens with a stack of open scopes."""

from __future__ import annotations


from callweave.functions import languages as L
from callweave.parse.lexer import Lexer, Token, pairs
from callweave.parse.rows import Parsed

_END = Token("op", "", 0, 0)


class Walk:
    """Tokens with helpers that never run past their ends."""

    dialect = "js"
    keywords: frozenset[str] = frozenset()

    def __init__(self, text: str, lang: str):
        self.s, self.lang, self.out = text, lang, Parsed()
        self.t = Lexer(text, self.dialect, lang in L.JSX_LANGUAGES).run()
        self.match = pairs(self.t)
        opened = sum(t.kind == "op" and t.text in ("(", "[", "{") for t in self.t)
        self.broken = 2 * opened != sum(1 for k in self.match if self.t[k].text not in ("{{", "}}")) or any(t.kind == "op" and t.text in (")", "]", "}") and k not in self.match for k, t in enumerate(self.t))
        self.classes: list[tuple[int, int, str]] = []  # token range of a body, name
        self.inside: list[int] = []  # the innermost open bracket around each token
        open_: list[int] = []
        for k in range(len(self.t)):
            if k in self.match and self.match[k] < k:
                while open_ and open_[-1] != self.match[k]:
                    open_.pop()
                if open_:
                    open_.pop()
            self.inside.append(open_[-1] if open_ else -1)
            if k in self.match and self.match[k] > k:
                open_.append(k)

    def at(self, k: int) -> Token:
        return self.t[k] if 0 <= k < len(self.t) else _END

    def is_(self, k: int, *texts: str) -> bool:
        t = self.at(k)
        return t.kind in ("op", "name") and t.text in texts

    def op(self, k: int, *texts: str) -> bool:
        t = self.at(k)
        return t.kind == "op" and t.text in texts

    def word(self, k: int) -> bool:
        return self.at(k).kind == "name"

    def over(self, k: int) -> int:
        """The token behind a bracket group that opens at k; the end of the file if it never closes."""
        return self.match.get(k, len(self.t) - 1) + 1

    def text_of(self, a: int, b: int) -> str:
        """Source from token a up to and without token b."""
        return self.s[self.at(a).start : self.at(b - 1).end] if b > a else ""

    def owner(self, k: int) -> str | None:
        best = None
        for a, b, name in self.classes:
            if a < k < b and (best is None or a > best[0]):
                best = (a, name)
        return best[1] if best else None

    def symbol(self, name: str, kind: str, container: str | None, a: int, b: int) -> None:
        """A definition over tokens a to b - 1."""
        self.out.defines(name, kind, container, self.at(a).start, self.at(b - 1).end)

    def split(self, a: int, b: int, sep: str = ",") -> list[tuple[int, int]]:
        """Token ranges between separators at the top level of a to b - 1."""
        out, first, k = [], a, a
        while k < b:
            if self.op(k, "(", "[", "{", "{{"):
                k = min(b, self.over(k))
                continue
            if self.op(k, sep):
                out.append((first, k))
                first = k + 1
            k += 1
        if first < b:
            out.append((first, b))
        return [(x, y) for x, y in out if y > x]

    def arguments(self, k: int) -> list[tuple[int, int]]:
        return self.split(k + 1, self.match.get(k, len(self.t)))

    def operand_start(self, k: int) -> int:
        """First token of the postfix expression that ends with token k."""
        while True:
            t = self.at(k)
            if t.kind == "op" and t.text in (")", "]", "}}") and k in self.match:
                k = self.match[k]
                if t.text == "}}":
                    k -= 1
                    continue
                before = self.at(k - 1)
                if t.text == ")" and not (before.kind in ("name", "var", "qname", "str") and before.text not in self.keywords or before.kind == "op" and before.text in (")", "]", ">", "?.")):
                    return k
                if t.text == "]" and not (before.kind in ("name", "var", "qname", "str") and before.text not in self.keywords or before.kind == "op" and before.text in (")", "]", "?.", "!")):
                    return k
                k -= 1
                if self.op(k, "?."):
                    k -= 1
                continue
            if t.kind == "op" and t.text == "!" and self.dialect == "js":
                k -= 1
                continue
            if self.op(k - 1, ".", "?.", "->", "?->", "::"):
                k -= 2
                continue
            if self.is_(k - 1, "new") and t.kind in ("name", "qname"):
                return k - 1
            return k

    def recovered(self) -> None:
        """After broken brackets: definitions without a container that lie inside a class body belong to it."""
        bodies = []
        for k, t in enumerate(self.t):
            if t.kind == "name" and t.text in ("class", "trait", "interface", "enum") and self.word(k + 1):
                depth, j = 0, k + 2
                while j < len(self.t):
                    if self.op(j, "{"):
                        depth += 1
                    elif self.op(j, "}"):
                        depth -= 1
                        if depth == 0:
                            bodies.append((t.start, self.t[j].end, self.t[k + 1].text))
                            break
                    j += 1
        for s in self.out.rows["symbols"]:
            if s["container"] is None and s["kind"] != "class":
                inside = [b for b in bodies if b[0] <= s["start_byte"] < b[1] and b[2] != s["name"]]
                if inside:
                    s["container"], s["kind"] = max(inside)[2], "method"


class Script(Walk):
    """JavaScript, TypeScript and TSX."""

    keywords = frozenset(
        "break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof let new return super switch this throw try typeof var void while with yield await async of enum".split()
    ) - {"async", "of", "let"}
    _not_calls = keywords | {"function"}

    def run(self) -> Parsed:
        self.ts = self.lang != "javascript"
        self.methods: set[int] = set()  # tokens that name a method
        self.typed: set[int] = set()  # braces that open a class or an interface
        self._bodies()
        self._definitions()
        for k in range(len(self.t)):
            self._call(k)
            self._binding(k)
        self._imports()
        if self.broken:
            self.recovered()
        return self.out

    # --- classes and methods ---
    def _bodies(self) -> None:
        for k, t in enumerate(self.t):
            if t.kind == "name" and t.text == "class" and not self.op(k - 1, ".", "?.") and not self.op(k + 1, ":", ",", ")", "="):
                name = self.at(k + 1).text if self.word(k + 1) and not self.is_(k + 1, "extends", "implements") else None
                body = self._class_body(k)
                if body is None:
                    continue
                end = self.over(body)
                before = self.at(k - 1)
                abstract = self.is_(k - 1, "abstract")
                expression = before.kind == "op" and before.text not in ("", ";", "{", "}", "}}", ")") or self.is_(k - 1, "return", "new", "extends", "of", "in", "typeof", "await", "yield", "case")
                if name and not expression and not abstract:
                    self.classes.append((body, end - 1, name))
                    self.symbol(name, "class", None, k, end)
                self.typed.add(body)
                self._members(body, end)
            elif t.kind == "name" and t.text == "interface" and self.ts and self.word(k + 1) and not self.op(k - 1, ".", "?."):
                j = k + 2
                while j < len(self.t) and not self.op(j, "{", ";"):
                    j += 1
                if self.op(j, "{"):
                    self.typed.add(j)
                    self.symbol(self.at(k + 1).text, "interface", None, k, self.over(j))
        for k, t in enumerate(self.t):
            if t.kind == "op" and t.text == "{" and self._is_object(k):
                self._members(k, self.over(k))

    def _class_body(self, k: int) -> int | None:
        j = k + 1
        while j < len(self.t):
            if self.op(j, "{"):
                return j
            if self.op(j, "("):
                j = self.over(j)
                continue
            if self.op(j, ";", ")", "}"):
                return None
            j += 1
        return None

    def _is_object(self, k: int) -> bool:
        """Whether a brace opens an object literal."""
        b = self.at(k - 1)
        if b.kind == "op":
            return b.text in ("=", "(", ",", "[", ":", "?", "||", "&&", "??", "...", "{{") and not (b.text == ":" and self._is_label(k - 1))
        return b.kind == "name" and b.text in ("return", "default", "yield", "await", "throw")

    def _is_label(self, k: int) -> bool:
        return self.is_(k - 2, "case") or self.is_(k - 1, "default")

    def _members(self, body: int, end: int) -> None:
        k = body + 1
        fresh = body + 1  # where the present member begins
        while k < end - 1:
            t = self.at(k)
            if t.kind == "op" and t.text in ("(", "[", "{", "{{"):
                if t.text == "(" and self.word(k - 1) and not self.at(k - 1).text.startswith("#") and k - 1 >= fresh and self._only_modifiers(fresh, k - 1):
                    after = self._behind_types(self.over(k), end)
                    if self.op(after, "{"):
                        stop = self.over(after)
                        start = fresh
                        while self.op(start, "@"):  # decorators stand before the node
                            start = self._behind_decorator(start)
                        self.methods.add(k - 1)
                        self.symbol(self.at(k - 1).text, "method", self.owner(k - 1), start, stop)
                        k = fresh = stop
                        continue
                k = self.over(k)
                if t.text == "{" and self.op(k, ";", ",") is False and not self.op(k, ".", "(", "[", "?", "=>"):
                    fresh = k
                continue
            if t.kind == "op" and t.text in (";", ","):
                fresh = k + 1
            elif fresh < k and self.s.count("\n", self.at(k - 1).end, t.start) and self._member_may_start(k):
                fresh = k
            k += 1

    def _member_may_start(self, k: int) -> bool:
        b = self.at(k - 1)
        return not (b.kind == "op" and b.text in ("=", "=>", "+", "-", "*", "/", "&&", "||", "??", "?", ":", ".", "(", "[", ",", "|", "&", "<")) and self.at(k).kind in ("name", "op") and not self.op(k, ".", "?.", "=>", "=", "+", "-", "/", "&&", "||", "??", "?", ":", "|", "&", ")", "]", "}") and not (b.kind == "name" and b.text in ("static", "async", "get", "set", "public", "private", "protected", "readonly", "override", "abstract", "declare", "accessor"))

    def _behind_decorator(self, k: int) -> int:
        k += 2
        while self.op(k, "."):
            k += 2
        return self.over(k) if self.op(k, "(") else k

    def _only_modifiers(self, a: int, b: int) -> bool:
        while a < b and self.op(a, "@"):
            a = self._behind_decorator(a)
        return all(self.is_(k, "static", "async", "get", "set", "*", "public", "private", "protected", "readonly", "override", "abstract", "declare", "accessor") for k in range(a, b))

    def _behind_types(self, k: int, end: int) -> int:
        """Skips a return type; k is behind the parameters."""
        if self.ts and self.op(k, ":"):
            k += 1
            while k < end and not self.op(k, "{", ";", "=>", ",", "=", ")"):
                k = self.over(k) if self.op(k, "(", "[") else k + 1
            if self.op(k, "{") and self.op(k - 1, ":", "|", "&", "<", ","):  # an object type
                k = self._behind_types_rest(self.over(k), end)
        return k

    def _behind_types_rest(self, k: int, end: int) -> int:
        while k < end and self.op(k, "|", "&", "[", "]", ">", ">>"):
            k += 1
            if self.op(k, "{"):
                k = self.over(k)
        return k

    # --- functions ---
    def _definitions(self) -> None:
        for k, t in enumerate(self.t):
            if t.kind == "name" and t.text == "function" and not self.op(k - 1, ".", "?."):
                star = self.op(k + 1, "*")
                n = k + 1 + star
                start = k - 1 if self.is_(k - 1, "async") else k
                b = self.at(start - 1)
                expression = b.kind == "op" and b.text in ("=", "(", ",", "[", ":", "?", "||", "&&", "??", "=>", "!", "+", "-", "...", "{{") or b.kind == "name" and b.text in ("return", "new", "typeof", "await", "void", "yield", "throw", "in", "of")
                if self.word(n) and not expression:
                    p = n + 1
                    if self.op(p, "<"):
                        p = self._behind_generics(p)
                    if self.op(p, "("):
                        body = self._behind_types(self.over(p), len(self.t))
                        if self.op(body, "{"):
                            owner = self.owner(k)
                            self.symbol(self.at(n).text, "method" if owner else "function", owner, start, self.over(body))
            if self.word(k) and t.text not in self.keywords and self._declares(k):
                self._declarator(k)

    def _behind_generics(self, k: int) -> int:
        depth = 0
        j = k
        while j < len(self.t) and j < k + 200:
            if self.op(j, "<"):
                depth += 1
            elif self.op(j, ">"):
                depth -= 1
                if not depth:
                    return j + 1
            elif self.op(j, "(", "[", "{"):
                j = self.over(j)
                continue
            elif self.op(j, ";", ")", "}", "&&", "||"):
                return k
            j += 1
        return k

    def _declares(self, k: int) -> bool:
        """Whether the name at k is declared by const, let or var."""
        if self.is_(k - 1, "const", "let", "var") and not self.op(k - 2, ".", "?."):
            return True
        if not self.op(k - 1, ","):
            return False
        # a later declarator of the same statement: walk back over earlier ones
        j = k - 2
        while j >= 0:
            if self.op(j, ")", "]", "}", "}}") and j in self.match:
                j = self.match[j] - 1
                continue
            if self.op(j, ";", "(", "[", "{", "{{", "}", ")"):
                return False
            if self.is_(j, "const", "let", "var"):
                return not self.op(j - 1, ".", "?.")
            if self.word(j) and self.at(j).text in self.keywords - {"new", "this", "await", "typeof", "function", "super"}:
                return False
            j -= 1
        return False

    def _value_of(self, k: int) -> int | None:
        """The first token of a declarator's value."""
        j = k + 1
        if self.op(j, "!"):
            j += 1
        if self.op(j, ":"):
            j += 1
            while j < len(self.t) and not self.op(j, "=", ";", ")"):
                if self.is_(j, "const", "let", "var", "function", "class", "return"):
                    return None
                j = self.over(j) if self.op(j, "(", "[", "{") else j + 1
        return j + 1 if self.op(j, "=") else None

    def _arrow(self, k: int) -> int | None:
        """The token behind => if an arrow function starts at k."""
        j = k + 1 if self.is_(k, "async") and not self.op(k + 1, "=>") else k
        if self.op(j, "<"):
            j = self._behind_generics(j)
        if self.op(j, "("):
            j = self.over(j)
            if self.ts and self.op(j, ":"):
                j += 1
                while j < len(self.t) and not self.op(j, "=>", ";", "=", ")", ","):
                    j = self.over(j) if self.op(j, "(", "[", "{") else j + 1
            return j + 1 if self.op(j, "=>") else None
        return j + 2 if self.word(j) and self.op(j + 1, "=>") else None

    def _function(self, k: int) -> int | None:
        """The token behind a function expression that starts at k."""
        j = k + 1 if self.is_(k, "async") else k
        if not self.is_(j, "function"):
            return None
        while j < len(self.t) and not self.op(j, "("):
            j += 1
        body = self._behind_types(self.over(j), len(self.t))
        return self.over(body) if self.op(body, "{") else None

    def _expression_end(self, k: int) -> int:
        """The token behind the expression that starts at k: up to a comma, semicolon, closing bracket or line end."""
        j = k
        while j < len(self.t):
            if self.op(j, ",", ";", ")", "]", "}", "}}"):
                return j
            if j > k and "\n" in self.s[self.at(j - 1).end : self.at(j).start]:
                a, b = self.at(j - 1), self.at(j)
                if not (a.kind == "op" and a.text not in (")", "]", "}", "}}", "++", "--")) and not (b.kind == "op" and b.text not in ("{", "!", "++", "--", "@", "{{")):
                    return j
            j = self.over(j) if self.op(j, "(", "[", "{", "{{") else j + 1
        return j

    def _declarator(self, k: int) -> None:
        v = self._value_of(k)
        if v is None:
            return
        name, owner = self.at(k).text, self.owner(k)
        end = None
        arrow = self._arrow(v)
        if arrow is not None:
            end = self.over(arrow) if self.op(arrow, "{") else self._expression_end(arrow)
        else:
            f = self._function(v)
            if f is not None and f == self._expression_end(v):
                end = f
        if end is not None:
            self.symbol(name, "method" if owner else "function", owner, k, end)
            return
        stop = self._expression_end(v)
        if self.op(stop - 1, ")") and self.operand_start(stop - 1) == v and not self.is_(v, "new", "await"):
            call = self.match[stop - 1]
            bare = call == v + 1 or self.op(v + 1, "<") and self._behind_generics(v + 1) == call
            component = name[:1].isupper() or name.startswith("use") and len(name) > 3 and name[3].isupper()
            inline = any(self._arrow(a) is not None or self._function(a) is not None for a, _ in self.arguments(call))
            if inline and (component or bare):
                self.symbol(name, "function", owner, k, stop)

    # --- calls ---
    def _call(self, k: int) -> None:
        t = self.at(k)
        if t.kind == "jsx":
            self.out.calls(t.text, None, t.start)
            return
        if t.kind != "name" or k in self.methods or t.text.startswith("#"):
            return
        p = k + 1
        if self.op(p, "?.") and self.op(p + 1, "("):
            p += 1
        if self.ts and self.op(p, "<"):
            g = self._behind_generics(p)
            p = g if g != p else p
        if not self.op(p, "("):
            return
        member = self.op(k - 1, ".", "?.")
        if not member and (t.text in self._not_calls or self.is_(k - 1, "function", "new") or self.op(k - 1, "*") and self.is_(k - 2, "function")):
            return
        if not member and self.inside[k] in self.typed and self._signature(k):
            return
        if member:
            first = self.operand_start(k)
            if self.is_(first, "new") and not any(self.op(j, "(") for j in range(first, k)):
                return  # new a.b() constructs
            self.out.calls(t.text, self.text_of(first, k - 1).strip(), t.start)
        else:
            self.out.calls(t.text, None, t.start)

    def _signature(self, k: int) -> bool:
        """A member without a body, as in interfaces, overloads and abstract methods."""
        b = self.at(k - 1)
        if b.kind == "op" and b.text in (";", "{", "}", ","):
            return True
        return self.is_(k - 1, "static", "async", "get", "set", "public", "private", "protected", "readonly", "override", "abstract", "declare") or self._member_may_start(k) and "\n" in self.s[b.end : self.at(k).start]

    # --- bindings ---
    def _binding(self, k: int) -> None:
        t = self.at(k)
        if t.kind == "op" and t.text == "(" and self._is_parameters(k):
            self._parameters(k)
        if t.kind == "name" and t.text == "catch":
            return
        if not self.word(k) or t.text in self.keywords:
            return
        if self._declares(k):
            if self.is_(k + 1, "of", "in"):
                self.out.binds(t.text, "", t.start, "shadow")
                return
            if self.ts and self.op(k + 1, ":"):
                self._hint(t.text, k + 2, self._type_end(k + 2), t.start)
            self.out.binds(t.text, "", t.start, "shadow")
            v = self._value_of(k)
        elif self.op(k + 1, "=") and not self.op(k - 1, ".", "?.", "@") and not self.at(k - 1).kind == "name":
            v = k + 2
        else:
            if self.is_(k + 1, "of", "in") and self.op(k - 1, "(") and self.is_(k - 2, "for"):
                self.out.binds(t.text, "", t.start, "shadow")
            return
        if v is not None and self.is_(v, "new") and self.word(v + 1) and not self.op(v + 2, "."):
            p = v + 2
            if self.op(p, "<"):
                p = self._behind_generics(p)
            if not self.op(p, "(") or not self.op(self.over(p), ".", "?.", "(", "["):
                self.out.binds(t.text, self.at(v + 1).text, self.at(v + 1).start)

    def _is_parameters(self, k: int) -> bool:
        after = self.over(k)
        if self.op(after, "=>"):
            return True
        if k - 1 in self.methods or self.is_(k - 1, "function") or self.is_(k - 2, "function") or self.op(k - 2, "*") and self.is_(k - 3, "function"):
            return True
        if self.op(k - 1, ">") and self.ts:
            j = k - 1
            while j > 0 and not self.op(j, "<"):
                j -= 1
            return self.is_(j - 2, "function") or j - 1 in self.methods
        if self.ts and self.op(after, ":"):
            j = after + 1
            while j < len(self.t) and not self.op(j, "=>", ";", "=", ")", ",", "{", "}"):
                j = self.over(j) if self.op(j, "(", "[") else j + 1
            return self.op(j, "=>") and not self.is_(k - 1, "if", "while", "for", "switch") and not self.word(k - 1)
        return False

    def _parameters(self, k: int) -> None:
        for a, b in self.arguments(k):
            start = a
            while self.op(a, "@"):
                a = self._behind_decorator(a)
            while self.ts and self.is_(a, "public", "private", "protected", "readonly", "override") and self.word(a + 1):
                a += 1
            if not self.word(a) or self.is_(a, "this"):
                continue
            name = self.at(a)
            if not self.ts:
                if b == a + 1:
                    self.out.binds(name.text, "", name.start, "shadow")
                continue
            j = a + 1 + self.op(a + 1, "?")
            if j < b and self.op(j, ":"):
                self._hint(name.text, j + 1, min(b, self._type_end(j + 1)), self.at(start).start)
            else:
                self.out.binds(name.text, "", self.at(start).start, "shadow")
            self.out.binds(name.text, "", name.start, "shadow")

    def _type_end(self, k: int) -> int:
        while k < len(self.t) and not self.op(k, "=", ",", ";", ")", "}"):
            if self.is_(k, "const", "let", "var", "return", "of", "in"):
                break
            if "\n" in self.s[self.at(k - 1).end : self.at(k).start] and self.at(k).kind == "name" and self.at(k - 1).kind == "name":
                break
            k = self.over(k) if self.op(k, "(", "[", "{") else k + 1
        return k

    def _hint(self, var: str, a: int, b: int, at: int) -> None:
        simple = b == a + 1 and self.word(a) and self.at(a).text not in ("string", "number", "boolean", "any", "void", "unknown", "never", "object", "symbol", "bigint", "undefined", "null", "this")
        self.out.binds(var, self.at(a).text if simple else "", at, "hint" if simple else "shadow")

    def _imports(self) -> None:
        for k, t in enumerate(self.t):
            if t.kind != "name" or t.text != "import" or self.op(k + 1, "(", ".") or self.op(k - 1, "."):
                continue
            j = k + 1
            while j < len(self.t) and not self.op(j, ";") and j < k + 400:
                if self.at(j).kind == "str":
                    self.out.uses(self.at(j).text.strip("'\"`"))
                    break
                if self.op(j, "=", "("):
                    break
                j += 1


class Php(Walk):
    dialect = "php"
    keywords = frozenset("if else elseif while for foreach switch match function fn class interface trait enum new return echo print isset empty unset list array include include_once require require_once catch declare exit die clone instanceof use namespace throw yield and or xor not static abstract final public protected private const global goto try finally do case default extends implements insteadof".split())
    _modifiers = ("abstract", "final", "static", "public", "protected", "private", "readonly", "var")
    _primitive = frozenset("int float string bool array callable iterable object mixed void null never false true self static parent".split())

    def run(self) -> Parsed:
        self.body_of: dict[int, bool] = {}
        self._bodies()
        for k in range(len(self.t)):
            self._definition(k)
        for k in range(len(self.t)):
            self._call(k)
            self._binding(k)
            self._constant(k)
        if self.broken:
            self.recovered()
        return self.out

    def _bodies(self) -> None:
        self.bodies: list[tuple[int, int]] = []
        for k, t in enumerate(self.t):
            if t.kind != "name" or t.text.lower() not in ("class", "interface", "trait", "enum") or self.op(k - 1, "::", "->"):
                continue
            anonymous = t.text.lower() == "class" and (self.is_(k - 1, "new") or not self.word(k + 1) or self.is_(k + 1, "extends", "implements"))
            if not anonymous and not self.word(k + 1):
                continue
            j = k + 1
            while j < len(self.t) and not self.op(j, "{", ";", ")") or self.op(j, "(") and j < len(self.t):
                j = self.over(j) if self.op(j, "(") else j + 1
            if not self.op(j, "{"):
                continue
            end = self.over(j)
            self.bodies.append((j, end - 1))
            if not anonymous:
                self.classes.append((j, end - 1, self.at(k + 1).text))
                if t.text.lower() != "enum":
                    a = k
                    while self.is_(a - 1, "abstract", "final", "readonly"):
                        a -= 1
                    self.symbol(self.at(k + 1).text, t.text.lower(), self.owner(k), a, end)

    def _in_body(self, k: int) -> bool:
        """Whether token k stands directly in a class body."""
        best = max((b for b in self.bodies if b[0] < k < b[1]), default=None)
        if best is None:
            return False
        depth = 0
        for j in range(best[0] + 1, k):
            if self.op(j, "{"):
                depth += 1
            elif self.op(j, "}"):
                depth -= 1
        return depth == 0

    def _definition(self, k: int) -> None:
        if not self.is_(k, "function") or self.at(k).kind != "name" or self.op(k - 1, "::", "->"):
            return
        n = k + 1 + self.op(k + 1, "&")
        if not self.word(n) or not self.op(n + 1, "("):
            if self.op(n, "("):
                self._parameters(n)
            return
        self._parameters(n + 1)
        j = self.over(n + 1)
        while j < len(self.t) and not self.op(j, "{", ";", "}"):
            j += 1
        end = self.over(j) if self.op(j, "{") else j + 1
        owner = self.owner(k)
        if self._in_body(k):
            a = k
            while self.is_(a - 1, *self._modifiers):
                a -= 1
            self.symbol(self.at(n).text, "method", owner, a, end)
        else:
            self.symbol(self.at(n).text, "method" if owner else "function", owner, k, end)

    def _parameters(self, p: int) -> None:
        for a, b in self.arguments(p):
            v = next((j for j in range(a, b) if self.at(j).kind == "var"), None)
            if v is None or self.op(v - 1, "..."):
                continue
            name = self.at(v).text.lstrip("$")
            start = a
            while start < v and self.op(start, "#"):  # attributes
                start = self.over(start + 1)
            first = start
            while self.is_(first, "public", "protected", "private", "readonly"):
                first += 1
            kind = [j for j in range(first, v) if not self.op(j, "&")]
            if kind and self.op(kind[0], "?"):
                kind = kind[1:]
            cls = ""
            if len(kind) == 1 and self.at(kind[0]).kind in ("name", "qname"):
                cls = self.at(kind[0]).text.rsplit("\\", 1)[-1]
                cls = "" if self.at(kind[0]).kind == "name" and cls.lower() in self._primitive else cls
            self.out.binds(name, cls, self.at(start).start, "hint" if cls else "shadow")
            self.out.binds(name, "", self.at(v).start + 1, "shadow")

    def _call(self, k: int) -> None:
        t = self.at(k)
        if t.kind not in ("name", "qname") or not self.op(k + 1, "("):
            return
        if self.op(k - 1, "->", "::"):
            if t.kind == "name":
                first = self.operand_start(k)
                self.out.calls(t.text, self.text_of(first, k - 1).strip(), t.start)
            return
        if self.op(k - 1, "?->") or self.is_(k - 1, "new", "function", "fn", "class") or self.op(k - 1, "&") and self.is_(k - 2, "function") or self.op(k - 1, "[") and self.op(k - 2, "#"):
            return
        if t.kind == "name" and t.text.lower() not in self.keywords:
            self.out.calls(t.text, None, t.start)
        self._hook(k)

    def _binding(self, k: int) -> None:
        t = self.at(k)
        if t.kind == "name" and t.text.lower() == "foreach" and self.op(k + 1, "("):
            end = self.match.get(k + 1, len(self.t))
            split = next((j for j in range(k + 2, end) if self.is_(j, "as")), None)
            if split:
                for a, b in ((k + 2, split), (split + 1, end)):
                    a += self.op(a, "&")
                    if b == a + 1 and self.at(a).kind == "var":
                        self.out.binds(self.at(a).text[1:], "", self.at(a).start + 1, "shadow")
        if t.kind == "name" and t.text == "fn" and self.op(k + 1, "("):
            self._parameters(k + 1)
        if t.kind == "var" and self.op(k + 1, "=") and not self.op(k - 1, "->", "::", "?->", "$"):
            self.out.binds(t.text[1:], "", t.start + 1, "shadow")
            if self.is_(k + 2, "new") and self.word(k + 3) and self.at(k + 3).text.lower() not in ("class", "static", "self", "parent"):
                after = self.over(k + 4) if self.op(k + 4, "(") else k + 4
                if not self.op(after, "->", "::", "?->"):
                    self.out.binds(t.text[1:], self.at(k + 3).text, self.at(k + 3).start)

    def _constant(self, k: int) -> None:
        t = self.at(k)
        if t.kind != "name":
            return
        if t.text.lower() == "const" and not self.op(k - 1, "::", "->"):
            j = k + 1
            while j < len(self.t) and not self.op(j, ";"):
                if self.word(j) and self.op(j + 1, "="):
                    if self.at(j + 2).kind == "str" and self.at(j + 2).value is not None and self.op(j + 3, ",", ";"):
                        owner = self.owner(k)
                        self.out.binds(f"{owner}::{self.at(j).text}" if owner else self.at(j).text, self.at(j + 2).value, self.at(j).start, "const")
                    while j < len(self.t) and not self.op(j, ",", ";"):
                        j = self.over(j) if self.op(j, "(", "[") else j + 1
                    continue
                j += 1
        elif t.text == "define" and self.op(k + 1, "(") and not self.op(k - 1, "->", "::"):
            args = self.arguments(k + 1)
            if len(args) >= 2:
                name, value = (self.literal(*a) for a in args[:2])
                if name and value is not None:
                    self.out.binds(name, value, t.start, "const")

    # --- hooks ---
    def literal(self, a: int, b: int) -> str | None:
        return self.at(a).value if b == a + 1 and self.at(a).kind == "str" else None

    def value(self, a: int, b: int) -> tuple[int, int]:
        """An argument without its name label."""
        return (a + 2, b) if self.word(a) and self.op(a + 1, ":") else (a, b)

    def elements(self, a: int, b: int) -> list[tuple[tuple[int, int] | None, tuple[int, int]]] | None:
        """(key, value) ranges of an array literal."""
        if self.op(a, "[") and self.over(a) == b:
            parts = self.arguments(a)
        elif self.is_(a, "array") and self.op(a + 1, "(") and self.over(a + 1) == b:
            parts = self.arguments(a + 1)
        else:
            return None
        out = []
        for x, y in parts:
            arrow = self.split(x, y, "=>")
            out.append((arrow[0], (arrow[1][0], y)) if len(arrow) >= 2 else (None, (x, y)))
        return out

    def callback(self, a: int, b: int) -> dict:
        raw = self.text_of(a, b)
        as_ = lambda kind, name=None, container=None, recv=None: {"cb_kind": kind, "cb_name": name, "cb_container": container, "cb_recv": recv, "cb_raw": raw}
        if self.at(a).kind == "str" and b == a + 1:
            s = self.at(a).value
            if s is None:
                return as_("dynamic")
            if "::" in s:
                cls, _, name = s.partition("::")
                return as_("static", name, cls)
            return as_("free", s)
        if self.is_(a, "function", "fn") or self.is_(a, "static") and self.is_(a + 1, "function", "fn"):
            return as_("closure")
        parts = self.elements(a, b)
        if parts and len(parts) >= 2:
            (x, y), method = parts[0][1], self.literal(*parts[1][1])
            if method is not None:
                if y == x + 1 and self.at(x).kind == "var":
                    v = self.at(x).text[1:]
                    return as_("method_self", method) if v == "this" else as_("method", method, None, v)
                if y == x + 1 and self.at(x).kind == "str":
                    return as_("static", method, self.literal(x, y))
                if y == x + 3 and self.op(x + 1, "::") and self.is_(x + 2, "class"):
                    scope = self.at(x).text
                    if scope in ("self", "static"):
                        return as_("method_self", method)
                    return as_("method", method) if scope == "parent" else as_("static", method, scope)
        return as_("dynamic")

    def _expression(self, a: int, b: int) -> str:
        s = self.literal(a, b)
        if s is not None:
            return s
        # constants joined with literals read as one name; anything else stays as written
        parts = self.split(a, b, ".")
        if len(parts) > 1 and all(self.literal(x, y) is not None or self._is_constant(x, y) for x, y in parts):
            return "".join(self.literal(x, y) if self.literal(x, y) is not None else self.text_of(x, y) for x, y in parts)
        return self.text_of(a, b)

    def _is_constant(self, a: int, b: int) -> bool:
        return b == a + 1 and self.at(a).kind in ("name", "qname") or b == a + 3 and self.op(a + 1, "::") and self.word(a + 2)

    def _hook(self, k: int) -> None:
        fn = self.at(k).text.rsplit("\\", 1)[-1]
        if fn not in L.PHP_LISTEN + L.PHP_FIRE + L.PHP_REST:
            return
        args = [self.value(*a) for a in self.arguments(k + 1)]
        at = self.at(k).start
        if fn in L.PHP_FIRE:
            self.out.dispatches("fire", self.literal(*args[0]) if args else None, "fire", at)
        elif fn in L.PHP_LISTEN and len(args) >= 2:
            self.out.dispatches("listen", self.literal(*args[0]), "filter" if fn == "add_filter" else "action", at, **self.callback(*args[1]))
        elif fn in L.PHP_REST and len(args) >= 3:
            options = {self.literal(*key): value for key, value in self.elements(*args[2]) or [] if key}
            if "callback" not in options:
                return
            perm = options.get("permission_callback")
            text = self.text_of(*perm) if perm else ""
            open_ = perm is None or (self.literal(*perm) or "").lstrip("\\") == "__return_true"
            self.out.dispatches("listen", self._expression(*args[0]) + self._expression(*args[1]), "rest", at, entry_point=True, unauth=open_, note=f"permission={text[:40]}" if perm else "no permission_callback", **self.callback(*options["callback"]))


class Go(Walk):
    dialect = "go"
    keywords = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())

    def run(self) -> Parsed:
        self.names: set[int] = set()
        for k in range(len(self.t)):
            if self.is_(k, "func"):
                self._func(k)
            elif self.is_(k, "type") and self.at(k).kind == "name":
                self._types(k)
            elif self.is_(k, "import"):
                j, end = k + 1, self.over(k + 1) if self.op(k + 1, "(") else k + 3
                self.out.uses(*[self.at(i).text.strip("'\"`") for i in range(j, end) if self.at(i).kind == "str" and self.at(i).text[0] == '"'])
            elif self.is_(k, "var"):
                self._vars(k)
            elif self.op(k, ":="):
                self._short(k)
        for k, t in enumerate(self.t):
            if t.kind == "name" and t.text not in self.keywords and self.op(k + 1, "(") and k not in self.names:
                if self.op(k - 1, "."):
                    first = self.operand_start(k)
                    self.out.calls(t.text, self.text_of(first, k - 1).strip(), t.start)
                elif not self.is_(k - 1, "func"):
                    self.out.calls(t.text, None, t.start)
        return self.out

    def _func(self, k: int) -> None:
        n, receiver = k + 1, None
        if self.op(n, "("):
            receiver, n = n, self.over(n)
            if not self.word(n) or not self.op(n + 1, "(", "["):
                return
        if not self.word(n):
            return
        p = self.over(n + 1) if self.op(n + 1, "[") else n + 1
        if not self.op(p, "("):
            return
        self.names.add(n)
        j = self.over(p)
        while j < len(self.t) and not self.op(j, "{") and "\n" not in self.s[self.at(j - 1).end : self.at(j).start]:
            if self.is_(j, "interface", "struct") and self.op(j + 1, "{"):
                j = self.over(j + 1)
                continue
            j = self.over(j) if self.op(j, "(", "[") else j + 1
        end = self.over(j) if self.op(j, "{") else j
        container = None
        if receiver is not None:
            a, b = receiver + 1, self.match.get(receiver, receiver + 1)
            var = self.at(a).text if self.word(a) and not self.op(a + 1, ".", "[") and b > a + 1 else None
            container = self.text_of(a + (var is not None), b).lstrip("*").strip() or None
            if container and var:
                self.out.binds(var, container, self.at(k).start)
        self.symbol(self.at(n).text, "method" if receiver is not None else "function", container, k, end)

    def _line_end(self, k: int) -> int:
        j = k
        while j < len(self.t) and not (j > k and "\n" in self.s[self.at(j - 1).end : self.at(j).start]) and not self.op(j, ";", ")"):
            j = self.over(j) if self.op(j, "{", "(", "[") else j + 1
        return j

    def _specs(self, k: int):
        """Ranges of the specs of a declaration, grouped or not."""
        if not self.op(k + 1, "("):
            yield k + 1, self._line_end(k + 1)
            return
        j, end = k + 2, self.match.get(k + 1, len(self.t))
        while j < end:
            stop = min(end, max(j + 1, self._line_end(j)))
            yield j, stop
            j = stop + self.op(stop, ";")

    def _types(self, k: int) -> None:
        for a, b in self._specs(k):
            if self.word(a) and not self.op(a + 1, "=") and b > a + 1:
                self.symbol(self.at(a).text, "class", None, a, b)

    def _composite(self, k: int) -> int | None:
        """The token that names the type of a composite literal at k, with or without &."""
        k += self.op(k, "&")
        return k if self.word(k) and self.at(k).text not in self.keywords and self.op(k + 1, "{") else None

    def _vars(self, k: int) -> None:
        for a, b in self._specs(k):
            if not self.word(a):
                continue
            if self.word(a + 1) and not self.op(a + 2, ".", "["):
                self.out.binds(self.at(a).text, self.at(a + 1).text, self.at(a + 1).start)
            eq = next((j for j in range(a, b) if self.op(j, "=")), None)
            if eq is not None and self.word(eq + 1) and self.op(eq + 2, "{"):
                self.out.binds(self.at(a).text, self.at(eq + 1).text, self.at(eq + 1).start)

    def _short(self, k: int) -> None:
        a = k - 1
        while self.op(a - 1, ","):
            a -= 2
        for x, _ in self.split(k + 1, self._line_end(k + 1)):
            c = self._composite(x)
            if c is not None:
                self.out.binds(self.text_of(a, k).strip(), self.at(c).text, self.at(c).start)


def parse(text: str, lang: str) -> Parsed:
    return {"php": Php, "go": Go}.get(lang, Script)(text, lang).run()
