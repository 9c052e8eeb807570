"""Python facts from the standard library's syntax tree."""

from __future__ import annotations

import ast
import warnings

from callweave.functions import languages as L
from callweave.parse.rows import Parsed, line_starts


def _tree(text: str, out: Parsed) -> ast.Module | None:
    """The tree; lines that do not parse are blanked one after another, which keeps all positions."""
    lines = text.split("\n")
    for _ in range(200):
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                return ast.parse("\n".join(lines))
        except SyntaxError as e:
            at = min(max((e.lineno or 1) - 1, 0), len(lines) - 1)
            while at > 0 and not lines[at].strip():
                at -= 1
            bad = lines[at]
            if not out.warnings:
                out.warnings.append(f"line {at + 1} does not parse")
            body = bad.strip()
            if not body:
                return None
            pad = len(bad) - len(bad.lstrip())
            size = len(bad.encode())
            blank = " " * pad + "pass" if body != "pass" and size >= pad + 4 else ""
            lines[at] = blank.ljust(size)
        except (ValueError, RecursionError, MemoryError):
            return None
    return None


class _Visitor:
    def __init__(self, content: bytes, out: Parsed):
        self.content, self.out = content, out
        self.line = line_starts(content)

    def start(self, n: ast.AST) -> int:
        return self.line[n.lineno - 1] + n.col_offset

    def end(self, n: ast.AST) -> int:
        return self.line[n.end_lineno - 1] + n.end_col_offset

    def text(self, n: ast.AST) -> str:
        return self.content[self.start(n) : self.end(n)].decode("utf-8", "replace")

    # the explicit stack holds (node, name of the nearest class)
    def walk(self, tree: ast.Module) -> None:
        todo: list[tuple[ast.AST, str | None]] = [(tree, None)]
        while todo:
            node, owner = todo.pop()
            f = getattr(self, "on_" + type(node).__name__, None)
            inner = owner
            if f:
                f(node, owner)
            if isinstance(node, ast.ClassDef):
                inner = node.name
                # decorators, bases and keywords stand inside the class node but not inside its own scope's name
                for x in (*node.decorator_list, *node.bases, *node.keywords, *getattr(node, "type_params", [])):
                    todo.append((x, owner))
                todo += [(x, inner) for x in reversed(node.body)]
                continue
            todo += [(x, inner) for x in reversed(list(ast.iter_child_nodes(node)))]

    def _definition(self, node, kind: str, owner: str | None) -> None:
        self.out.defines(node.name, kind, owner, self.start(node), self.end(node))

    def on_ClassDef(self, node, owner) -> None:
        self._definition(node, "class", owner)

    def on_FunctionDef(self, node, owner) -> None:
        self._definition(node, "method" if owner else "function", owner)
        self._parameters(node.args, False)
        for dec in node.decorator_list:
            self._decorator(dec, node)

    on_AsyncFunctionDef = on_FunctionDef

    def on_Lambda(self, node, owner) -> None:
        self._parameters(node.args, True)

    def _parameters(self, args: ast.arguments, plain: bool) -> None:
        for a in (*args.posonlyargs, *args.args, *args.kwonlyargs):
            at = self.start(a)
            if a.annotation is None:
                self.out.binds(a.arg, "", at, "shadow")
            else:
                self._hint(a.arg, a.annotation, at)

    def _hint(self, var: str, annotation: ast.expr, at: int) -> None:
        named = isinstance(annotation, ast.Name)
        self.out.binds(var, annotation.id if named else "", at, "hint" if named else "shadow")

    def _bind(self, target: ast.expr | None) -> None:
        if isinstance(target, ast.Name):
            self.out.binds(target.id, "", self.start(target), "shadow")

    def _construct(self, target: ast.expr, value: ast.expr | None) -> None:
        if isinstance(target, ast.Name) and isinstance(value, ast.Call) and isinstance(value.func, ast.Name):
            self.out.binds(target.id, value.func.id, self.start(value.func))

    def on_Assign(self, node, owner) -> None:
        for t in node.targets:
            self._bind(t)
        self._construct(node.targets[-1], node.value)

    def on_AnnAssign(self, node, owner) -> None:
        self._bind(node.target)
        self._construct(node.target, node.value)
        if isinstance(node.target, ast.Name):
            self._hint(node.target.id, node.annotation, self.start(node))

    def on_For(self, node, owner) -> None:
        self._bind(node.target)

    on_AsyncFor = on_For

    def on_withitem(self, node, owner) -> None:
        self._bind(node.optional_vars)

    def on_ExceptHandler(self, node, owner) -> None:
        if node.name:
            after = self.end(node.type) if node.type else self.start(node)
            at = self.content.find(node.name.encode(), after)
            self.out.binds(node.name, "", at if at >= 0 else self.start(node), "shadow")

    def on_MatchAs(self, node, owner) -> None:
        if node.name and node.pattern is not None:
            self.out.binds(node.name, "", self.end(node) - len(node.name.encode()), "shadow")

    def on_Import(self, node, owner) -> None:
        self.out.uses(*[a.name for a in node.names])

    def on_ImportFrom(self, node, owner) -> None:
        if node.module and not node.level:
            self.out.uses(node.module)

    def on_Call(self, node, owner) -> None:
        f = node.func
        if isinstance(f, ast.Name):
            self.out.calls(f.id, None, self.start(f))
            if f.id in L.PY_ROUTE_CALLS:
                self._route_call(node)
        elif isinstance(f, ast.Attribute):
            self.out.calls(f.attr, self.text(f.value).strip(), self.end(f) - len(f.attr.encode()))
            self._dispatch(node, f)

    # --- string dispatch ---
    @staticmethod
    def tail(node: ast.AST | None) -> str | None:
        return node.id if isinstance(node, ast.Name) else node.attr if isinstance(node, ast.Attribute) else None

    @staticmethod
    def callback(node: ast.AST | None) -> tuple[str | None, str | None]:
        if isinstance(node, ast.Name):
            return "free", node.id
        if isinstance(node, ast.Attribute):
            return ("method_self" if isinstance(node.value, ast.Name) and node.value.id == "self" else "method"), node.attr
        return None, None

    @staticmethod
    def literal(node: ast.AST | None) -> str | None:
        return node.value if isinstance(node, ast.Constant) and isinstance(node.value, str) else None

    def _dispatch(self, node: ast.Call, f: ast.Attribute) -> None:
        on, at = self.tail(f.value), self.start(node)
        if not on:
            return
        if f.attr in L.PY_SEND:
            self.out.dispatches("fire", on, "fire", at, note="signal")
        elif f.attr in L.PY_TASK_FIRE:
            self.out.dispatches("fire", on, "fire", at, note="task")
        elif f.attr in L.PY_CONNECT:
            given = node.args[0] if node.args else next((k.value for k in node.keywords if k.arg == "receiver"), None)
            kind, name = self.callback(given)
            if name:
                self.out.dispatches("listen", on, "signal", at, cb_kind=kind, cb_name=name, note="connect")

    def _route_call(self, node: ast.Call) -> None:
        if len(node.args) >= 2:
            kind, name = self.callback(node.args[1])
            if name:
                self.out.dispatches("listen", self.literal(node.args[0]) or name, "route", self.start(node), cb_kind=kind, cb_name=name, entry_point=True, note="route")

    def _decorator(self, dec: ast.expr, node) -> None:
        call = isinstance(dec, ast.Call)
        name, args = self.tail(dec.func if call else dec), dec.args if call else []
        at = self.start(node)
        listen = lambda hook, cls, note, entry=False: self.out.dispatches("listen", hook, cls, at, cb_kind="free", cb_name=node.name, entry_point=entry, note=note, line_at=self.start(dec))
        if name in L.PY_RECEIVER_DECORATORS:
            first = args[0] if args else None
            for s in first.elts if isinstance(first, (ast.List, ast.Tuple)) else [first]:
                if self.tail(s):
                    listen(self.tail(s), "signal", "@receiver")
        elif name in L.PY_TASK_DECORATORS:
            listen(node.name, "task", "@task")
        elif name in L.PY_ROUTE_DECORATORS:
            listen((self.literal(args[0]) if args else None) or node.name, "route", "route", True)


def parse(content: bytes) -> Parsed:
    out = Parsed()
    text = content.decode("utf-8", "surrogateescape").replace("\r\n", " \n").replace("\r", "\n").replace("\x0c", " ").replace("\0", " ")
    bom = text.startswith("\ufeff")
    try:
        raw = text.encode("utf-8", "surrogateescape")
        raw.decode("utf-8")
    except UnicodeDecodeError:
        # a byte that is not UTF-8 becomes a letter of the same length
        text = "".join("?" if "\udc80" <= c <= "\udcff" else c for c in text)
        raw = text.encode()
    if bom:
        text = text[1:]
        raw = raw[3:]
    tree = _tree(text, out)
    if tree is None:
        out.warnings.append("nothing could be parsed")
        return out
    _Visitor(raw, out).walk(tree)
    if bom:
        out.moved(lambda at: at + 3)
    return out
