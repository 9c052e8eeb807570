"""Rows of the fact tables as the parsers fill them, in the columns of callweave.model."""

from __future__ import annotations

import hashlib
import struct
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable

from callweave.model import FACTS

#: What a file gives: table -> its columns.
COLUMNS = {t: [c.split()[0] for c in ddl.split(", ")] for t, ddl in FACTS.items() if t != "files"}


def line_starts(content: bytes) -> list[int]:
    """Positions at which the lines begin."""
    out, at = [0], content.find(b"\n")
    while at >= 0:
        out.append(at + 1)
        at = content.find(b"\n", at + 1)
    return out


def innermost(spans: list[tuple[int, int]]) -> Callable[[int], int | None]:
    """A function from a position to the number of the shortest span around it; spans nest, except after broken code."""
    order = sorted(range(len(spans)), key=lambda k: (spans[k][0], -spans[k][1]))
    starts = [spans[k][0] for k in order]
    outer, open_ = [], []
    for n, k in enumerate(order):
        while open_ and spans[order[open_[-1]]][1] <= spans[k][0]:
            open_.pop()
        outer.append(open_[-1] if open_ else -1)
        open_.append(n)

    def find(at: int) -> int | None:
        n, hits = bisect_right(starts, at) - 1, []
        while n >= 0:
            a, b = spans[order[n]]
            if a <= at < b:
                hits.append((b - a, order[n]))
            n = outer[n]
        return min(hits)[1] if hits else None

    return find


def key(file: str, *parts: object) -> int:
    """A 64-bit id that depends on the position only."""
    return struct.unpack("<q", hashlib.blake2b("\0".join(map(str, (file, *parts))).encode("utf-8", "surrogatepass"), digest_size=8).digest())[0]


class Parsed:
    """The rows of one file.  Besides its table's columns a row holds `at`, the position that names it.

    Ids, lines and enclosing definitions need the whole file; `finished` fills them in.
    """

    def __init__(self, *warnings: str):
        self.rows: dict[str, list[dict]] = {t: [] for t in COLUMNS}
        self.warnings = list(warnings)

    def _add(self, table: str, at: int, **values) -> None:
        self.rows[table].append(dict.fromkeys(COLUMNS[table]) | values | {"at": at})

    def defines(self, name: str, kind: str, container: str | None, start: int, end: int) -> None:
        self._add("symbols", start, name=name, kind=kind, container=container, start_byte=start, end_byte=end)

    def calls(self, callee: str, receiver: str | None, at: int) -> None:
        self._add("refs", at, callee=callee, receiver=receiver)

    def binds(self, var: str, cls: str, at: int, kind: str = "construct") -> None:
        self._add("assigns", at, var=var, cls=cls, kind=kind)

    def uses(self, *modules: str) -> None:
        for m in modules:
            self._add("imports", 0, module=m)

    def dispatches(self, kind: str, hook: str | None, hook_class: str, at: int, line_at: int | None = None, **more) -> None:
        """A hook; `more` holds its callback (cb_...), entry_point, unauth and note."""
        self._add("hooks", at, **({"entry_point": False, "unauth": False, "note": ""} | more), kind=kind, hook=hook, hook_raw=hook, hook_class=hook_class, line=at if line_at is None else line_at)

    def moved(self, to: Callable[[int], int]) -> None:
        """Maps every position, e.g. from characters to bytes."""
        for table, rows in self.rows.items():
            for r in rows:
                for c in ("at", "start_byte", "end_byte", *(("line",) if table == "hooks" else ())):
                    if r.get(c) is not None:
                        r[c] = to(r[c])

    def finished(self, file: str, lang: str, content: bytes) -> dict[str, list[dict]]:
        """The rows with all columns.  Ids hash (file, position, names), so they survive a re-index."""
        starts = line_starts(content)
        line = lambda at: bisect_right(starts, at)
        symbols = self.rows["symbols"]
        inside = innermost([(s["start_byte"], s["end_byte"]) for s in symbols])
        twins: Counter = Counter()
        for s in symbols:
            a, b = s["start_byte"], s["end_byte"]
            head = content[a:b].decode("utf-8", "replace").splitlines()
            s |= {"id": key(file, a, b, s["kind"], s["name"]), "start_line": line(a), "end_line": line(max(a, b - 1)), "signature": head[0].strip()[:200] if head else ""}

        def around(r: dict) -> int | None:
            k = inside(r["at"])
            return None if k is None else symbols[k]["id"]

        def own(table: str, *what) -> int:
            """An id; of equal rows at one place each has its own."""
            twins[what] += 1
            return key(file, table, *what, twins[what] - 1)

        for r in self.rows["refs"]:
            r |= {"id": own("ref", r["at"], r["callee"]), "line": line(r["at"]), "src_symbol": around(r)}
        for r in self.rows["assigns"]:
            r |= {"scope_symbol": around(r)}
        for r in self.rows["hooks"]:
            r |= {"id": own("hook", r["at"], r["kind"], r["hook"], r["note"]), "line": line(r["line"]), "enclosing_symbol": around(r)}
        common = {"file": file, "lang": lang}
        return {t: [{c: common.get(c, r.get(c)) for c in COLUMNS[t]} for r in rows] for t, rows in self.rows.items()}
