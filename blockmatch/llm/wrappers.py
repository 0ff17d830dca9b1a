"""Page wrappers as union-free regular expressions, by iterative alignment.

An expression is a sequence of symbols, optional groups ``["?", parts]`` and
repeated groups ``["+", parts]``; a text slot is a symbol like any other, and
there is no choice between alternatives.  A page's own expression is its token
stream with repeats folded into groups.  Two expressions are aligned: what both
have stays, repeated groups are aligned inside, and what only one has becomes an
optional group.  Aligning all pages of a host this way, in any order and in any
tree, gives a wrapper whose language holds every page of the host.

A wrapper is matched as an automaton whose states are the symbols' places, so a
match takes time in proportion to the page and never backtracks.
"""

from __future__ import annotations

import json
from bisect import bisect_left
from collections import Counter

Part = str | list

#: Longest group of parts that is looked for as a repeat.
LONGEST = 16
#: Cells of a table of common subsequences.
CELLS = 250_000


def _is(part: Part, kind: str) -> bool:
    return isinstance(part, list) and part[0] == kind


def _once(part: Part) -> list[Part]:
    return part[1] if _is(part, "+") else [part]


def fold(parts: list[Part]) -> list[Part]:
    """Repeats next to each other become groups, shortest first."""
    size = 1
    while size <= min(LONGEST, len(parts)):
        out: list[Part] = []
        i, folded = 0, False
        while i < len(parts):
            group = parts[i : i + size]
            # A group after its own repeat, or equal groups in a row.
            if out and _is(out[-1], "+") and (out[-1][1] == group or (size == 1 and group == [out[-1]])):
                i += size
                folded = True
                continue
            n = 1
            while i + n * size < len(parts) and parts[i + n * size] == group[0] and parts[i + n * size : i + (n + 1) * size] == group:
                n += 1
            if n > 1 and not (size == 1 and isinstance(group[0], list)):
                out.append(["+", group])
                i += n * size
                folded = True
            else:
                out.append(parts[i])
                i += 1
        parts = out
        size = 1 if folded and size > 1 else size + 1
    return parts


def _alike(a: Part, b: Part) -> bool:
    if a == b:
        return True
    if isinstance(a, list) or isinstance(b, list):
        if _is(a, "?") or _is(b, "?"):
            return _is(a, "?") and _is(b, "?") and _alike(a[1][0], b[1][0])
        return _once(a)[0] == _once(b)[0] and isinstance(_once(a)[0], str) and _is(a, "+") and _is(b, "+")
    return False


def _joined(a: Part, b: Part) -> Part:
    if a == b:
        return a
    return [a[0], align(a[1], b[1])]


def _optional(parts: list[Part]) -> list[Part]:
    return [parts[0]] if len(parts) == 1 and _is(parts[0], "?") else [["?", parts]] if parts else []


def _unfold(a: list[Part], b: list[Part]) -> list[Part]:
    """``a`` with plain occurrences of ``b``'s repeated and optional groups made such groups too."""
    done = set()
    plain = {p for p in a if isinstance(p, str)}
    for group in b:
        if isinstance(group, str) or (isinstance(group[1][0], str) and group[1][0] not in plain) or (text := dumps([group])) in done:
            continue
        done.add(text)
        kind, body = group
        out, i = [], 0
        while i < len(a):
            if a[i] == body[0] and a[i : i + len(body)] == body:
                out.append([kind, body])
                i += len(body)
            else:
                out.append(a[i])
                i += 1
        a = out
    return a


def _key(part: Part) -> str:
    """Equal for parts that are alike."""
    if isinstance(part, str):
        return part
    first = part[1][0]
    return f"{part[0]} {_key(first)}" if part[0] == "?" or isinstance(first, str) else dumps([part])


def _anchors(x: list[Part], y: list[Part]) -> list[tuple[int, int]]:
    """Places of parts that occur once in both, as many as are in the same order in both."""
    keys = [_key(p) for p in x], [_key(p) for p in y]
    once = [{k for k, n in Counter(own).items() if n == 1} for own in keys]
    both = once[0] & once[1]
    at = {k: j for j, k in enumerate(keys[1]) if k in both}
    pairs = [(i, at[k]) for i, k in enumerate(keys[0]) if k in both]
    # Longest increasing run of places in y, by piles.
    tops, piles, before = [], [], [-1] * len(pairs)
    for n, (_, j) in enumerate(pairs):
        k = bisect_left(tops, j)
        before[n] = piles[k - 1] if k else -1
        tops[k:] = [j] if k == len(tops) else [j, *tops[k + 1 :]]
        piles[k:] = [n] if k == len(piles) else [n, *piles[k + 1 :]]
    out, n = [], piles[-1] if piles else -1
    while n >= 0:
        out.append(pairs[n])
        n = before[n]
    return out[::-1]


def align(a: list[Part], b: list[Part]) -> list[Part]:
    """An expression whose language holds both.

    Of two long sequences, places where a part occurs once in both are found first, and what lies between them is aligned by
    longest common subsequences of at most ``CELLS`` cells; without such places it is taken as a mismatch.
    """
    if a == b:
        return a
    a, b = _unfold(a, b), _unfold(b, a)
    head = 0
    while head < min(len(a), len(b)) and _alike(a[head], b[head]):
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and _alike(a[-1 - tail], b[-1 - tail]):
        tail += 1
    before = [_joined(x, y) for x, y in zip(a[:head], b[:head], strict=True)]
    after = [_joined(x, y) for x, y in zip(a[len(a) - tail :], b[len(b) - tail :], strict=True)]
    return before + _middle(a[head : len(a) - tail], b[head : len(b) - tail]) + after


def _middle(x: list[Part], y: list[Part]) -> list[Part]:
    if len(x) * len(y) <= CELLS:
        return _common(x, y)
    found = _anchors(x, y)
    if not found:
        return _optional(x) + _optional(y)
    out: list[Part] = []
    i = j = 0
    for p, q in [*found, (len(x), len(y))]:
        out += _middle(x[i:p], y[j:q])
        if p < len(x):
            out.append(_joined(x[p], y[q]))
        i, j = p + 1, q + 1
    return out


def _common(x: list[Part], y: list[Part]) -> list[Part]:
    """Aligned by a longest common subsequence."""
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        row, below = best[i], best[i + 1]
        for j in range(len(y) - 1, -1, -1):
            row[j] = 1 + below[j + 1] if _alike(x[i], y[j]) else max(below[j], row[j + 1])
    middle: list[Part] = []
    i = j = 0
    only_x: list[Part] = []
    only_y: list[Part] = []

    def mismatch() -> None:
        nonlocal only_x, only_y
        middle.extend(_optional(only_x))
        middle.extend(_optional(only_y))
        only_x, only_y = [], []

    while i < len(x) and j < len(y):
        if _alike(x[i], y[j]):
            mismatch()
            middle.append(_joined(x[i], y[j]))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            only_x.append(x[i])
            i += 1
        else:
            only_y.append(y[j])
            j += 1
    only_x += x[i:]
    only_y += y[j:]
    mismatch()
    return middle


def dumps(parts: list[Part]) -> str:
    return json.dumps(parts, separators=(",", ":"), ensure_ascii=False)


class Wrapper:
    """A wrapper ready to match token streams."""

    def __init__(self, parts: list[Part]) -> None:
        self.symbols: list[str] = []
        follow: list[set[int]] = []

        def build(parts: list[Part]) -> tuple[set[int], set[int], bool]:
            first, last, empty = set(), set(), True
            for part in parts:
                if isinstance(part, str):
                    self.symbols.append(part)
                    follow.append(set())
                    f, z, e = {len(follow) - 1}, {len(follow) - 1}, False
                else:
                    f, z, e = build(part[1])
                    if part[0] == "+":
                        for p in z:
                            follow[p] |= f
                    else:
                        e = True
                for p in last:
                    follow[p] |= f
                first, last, empty = (first | f if empty else first), (last | z if e else z), empty and e
            return first, last, empty

        first, self.last, self.empty = build(parts)
        self.start = self._by_symbol(first)
        self.next = [self._by_symbol(f) for f in follow]

    def _by_symbol(self, places: set[int]) -> dict[str, list[int]]:
        out: dict[str, list[int]] = {}
        for p in sorted(places):
            out.setdefault(self.symbols[p], []).append(p)
        return out

    def match(self, symbols: list[str]) -> list[int] | None:
        """The wrapper's place of each token, or nothing if the page doesn't fit."""
        if not symbols:
            return [] if self.empty else None
        steps: list[dict[int, int]] = []
        active = {p: -1 for p in self.start.get(symbols[0], ())}
        for symbol in symbols[1:]:
            steps.append(active)
            coming: dict[int, int] = {}
            for p in active:
                for q in self.next[p].get(symbol, ()):
                    coming.setdefault(q, p)
            active = coming
            if not active:
                return None
        steps.append(active)
        at = next((p for p in active if p in self.last), None)
        if at is None:
            return None
        out = []
        for step in reversed(steps):
            out.append(at)
            at = step[at]
        return out[::-1]
