"""Error-correcting chart parsing over token classes, with bracketed groups as nested inputs.

A grammar is written as text. A bracketed group is one token whose content is parsed on its
own by the rule that its place in the grammar names, so that inputs stay short and the charts
of equal token sequences are shared by all files a worker sees. A chart entry holds, for a
rule and a start, the cheapest cost of each end; an edit inserts, drops or replaces a token.
"""

from __future__ import annotations

import re

import numpy as np

#: Edits are first sought so many tokens before the farthest point, then everywhere. Costs of more than FEW edits come from
#: whole tables of costs, which take no longer for more edits.
NEAR, FEW = 32, 4
_NEVER = 1 << 28

#: Kinds of groups by their opening bracket; B is an indented block.
GROUPS = {"(": "P", "[": "S", "{": "C", "B": "B"}
_GRAMMAR_TOKEN = re.compile(r"\s*(?:'([^']+)'|([PSCB]):(\w+)|(\w+)|([|()*+?]))")


class Grammar:
    """Rules `name = alternatives`, one per line (lines that begin with a blank go on).

    'x' is the token x, NAME a token class, P:rule, S:rule, C:rule and B:rule a group in round
    or square brackets or braces or an indented block whose content is rule; ( ) | * + ? as
    usual. `lists` names rules whose input is cut by `cut` into pieces that are each `piece*`.
    """

    def __init__(self, text: str, lists: dict[str, str], cut):
        self.rules: dict[str, int] = {}
        self.nodes: list[tuple] = []
        self.names: list[str] = []
        self.lists, self.cut = lists, cut
        self.keywords: set[str] = set()
        self._far = self._from = self._to = 0
        body = re.sub(r"\n[ \t]+", " ", "\n" + text).strip()
        lines = [x.split("=", 1) for x in body.split("\n") if x.strip() and not x.startswith("#")]
        for name, _ in lines:
            self._rule(name.strip())
        for name, right in lines:
            tokens = [m.groups() for m in _GRAMMAR_TOKEN.finditer(right)]
            node, rest = self._alternatives(tokens)
            assert not rest, (name, rest)
            self.nodes[self.rules[name.strip()]] = ("rule", node)
        for name in lists:
            self._rule(name)
        self.good: dict[tuple, bool] = {}
        self.costs: dict[tuple, int] = {}
        self.contents: dict[tuple, int] = {}
        self.by_id: list[tuple] = []

    def prepare(self) -> None:
        """Find which tokens each node can begin with, and whether it can be empty."""
        n = len(self.nodes)
        self.first: list[set] = [set() for _ in range(n)]
        self.empty = [False] * n
        changed = True
        while changed:
            changed = False
            for k, node in enumerate(self.nodes):
                op, first, empty = node[0], self.first[k], self.empty[k]
                before = len(first), empty
                if op == "is":
                    first |= self.keywords if node[1] == "KEYWORD" else {node[1], "~" + node[1]}
                    empty = node[1] == "EOS"
                elif op == "group":
                    first.add((node[1],))
                elif op == "rule":
                    if node[1] is not None:
                        first |= self.first[node[1]]
                        empty = self.empty[node[1]]
                elif op == "and":
                    empty = True
                    for part in node[1]:
                        first |= self.first[part]
                        if not self.empty[part]:
                            empty = False
                            break
                elif op == "or":
                    for part in node[1]:
                        first |= self.first[part]
                        empty = empty or self.empty[part]
                else:
                    first |= self.first[node[1]]
                    empty = op != "+" or self.empty[node[1]]
                self.empty[k] = empty
                changed = changed or before != (len(first), empty)

    def _begins(self, node: int, token) -> bool:
        first = self.first[node]
        if type(token) is tuple:
            return (token[0],) in first
        return token in first or token[0] == "~" and "ID" in first

    def _rule(self, name: str) -> int:
        if name not in self.rules:
            self.rules[name] = len(self.nodes)
            self.nodes.append(("rule", None))
        return self.rules[name]

    def _add(self, node: tuple) -> int:
        self.nodes.append(node)
        return len(self.nodes) - 1

    def _alternatives(self, t):
        options = []
        while True:
            seq, t = self._sequence(t)
            options.append(seq)
            if not t or t[0][4] != "|":
                break
            t = t[1:]
        return (options[0] if len(options) == 1 else self._add(("or", tuple(options)))), t

    def _sequence(self, t):
        parts = []
        while t and t[0][4] not in ("|", ")"):
            quoted, group, content, name, mark = t[0]
            if mark == "(":
                node, t = self._alternatives(t[1:])
                assert t and t[0][4] == ")", t
                t = t[1:]
            else:
                t = t[1:]
                if quoted is not None:
                    node = self._add(("is", quoted))
                elif group:
                    node = self._add(("group", group, content))
                elif name.isupper():
                    node = self._add(("is", name))
                else:
                    node = self._rule(name)
            while t and t[0][4] in ("*", "+", "?"):
                node = self._add((t[0][4], node))
                t = t[1:]
            parts.append(node)
        return (parts[0] if len(parts) == 1 else self._add(("and", tuple(parts)))), t

    def intern(self, content: tuple) -> int:
        k = self.contents.get(content)
        if k is None:
            k = self.contents[content] = len(self.by_id)
            self.by_id.append(content)
        return k

    def forget(self) -> None:
        """Drop what was remembered; for long-lived workers."""
        self.good.clear()
        self.costs.clear()
        self.contents.clear()
        self.by_id.clear()

    def fits(self, rule: str, content: tuple) -> bool:
        """Whether content is a `rule` without any edit."""
        key = (rule, content)
        known = self.good.get(key)
        if known is None:
            if rule == "any":
                known = True
            elif rule in self.lists:
                known = all(self.fits(self.lists[rule], piece) for piece in self.cut(content))
            else:
                known = len(content) in self._match(self.rules[rule], 0, 0, content, {})
            self.good[key] = known
        return known

    def cost(self, rule: str, content: tuple, most: int | None = None) -> int:
        """The least number of edits that make content a `rule`, of a list the sum over its pieces; with `most`, most + 1 stands for all that are greater."""
        if self.fits(rule, content):
            return 0
        key = (rule, content)
        known, below = self.costs.get(key, (None, 0))
        if known is not None:
            return known if most is None else min(known, most + 1)
        if most is not None and below >= most:
            return most + 1
        if rule in self.lists:
            known = 0
            for piece in self.cut(content):
                known += self.cost(self.lists[rule], piece, None if most is None else most - known)
                if most is not None and known > most:
                    break
        else:
            known = self._repair(self.rules[rule], content, below, most)
        over = most is not None and known > most
        self.costs[key] = (None, most) if over else (known, 0)
        return most + 1 if over else known

    def _repair(self, start: int, seq: tuple, below: int, most: int | None) -> int:
        """The least cost, which is more than `below`; most + 1 if it is more than `most`."""
        n = len(seq)
        outer = self._far, self._from, self._to
        self._far = 0
        self._match(start, 0, 0, seq, {})
        # With fewer edits no chart goes beyond the farthest token, so that one more edit lies there or before it.
        self._to = self._far
        best, k = None, 0
        while best is None and k < (FEW if most is None else min(most, FEW)):
            k += 1
            # Few tokens back first: what is found there with k edits is least, as fewer were not enough anywhere.
            for self._from in dict.fromkeys((max(0, self._to - NEAR), 0)):
                ends = self._match(start, 0, k, seq, {})
                best = min((c + n - e for e, c in ends.items() if c + n - e <= k), default=None)
                if best is not None:
                    break
            self._to = max(self._to, self._far)
        self._far, self._from, self._to = outer
        if best is None and (most is None or most > FEW):
            best = self._least(start, seq)
        return best if best is not None and (most is None or best <= most) else most + 1

    def _least(self, start: int, seq: tuple) -> int:
        """The least cost with any number of edits: for each node a table of costs by start and end, until none gets smaller."""
        n = len(seq)
        i, e = np.indices((n + 1, n + 1), dtype=np.int32)
        nothing = np.where(i == e, 0, _NEVER).astype(np.int32)
        order, seen, parents = [], {start}, {}
        todo = [(start, iter(self._parts(start)))]
        while todo:  # parts before wholes
            node, parts = todo[-1]
            for part in parts:
                parents.setdefault(part, set()).add(node)
                if part not in seen:
                    seen.add(part)
                    todo.append((part, iter(self._parts(part))))
                    break
            else:
                order.append(node)
                todo.pop()
        tables, stale = {k: np.full((n + 1, n + 1), _NEVER, np.int32) for k in order}, set(order)
        while stale:
            for node in order:
                if node not in stale:
                    continue
                stale.discard(node)
                kind = self.nodes[node]
                op, old = kind[0], tables[node]
                if op in ("is", "group"):
                    if kind[1] == "EOS":
                        new = np.where(e == n, n - i, _NEVER)
                    else:  # tokens are dropped, and the last one fits or is replaced; or one is inserted
                        last = np.array([0] + [min(1, c) if (c := self._fits(kind, token, 1)) is not None else 1 for token in seq], np.int32)
                        new = np.where(e > i, e - i - 1 + last[e], np.where(e == i, 1, _NEVER))
                elif op == "rule":
                    new = tables[kind[1]]
                elif op == "and":
                    new = tables[kind[1][0]]
                    for part in kind[1][1:]:
                        new = _chained(new, tables[part])
                elif op == "or":
                    new = np.minimum.reduce([tables[part] for part in kind[1]])
                else:
                    new = np.minimum(nothing, tables[kind[1]])
                    while op != "?" and (more := _chained(new, new)).tobytes() != new.tobytes():
                        new = more
                    if op == "+":
                        new = _chained(tables[kind[1]], new)
                new = np.minimum(old, new).astype(np.int32)
                if (new < old).any():
                    tables[node] = new
                    stale |= parents.get(node, set())
        return int((tables[start][0] + n - np.arange(n + 1)).min())

    def _parts(self, node: int) -> tuple:
        kind = self.nodes[node]
        return () if kind[0] in ("is", "group") else kind[1] if kind[0] in ("and", "or") else (kind[1],)

    def _match(self, node: int, i: int, k: int, seq: tuple, chart: dict) -> dict[int, int]:
        kind = self.nodes[node]
        op = kind[0]
        if i > self._to:
            k = 0
        if (k == 0 or i < self._from) and not self.empty[node]:
            # Without edits here, a node that cannot begin with the next token has no end.
            if i > self._far:
                self._far = i
            if i >= len(seq) or not self._begins(node, seq[i]):
                return {}
        if op == "is" or op == "group":
            return self._terminal(kind, i, k, seq)
        if op == "rule":
            # What is left of the budget is part of the key: a rule comes again at the same place only after an insertion.
            key = (node, i, k)
            known = chart.get(key)
            if known is None:
                chart[key] = {}  # a rule that begins with itself finds nothing more
                known = chart[key] = self._match(kind[1], i, k, seq, chart)
            return known
        if op == "and":
            ends = {i: 0}
            for part in kind[1]:
                step: dict[int, int] = {}
                for e, c in ends.items():
                    for e2, c2 in self._match(part, e, k - c, seq, chart).items():
                        if c + c2 < step.get(e2, 1 << 30):
                            step[e2] = c + c2
                ends = step
                if not ends:
                    return ends
            return ends
        if op == "or":
            out: dict[int, int] = {}
            for part in kind[1]:
                for e, c in self._match(part, i, k, seq, chart).items():
                    if c < out.get(e, 1 << 30):
                        out[e] = c
            return out
        # * + ?
        inner = kind[1]
        out = {} if op == "+" else {i: 0}
        front = dict(self._match(inner, i, k, seq, chart))
        while front:
            fresh = {e: c for e, c in front.items() if c < out.get(e, 1 << 30)}
            out.update(fresh)
            front = {}
            if op == "?":
                break
            for e, c in fresh.items():
                if e > i:
                    for e2, c2 in self._match(inner, e, k - c, seq, chart).items():
                        if e2 > e and c + c2 < front.get(e2, 1 << 30):
                            front[e2] = c + c2
        return out

    def _terminal(self, kind: tuple, i: int, k: int, seq: tuple) -> dict[int, int]:
        n = len(seq)
        if i > self._far:
            self._far = i
        if kind[1] == "EOS":  # the end of the input, which takes no token
            return {i: 0} if i == n else {}
        if k == 0 or i < self._from:
            if i < n and self._fits(kind, seq[i], 0) == 0:
                return {i + 1: 0}
            return {}
        out = {i: 1}  # inserted
        for dropped in range(min(k, n - i - 1) + 1):
            if i + dropped < n:
                c = self._fits(kind, seq[i + dropped], k - dropped)
                if c is not None and c + dropped <= k:
                    out[i + dropped + 1] = min(c + dropped, out.get(i + dropped + 1, 1 << 30))
        if i < n:
            out[i + 1] = min(1, out.get(i + 1, 1))  # replaced
        return out

    def _fits(self, kind: tuple, token, most: int) -> int | None:
        if kind[0] == "is":
            want = kind[1]
            if token == want or token[0] == "~" and (want == "ID" or token[1:] == want) or want == "KEYWORD" and token in self.keywords:
                return 0
            return None
        if type(token) is tuple and token[0] == kind[1]:
            content = self.by_id[token[1]]
            if self.fits(kind[2], content):
                return 0
            if most:
                c = self.cost(kind[2], content, most)
                return c if c <= most else None
        return None


def _chained(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least costs of a, then b."""
    if len(a) <= 48:
        return np.minimum((a[:, :, None] + b[None]).min(1), _NEVER)
    out = np.full_like(a, _NEVER)
    for k in range(len(a)):  # a table has no ends before its starts
        np.minimum(out[: k + 1, k:], a[: k + 1, k, None] + b[k, None, k:], out=out[: k + 1, k:])
    return out
