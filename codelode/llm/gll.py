"""Generalised LL recognition with a graph-structured stack, over token strings whose bracket groups are folded.

A source text is tokenised; every balanced group becomes one character that stands for its kind and content, so equal
groups are the same character wherever they occur. A grammar's ``{X}``, ``(X)`` and ``[X]`` match such a character if its
content derives X; that question is asked once per distinct content. Dialects are start symbols of one grammar: they
share its tables and its answers.
"""

from __future__ import annotations

import re

#: Characters from here on stand for folded groups.
BASE = 0x30000
#: So many distinct groups, and four times as many answers, are kept; a worker then starts anew.
ROOM = 60_000
CLOSER = {"(": ")", "[": "]", "{": "}", "`": "`"}


class Reject(Exception):
    """The text is not in the language; the message says where it was noticed."""


class Folder:
    """Interns groups: one character for each distinct (kind, content)."""

    def __init__(self) -> None:
        self.chars: dict[tuple[str, str], str] = {}
        self.groups: list[tuple[str, str]] = []

    def fold(self, kind: str, content: str) -> str:
        key = (kind, content)
        c = self.chars.get(key)
        if c is None:
            c = self.chars[key] = chr(BASE + len(self.groups))
            self.groups.append(key)
        return c


class Grammar:
    """Rules as text: ``Name = alternative | alternative`` a line; a line that starts with white space goes on.

    ``'x'`` is a token by its text, an upper-case name a class of tokens, another name a rule; ``{X}`` ``(X)`` ``[X]``
    ```X``` groups; ``?`` ``*`` ``+`` follow a symbol.
    """

    def __init__(self, rules: str) -> None:
        self.token: dict[str, str] = {}
        self.names: dict[str, int] = {}
        self.alts: list[list[tuple]] = []
        self.folder = Folder()
        self.memo: dict[tuple[int, str], bool] = {}
        text = re.sub(r"\n\s+", " ", rules.strip())
        for line in text.split("\n"):
            name, body = line.split(" =", 1)
            nt = self._nt(name.strip())
            self.alts[nt] = [tuple(self._symbol(s) for s in alt.split()) for alt in self._alternatives(body)]
        self._analyse()
        # rules that are a list of items: a concatenation of such lists is one again
        self.lists = {nt for nt, alts in enumerate(self.alts) if len(alts) == 1 and len(alts[0]) == 1 and alts[0][0][0] == "n" and any(k[-1] == "*" and v == alts[0][0][1] for k, v in self.names.items())}
        self.at = self.char("@")
        self.comma = self.char(",")
        # rules that are items with commas between: the item's symbol, and whether a comma may end it
        own: dict[int, tuple[tuple, bool]] = {}
        for nt, alts in enumerate(self.alts):
            for alt in alts:
                if len(alt) == 3 and alt[1] == ("t", self.comma, None) and alt[2] == ("n", nt, None) and (alt[0],) in alts and alt[0][0] == "n":
                    own[nt] = (alt[0], (alt[0], ("t", self.comma, None)) in alts or () in alts)
        self.commas = dict(own)
        for _ in range(3):
            for nt, alts in enumerate(self.alts):
                for alt in alts:
                    if nt not in self.commas and len(alt) == 1 and alt[0][0] == "n" and alt[0][1] in self.commas:
                        self.commas[nt] = self.commas[alt[0][1]]
        self.ends = {self.char(t) for t in (";", "NL")}
        self.goes_on = {self.char(t) for t in ("else", "elif", "elseif", "while", "catch", "finally", "except", "{")}
        self.heads = {self.char(t) for t in ("if", "for", "while", "await")}
        self.begins = {self.char(t) for t in ("if", "for", "foreach", "return", "const", "let", "var", "function", "class", "export", "import", "try", "throw", "switch", "public", "private", "protected", "static", "interface", "abstract", "final", "def", "async", "@")}

    @staticmethod
    def _alternatives(body: str) -> list[str]:
        out, now = [], []
        for part in body.split():
            if part == "|":
                out.append(" ".join(now))
                now = []
            else:
                now.append(part)
        return [*out, " ".join(now)]

    def _nt(self, name: str) -> int:
        if name not in self.names:
            self.names[name] = len(self.alts)
            self.alts.append([])
        return self.names[name]

    def char(self, token: str) -> str:
        """The character of a token's text or class."""
        if token not in self.token:
            self.token[token] = chr(0x100 + len(self.token)) if token not in CLOSER else token
        return self.token[token]

    def _symbol(self, s: str) -> tuple:
        if s[-1] in "?*+" and len(s) > 1 and not (s[0] == "'" and s[-1] == "'"):
            inner, kind = s[:-1], s[-1]
            nt = self.names.get(s)
            if nt is None:
                nt = self._nt(s)
                one = self._symbol(inner)
                if kind == "?":
                    self.alts[nt] = [(one,), ()]
                elif kind == "*":
                    self.alts[nt] = [(one, ("n", nt, None)), ()]
                else:
                    self.alts[nt] = [(one, self._symbol(inner + "*"))]
            return ("n", nt, None)
        if s[0] == "'":
            return ("t", self.char(s[1:-1]), None)
        if s[0] in "([{`" and len(s) > 2:
            return ("g", s[0], self._nt(s[1:-1]))
        if s.isupper():
            return ("t", self.char(s), None)
        return ("n", self._nt(s), None)

    def _analyse(self) -> None:
        n = len(self.alts)
        for name, nt in self.names.items():
            if not self.alts[nt]:
                raise ValueError(f"no rule for {name}")
        null, first, follow = [False] * n, [set() for _ in range(n)], [set() for _ in range(n)]

        def starts(seq: tuple) -> tuple[set, bool]:
            out: set = set()
            for sym in seq:
                if sym[0] != "n":
                    out.add(sym[1])
                    return out, False
                out |= first[sym[1]]
                if not null[sym[1]]:
                    return out, False
            return out, True

        changed = True
        while changed:
            changed = False
            for nt in range(n):
                for alt in self.alts[nt]:
                    f, e = starts(alt)
                    if not f <= first[nt] or (e and not null[nt]):
                        first[nt] |= f
                        null[nt] |= e
                        changed = True
        changed = True
        inner = {sym[2] for alts in self.alts for alt in alts for sym in alt if sym[0] == "g"}
        for nt in inner:
            follow[nt].add("\0")
        for nt in range(n):
            follow[nt] |= {"\0"} if nt in self.names.values() else set()
        while changed:
            changed = False
            for nt in range(n):
                for alt in self.alts[nt]:
                    for i, sym in enumerate(alt):
                        if sym[0] == "n":
                            f, e = starts(alt[i + 1 :])
                            if e:
                                f |= follow[nt]
                            if not f <= follow[sym[1]]:
                                follow[sym[1]] |= f
                                changed = True
        # for each rule and next kind: the alternatives worth trying; () for those that only derive nothing
        self.predict: list[dict[str, list[tuple]]] = []
        for nt in range(n):
            table: dict[str, list[tuple]] = {}
            for alt in self.alts[nt]:
                f, e = starts(alt)
                for t in f | (follow[nt] if e else set()):
                    if t not in f:
                        alt_ = ()  # what is left derives the empty string
                    else:
                        alt_ = alt
                    table.setdefault(t, [])
                    if alt_ not in table[t]:
                        table[t].append(alt_)
            self.predict.append(table)

    def rule(self, name: str) -> int:
        return self.names[name]

    def derives(self, start: int, s: str) -> bool:
        """Whether the folded token string s derives from the rule. Asked once per distinct (rule, s)."""
        key = (start, s)
        got = self.memo.get(key)
        if got is None:
            got = (start in self.lists and len(s) > 8 and self._in_parts(start, s)) or (start in self.commas and len(s) > 24 and self._by_commas(start, s))
            got = self.memo[key] = got or self._run(start, s)
        return got

    def _by_commas(self, start: int, s: str) -> bool:
        """Whether s is an item between any two commas. Then it derives from the rule; if not, that says nothing."""
        item, ending = self.commas[start]
        parts = s.split(self.comma)
        if ending and not parts[-1]:
            parts.pop()
        return all(p and self.derives(item[1], p) for p in dict.fromkeys(parts))

    def _in_parts(self, start: int, s: str) -> bool:
        """Whether s, cut where items are likely to end, is a list in each part. Then all of it is one; if not, that says nothing."""
        groups = self.folder.groups
        kinds = [c if ord(c) < BASE else groups[ord(c) - BASE][0] for c in s] + ["\0", "\0"]
        cuts, at, n = [], 0, len(s)
        for i in range(n - 1):
            k, after = kinds[i], kinds[i + 1]
            if k in self.ends:
                if after in self.goes_on or (kinds[i - 1] == "(" and kinds[i - 2] in self.heads) or (kinds[at] == self.at and "{" not in kinds[at:i]):
                    continue
            elif k != "{" or after not in self.begins:
                continue
            cuts.append(s[at : i + 1])
            at = i + 1
        if not cuts:
            return False
        cuts.append(s[at:])
        return all(self.derives(start, c) for c in cuts)

    def reset_if_full(self) -> None:
        if len(self.folder.groups) > ROOM or len(self.memo) > 4 * ROOM:
            self.folder = Folder()
            self.memo = {}

    def _run(self, start: int, s: str) -> bool:
        """Descriptors over a graph-structured stack; where the next token leaves one alternative, no node is made.

        A stack entry is a node [edges, positions popped], shared by all who ask for its rule at its position, or, below
        a rule with one viable alternative, a plain link (rest of the caller's alternative, node).
        """
        groups, predict = self.folder.groups, self.predict
        kinds = [c if ord(c) < BASE else groups[ord(c) - BASE][0] for c in s]
        kinds.append("\0")
        end = len(s)
        root: list = [[], set()]
        nodes: dict[tuple[int, int], list] = {(start, 0): root}
        todo = [(alt, 0, root, 0) for alt in predict[start].get(kinds[0], ())]
        while todo:
            alt, dot, node, pos = todo.pop()
            n = len(alt)
            while True:
                if dot == n:
                    if type(node) is tuple:
                        alt, dot, node = node
                        n = len(alt)
                        continue
                    edges, pops = node
                    if pos in pops:
                        break
                    pops.add(pos)
                    if node is root and pos == end:
                        return True
                    for a, d, below in edges:
                        todo.append((a, d, below, pos))
                    break
                kind, symbol, inner = alt[dot]
                if kind == "n":
                    viable = predict[symbol].get(kinds[pos])
                    if not viable:
                        break
                    dot += 1
                    if len(viable) == 1:
                        one = viable[0]
                        if one:
                            if dot < n:
                                node = (alt, dot, node)
                            alt, dot, n = one, 0, len(one)
                        continue
                    edge = (alt, dot, node)
                    below = nodes.get((symbol, pos))
                    if below is None:
                        nodes[symbol, pos] = below = [[edge], set()]
                        for a in viable:
                            todo.append((a, 0, below, pos))
                    else:
                        below[0].append(edge)
                        for p in below[1]:
                            todo.append((alt, dot, node, p))
                    break
                if kinds[pos] != symbol or (kind == "g" and not self.derives(inner, groups[ord(s[pos]) - BASE][1])):
                    break
                pos += 1
                dot += 1
        return False
