"""Island grammars: documentation, annotations, signatures and balanced bodies of functions; everything else is water.

One pass over a text finds what could hide a bracket (comments, strings, templates, regular expressions, heredocs) and
the brackets themselves. A function's island is then read around its name: its declaration begins after the last
statement end or block before it on the same level, so annotations may span lines; its parameters are one balanced
group, whatever defaults or types stand in it; its body is the balanced block after them, the expression of an arrow, or
nothing. In Python islands are made of logical lines: decorators, the signature up to its colon, the lines indented
below it. Its documentation is the string that opens the body, elsewhere the ``/** */`` block on the lines right above
the declaration.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

_STRINGS = r"\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?"
_TOKENS = {
    "js": re.compile(rf"//[^\n]*|/\*.*?(?:\*/|\Z)|{_STRINGS}|`|/|[()\[\]{{}};,]", re.S),
    "java": re.compile(rf"//[^\n]*|/\*.*?(?:\*/|\Z)|\"\"\"(?:[^\\]|\\.)*?(?:\"\"\"|\Z)|{_STRINGS}|[()\[\]{{}};,]", re.S),
    "php": re.compile(r"//(?:(?!\?>)[^\n])*|\#(?!\[)(?:(?!\?>)[^\n])*|/\*.*?(?:\*/|\Z)|\"(?:[^\"\\]|\\.)*(?:\"|\Z)|'(?:[^'\\]|\\.)*(?:'|\Z)|<<<[ \t]*(['\"]?)([A-Za-z_]\w*)\1\r?\n.*?^[ \t]*\2\b|\?>.*?(?:<\?(?:php\b|=)|\Z)|[()\[\]{};,]", re.S | re.M),
}
_TOKENS["ts"] = _TOKENS["js"]
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[A-Za-z]*")
_BEFORE_REGEX = re.compile(r"(?:^|[^\w$])(?:return|typeof|case|in|of|delete|void|throw|new|do|else|yield|await|instanceof)$")
_OPEN_TAG = re.compile(r"<\?(?:php\b|=)", re.I)
_CLOSES = {")": "(", "]": "[", "}": "{"}


class Braces:
    """The brackets and hidden spans of a JavaScript, TypeScript, Java or PHP text."""

    def __init__(self, text: str, ext: str) -> None:
        self.text, self.ext = text, ext
        self.at: list[int] = []  # offsets of brackets, semicolons and commas
        self.ch: list[str] = []
        self.mate: dict[int, int] = {}  # index of a bracket -> index of the one that belongs to it
        self.hidden: list[tuple[int, int]] = []  # comments and strings, in order
        self.docs: dict[int, int] = {}  # end of a documentation block -> its start
        start = 0
        if ext == "php":
            m = _OPEN_TAG.search(text)
            start = m.end() if m else len(text)
        self.first = start
        self._scan(start, len(text), None)

    def _scan(self, at: int, end: int, until: str | None) -> int:
        """Reads from ``at``; with ``until``, to the brace that closes a template's expression."""
        text, tokens, stack = self.text, _TOKENS[self.ext], []
        while at < end and (m := tokens.search(text, at, end)):
            t, lo = m.group(), m.start()
            at = m.end()
            c = t[0]
            if len(t) == 1 and c in "()[]{};,":
                if c == until and not stack:
                    return at
                i = len(self.at)
                self.at.append(lo)
                self.ch.append(c)
                if c in "([{":
                    stack.append(i)
                elif c in ")]}":
                    k = len(stack) - 1
                    while k >= 0 and self.ch[stack[k]] != _CLOSES[c]:
                        k -= 1
                    if k >= 0:  # what was opened inside and never closed is dropped
                        self.mate[stack[k]], self.mate[i] = i, stack[k]
                        del stack[k:]
                continue
            if c == "`" and self.ext in ("js", "ts"):
                at = self._template(lo, end)
            elif c == "/" and t == "/":
                if not self._operand_before(lo) and (r := _REGEX.match(text, lo)):
                    at = r.end()
                else:
                    continue
            elif t.startswith("?>"):  # what is outside of the tags ends a statement
                self.at.append(at - 1)
                self.ch.append(";")
            elif t.startswith("/**") and len(t) >= 5:
                self.docs[at] = lo
            self.hidden.append((lo, at))
        return end

    def _operand_before(self, at: int) -> bool:
        """Whether what stands before a slash is a value, so that it divides."""
        before = self.text[max(0, at - 40) : at].rstrip()
        return bool(before) and (before[-1] in ")]}" or before[-1].isalnum() or before[-1] in "_$'\"`") and not _BEFORE_REGEX.search(before)

    def _template(self, lo: int, end: int) -> int:
        text, at = self.text, lo + 1
        while at < end:
            c = text[at]
            if c == "`":
                return at + 1
            if c == "\\":
                at += 2
            elif c == "$" and text.startswith("${", at):
                at = Braces.skip(self, at + 2, end)
            else:
                at += 1
        return end

    def skip(self, at: int, end: int) -> int:
        """Behind the brace that closes a template's expression; what is in it belongs to the template."""
        inner = Braces.__new__(Braces)
        inner.text, inner.ext, inner.at, inner.ch, inner.mate, inner.hidden, inner.docs = self.text, self.ext, [], [], {}, [], {}
        return inner._scan(at, end, "}")

    def shown(self, at: int) -> bool:
        i = bisect_right(self.hidden, (at, len(self.text))) - 1
        return i < 0 or self.hidden[i][1] <= at

    def before(self, at: int) -> str:
        """The last character before ``at`` that is neither white space nor in a comment; for an arrow ``=>``."""
        i = bisect_left(self.hidden, (at, 0)) - 1
        while True:
            k = at
            while k > 0 and self.text[k - 1].isspace():
                k -= 1
            if i >= 0 and self.hidden[i][1] == k and self.text[self.hidden[i][0]] in "/#":
                at, i = self.hidden[i][0], i - 1
                continue
            return "=>" if self.text[max(0, k - 2) : k] == "=>" else self.text[k - 1 : k]

    def declaration(self, at: int) -> int:
        """Where the declaration that holds ``at`` begins: after the last statement end, block or opening bracket before it."""
        i = bisect_left(self.at, at) - 1
        lo = self.first
        while i >= 0:
            c = self.ch[i]
            if c in ")]" and i in self.mate:
                i = self.mate[i] - 1
                continue
            if c == "," and (self.ext not in ("js", "ts") or self.text.count("<", self.at[i], at) != self.text.count(">", self.at[i], at)):
                i -= 1
                continue
            lo = self.at[i] + 1
            break
        # white space and comments before the first token are not part of it
        k = bisect_left(self.hidden, (lo, 0))
        while True:
            while lo < at and self.text[lo].isspace():
                lo += 1
            if k < len(self.hidden) and self.hidden[k][0] == lo and self.text[lo] in "/#" and self.hidden[k][1] <= at:
                lo, k = self.hidden[k][1], k + 1
            elif k < len(self.hidden) and self.hidden[k][0] < lo:
                k += 1
            else:
                return lo

    def end(self, at: int) -> int:
        """Where the function whose name ends at ``at`` ends."""
        text, n = self.text, len(self.text)
        k = at
        while k < n and text[k].isspace():
            k += 1
        if k < n and text[k] == "<":  # type parameters
            depth = 0
            while k < n:
                depth += (text[k] == "<") - (text[k] == ">" and text[k - 1] != "=")
                k += 1
                if depth == 0:
                    break
        i = bisect_left(self.at, k)
        arrow = -1
        if self.ext in ("js", "ts") and text[k : k + 1] != "(":  # a function as a value
            stop = next((self.at[j] for j in range(i, len(self.at)) if self.ch[j] in "(;"), n)
            lone = text.find("=>", k, stop)
            if lone >= 0:
                arrow = lone
        if arrow < 0:
            while i < len(self.at) and self.ch[i] != "(":
                if self.ch[i] in ";})":
                    return self.at[i] + (self.ch[i] == ";")
                i += 1
            if i >= len(self.at) or i not in self.mate:
                return n
            i = self.mate[i] + 1
        else:
            i = bisect_left(self.at, arrow)
        value = False  # behind an arrow, its value
        while i < len(self.at):
            c, p = self.ch[i], self.at[i]
            if self.ext in ("js", "ts") and not value:
                behind = self.at[i - 1] + 1 if i else 0
                if (text.find("=>", max(behind, arrow), p) >= 0) and c != "{" or arrow >= 0 and c != "{":
                    value = True
            if c == "{":
                last = self.before(p)
                if value or self.ext == "ts" and last in (":", "|", "&", "<", ",", "=", "?", "("):
                    i = self.mate.get(i, len(self.at)) + 1  # a type or a part of a value
                    continue
                return self.at[self.mate[i]] + 1 if i in self.mate else n
            if c == ";":
                return p + 1
            if c in "([":
                i = self.mate.get(i, len(self.at)) + 1
                continue
            if c in ")]}" or c == "," and value:
                return p
            i += 1
        return n

    def island(self, name: str, lo: int, hi: int) -> tuple[str | None, str | None]:
        """(documentation, code) of the function whose signature has its name between ``lo`` and ``hi``."""
        m = next((m for m in re.finditer(rf"(?<![\w$]){re.escape(name)}(?![\w$])", self.text[lo:hi]) if self.shown(lo + m.start())), None)
        if m is None:
            return None, None
        at = lo + m.end()
        begin = self.declaration(lo + m.start())
        line = self.text.rfind("\n", 0, begin) + 1
        doc = None
        above = self.text[: max(line - 1, 0)].rstrip(" \t\r")
        if line > 0 and len(above) in self.docs:
            start = self.docs[len(above)]
            if not self.text[self.text.rfind("\n", 0, start) + 1 : start].strip():
                doc = self.text[start : len(above)]
        code_from = line if not self.text[line:begin].strip() else begin
        return doc, self.text[code_from : self.end(at)].rstrip()


_PY = re.compile(r"(?i:[rbuf]{0,2})(?:\"\"\"(?:[^\\]|\\.)*?(?:\"\"\"|\Z)|'''(?:[^\\]|\\.)*?(?:'''|\Z)|\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?)|\#[^\n]*|[()\[\]{}:]|\\\r?\n|\n", re.S)
_BLANK = re.compile(r"[ \t\f]*")
_PY_STRING = re.compile(r"(?i:r|u|)(\"\"\"(?:[^\\]|\\.)*?\"\"\"|'''(?:[^\\]|\\.)*?'''|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*')", re.S)


class Lines:
    """The logical lines of a Python text: where each begins, how far it is indented, where its first open colon is."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.start: list[int] = []
        self.indent: list[int] = []
        self.colon: list[int] = []
        depth, lo, colon = 0, 0, -1
        for m in _PY.finditer(text):
            t = m.group()
            c = t[0]
            if c in "([{":
                depth += 1
            elif c in ")]}":
                depth = max(0, depth - 1)
            elif c == ":":
                if depth == 0 and colon < 0:
                    colon = m.start()
            elif t == "\n" and depth == 0:
                self._line(lo, m.start(), colon)
                lo, colon = m.end(), -1
        self._line(lo, len(text), colon)

    def _line(self, lo: int, hi: int, colon: int) -> None:
        s = self.text[lo:hi]
        body = s.lstrip(" \t\f\r")
        if body and body[0] != "#":
            self.start.append(lo)
            self.indent.append(len(s[: len(s) - len(body)].expandtabs(8)))
            self.colon.append(colon)

    def _first(self, k: int) -> int:
        """Where the first token of a logical line is."""
        return _BLANK.match(self.text, self.start[k]).end()

    def island(self, name: str, lo: int, hi: int) -> tuple[str | None, str | None]:
        """(documentation, code) of the function whose signature begins on the line from ``lo`` to ``hi``."""
        k = bisect_right(self.start, lo) - 1
        if k < 0 or self.start[k] != lo or not re.match(rf"[ \t]*(?:async[ \t]+)?def[ \t]+{re.escape(name)}\b|[ \t]*{re.escape(name)}\b[^\n]*\blambda\b", self.text[lo:hi]):
            return None, None
        own = self.indent[k]
        doc = None
        if self.colon[k] >= 0:
            at = _BLANK.match(self.text, self.colon[k] + 1).end()
            if self.text[at : at + 1] in ("#", "\r", "\n", ""):  # the body is on lines of its own
                at = self._first(k + 1) if k + 1 < len(self.start) and self.indent[k + 1] > own else len(self.text)
            m = _PY_STRING.match(self.text, at)
            if m:
                body = m.group(1)
                doc = body[3:-3] if body[:3] in ('"""', "'''") else body[1:-1]
        last = k
        while last + 1 < len(self.start) and self.indent[last + 1] > own:
            last += 1
        end = self.start[last + 1] if last + 1 < len(self.start) else len(self.text)
        top = k
        while top > 0 and self.indent[top - 1] == own and self.text.startswith("@", self._first(top - 1)):
            top -= 1
        code = self.text[self.start[top] : end]
        # comments between this function and the next belong to what follows
        kept = code.rstrip().split("\n")
        while len(kept) > 1 and (not kept[-1].strip() or kept[-1].lstrip().startswith("#") and len(kept[-1]) - len(kept[-1].lstrip()) <= own):
            kept.pop()
        return doc, "\n".join(kept).rstrip()


def reader(text: str, ext: str) -> Braces | Lines:
    return Lines(text) if ext == "py" else Braces(text, ext)
