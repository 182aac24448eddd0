"""JavaScript, TypeScript, Java and PHP source to rows: a structural parser over tokens and balanced groups.

It reads imports, classes, interfaces, traits, enums, records, type aliases, functions, methods and functions held by
variables with their annotations, modifiers, type parameters, typed parameters, return types, bodies and documentation;
what stands inside bodies is only counted. Brackets in comments, strings, templates and regular expressions are no
brackets. A text that is cut off or broken gives the rows up to there: nothing raises.
"""

from __future__ import annotations

import re
from bisect import bisect_right

_COMMON = r"(?P<c>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<s>\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?)"
_ID = r"(?P<id>[A-Za-z_$\x80-\U0010ffff][\w$\x80-\U0010ffff]*)"
_NUM = r"(?P<n>\d[\w.]*)"
_TOKENS = {
    "js": re.compile(rf"{_COMMON}|(?P<t>`)|{_ID}|{_NUM}|(?P<p>=>|\.\.\.|\?\.|&&|\|\||\?\?|[^\s\w])", re.S),
    "java": re.compile(rf'(?P<tb>"""(?:[^\\]|\\.)*?(?:"""|\Z))|{_COMMON}|{_ID}|{_NUM}|(?P<p>->|::|\.\.\.|&&|\|\||[^\s\w])', re.S),
    "php": re.compile(
        r"(?P<c>//(?:(?!\?>)[^\n])*|\#(?!\[)(?:(?!\?>)[^\n])*|/\*.*?(?:\*/|\Z)|\?>.*?(?:<\?(?:php\b|=)|\Z))|(?P<s>\"(?:[^\"\\]|\\.)*(?:\"|\Z)|'(?:[^'\\]|\\.)*(?:'|\Z)|<<<[ \t]*(?P<q>['\"]?)(?P<tag>[A-Za-z_]\w*)(?P=q)\r?\n.*?^[ \t]*(?P=tag)\b)"
        r"|(?P<v>\$[A-Za-z_]\w*)|(?P<id>\\?[A-Za-z_\x80-\U0010ffff][\w\x80-\U0010ffff]*(?:\\[A-Za-z_\x80-\U0010ffff][\w\x80-\U0010ffff]*)*)|(?P<n>\d[\w.]*)|(?P<p>\#\[|=>|->|\?->|::|\.\.\.|&&|\|\||\?\?|[^\s\w])",
        re.S | re.M,
    ),
}
_TOKENS["ts"] = _TOKENS["js"]
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[A-Za-z]*")
_DECISIONS = {"if", "for", "foreach", "while", "case", "catch", "elseif"}
_KINDS = {"class", "interface", "trait", "enum", "record"}
_MODIFIERS = set("public private protected static final abstract synchronized native default transient volatile strictfp sealed readonly override declare async export get set accessor var".split())
_CLOSE = {"(": ")", "[": "]", "{": "}", "#[": "]"}


class Outline:
    """The tokens of a text, which bracket belongs to which, and the rows read from them."""

    def __init__(self, text: str, language: str) -> None:
        self.text, self.language = text, language
        self.tok: list[str] = []
        self.at: list[int] = []
        self.kind: list[str] = []
        self.mate: dict[int, int] = {}
        self.docs: dict[int, str] = {}  # index of the token after it -> documentation block
        self.lines = [0, *(m.end() for m in re.finditer("\n", text))]
        self.rows: list[dict] = []
        self.uses: list[tuple[str, str, int]] = []  # (owner, type, line)
        start = 0
        if language == "php":
            m = re.search(r"<\?(?:php\b|=)", text, re.I)
            start = m.end() if m else len(text)
        self._scan(start)

    # --- tokens
    def _scan(self, at: int) -> None:
        text, rx, stack = self.text, _TOKENS[self.language], []
        n = len(text)
        while at < n and (m := rx.search(text, at)):
            what, t, lo = m.lastgroup, m.group(), m.start()
            if what in ("q", "tag"):
                what = "s"
            at = m.end()
            if what == "c":
                if t.startswith("/**") and len(t) > 4:
                    self.docs[len(self.tok)] = t
                elif t.startswith("?>"):
                    self._put(";", lo, "p")
                continue
            if what == "t":
                at = self._template(at)
                self._put("``", lo, "s")
                continue
            if t == "/" and self.language in ("js", "ts") and not self._value_before():
                r = _REGEX.match(text, lo)
                if r:
                    at = r.end()
                    self._put("//", lo, "s")
                    continue
            i = len(self.tok)
            self._put(t, lo, what)
            if t in _CLOSE:
                stack.append(i)
            elif t in (")", "]", "}"):
                k = len(stack) - 1
                while k >= 0 and _CLOSE[self.tok[stack[k]]] != t:
                    k -= 1
                if k >= 0:
                    self.mate[stack[k]], self.mate[i] = i, stack[k]
                    del stack[k:]
        for i in stack:  # never closed: it holds the rest
            self.mate[i] = len(self.tok)

    def _put(self, t: str, at: int, kind: str) -> None:
        self.tok.append(t)
        self.at.append(at)
        self.kind.append(kind)

    def _value_before(self) -> bool:
        if not self.tok:
            return False
        t, k = self.tok[-1], self.kind[-1]
        return k in ("n", "s") or t in (")", "]", "}") or (k == "id" and t not in ("return", "typeof", "case", "in", "of", "void", "delete", "throw", "new", "else", "do", "yield", "await"))

    def _template(self, at: int) -> int:
        text, depth = self.text, 0
        while at < len(text):
            c = text[at]
            if c == "\\":
                at += 1
            elif depth == 0 and c == "`":
                return at + 1
            elif c == "$" and text.startswith("${", at) or depth and c == "{":
                depth += 1
                at += c == "$"
            elif depth and c == "}":
                depth -= 1
            elif depth and c == "`":
                at = self._template(at + 1) - 1
            at += 1
        return len(text)

    def line(self, i: int) -> int:
        """The 1-based line of a token; of none, the last one."""
        return bisect_right(self.lines, self.at[i]) if i < len(self.at) else len(self.lines)

    def is_(self, i: int, t: str) -> bool:
        return i < len(self.tok) and self.tok[i] == t

    def name_at(self, i: int) -> bool:
        return i < len(self.tok) and self.kind[i] == "id"

    def past(self, i: int) -> int:
        """The token behind the group that opens at i."""
        return self.mate.get(i, len(self.tok) - 1) + 1

    def past_angles(self, i: int) -> int:
        """Behind ``<...>`` if there is one at i."""
        if not self.is_(i, "<"):
            return i
        depth, k = 0, i
        while k < len(self.tok):
            t = self.tok[k]
            if t in _CLOSE:
                k = self.past(k)
                continue
            depth += (t == "<") - (t == ">")
            k += 1
            if depth == 0:
                return k
            if t in (";", ")", "}"):
                break
        return i

    def source(self, i: int, j: int) -> str | None:
        """The text of the tokens i to j - 1, on one line."""
        if i >= j or i >= len(self.tok):
            return None
        end = self.at[j] if j < len(self.at) else len(self.text)
        return " ".join(re.sub(r"//[^\n]*|/\*.*?\*/", " ", self.text[self.at[i] : end], flags=re.S).split()) or None

    # --- declarations
    def read(self) -> Outline:
        self._block(0, len(self.tok), None)
        return self

    def _block(self, i: int, end: int, owner: str | None, kind: str = "") -> None:
        end = min(end, len(self.tok))
        first, marks = i, []
        while i < end:
            t = self.tok[i]
            if t == "@" and self.name_at(i + 1) and not (self.language == "java" and self.is_(i + 1, "interface")):
                k = i + 2
                while self.is_(k, ".") and self.name_at(k + 1):
                    k += 2
                marks.append("".join(self.tok[i + 1 : k]))
                i = self.past(k) if self.is_(k, "(") else k
                continue
            if t == "#[":
                k = i + 1
                while k < self.mate.get(i, end):
                    if self.name_at(k):
                        marks.append(self.tok[k])
                        k += 1
                        k = self.past(k) if self.is_(k, "(") else k
                    k += 1
                i = self.past(i)
                continue
            got = self._declaration(first, i, end, owner, kind, marks)
            if got is not None:
                i = first = got
                marks = []
                continue
            if t in (";", "}") or t == "," and (kind == "enum" or owner is None):
                i += 1
                first, marks = i, []
            elif t == "{":
                close = self.mate.get(i, end)
                if owner is None:
                    self._block(i + 1, close, None)  # a namespace, a condition and the like
                i = close + 1
                first, marks = i, []
            elif t in ("(", "["):
                i = self.past(i)
            else:
                i += 1

    def _declaration(self, first: int, i: int, end: int, owner: str | None, kind: str, marks: list[str]) -> int | None:
        t = self.tok[i]
        before = self.tok[i - 1] if i > first else ""
        if t in _KINDS and self.name_at(i + 1) and before not in (".", "::", "->", "?.") and not (t in ("record", "enum") and self.tok[i + 1] in ("extends", "implements")):
            if t != "record" or self.is_(self.past_angles(i + 2), "("):
                return self._class(first, i, marks, t)
        if self.language == "java" and t == "interface" and before == "@":
            return self._class(first, i, marks, "interface")
        if self.language == "ts" and t == "type" and owner is None and self.name_at(i + 1):
            k = self.past_angles(i + 2)
            if self.is_(k, "="):
                stop = self._statement_end(k, end)
                self._row(first, i + 1, stop, "type_alias", self.tok[i + 1], None, marks)
                return stop
        if t == "function" and before not in (".", "->", "::", "=", "(", "=>", "?.", "use"):
            k = i + 1
            while self.is_(k, "*") or self.is_(k, "&"):
                k += 1
            if self.name_at(k):
                return self._callable(first, k, end, owner, marks, None)
        if self.language in ("js", "ts") and owner is None and t in ("const", "let", "var") and self.name_at(i + 1):
            got = self._held(first, i + 1, end, marks)
            if got is not None:
                return got
        if owner is not None and self.language != "php" and (self.kind[i] == "id" or t == "#" and self.name_at(i + 1)) and before not in (".", "new", "=", "->", "::", "=>", "?"):
            name = i + (t == "#")
            k = self.past_angles(name + 1) if self.language in ("js", "ts") else name + 1
            if self.language == "ts" and self.is_(k, "?"):
                k += 1
            if self.is_(k, "(") and t not in ("if", "for", "while", "switch", "catch", "return", "super", "this"):
                after = self.past(k)
                if self.is_(after, "{") or self.language == "java" and (self.is_(after, "throws") or self.is_(after, ";") or self.is_(after, "default") or self.is_(after, "[")) and "=" not in self.tok[first:i] or self.language == "ts" and (self.is_(after, ":") or self.is_(after, ";") or kind == "interface"):
                    if kind == "enum" and self.language == "java" and not self._typed(first, i, owner):
                        return None  # a constant with arguments
                    return self._callable(first, name, end, owner, marks, self._java_type(first, i) if self.language == "java" else None)
        return None

    def _typed(self, first: int, i: int, owner: str) -> bool:
        return self.tok[i] == owner or i > first

    def _java_type(self, first: int, name: int) -> str | None:
        """The return type before a Java method's name: what is left of modifiers, annotations and type parameters."""
        k = first
        while k < name:
            if self.tok[k] == "@":
                k += 2
                while self.is_(k, ".") and k < name:
                    k += 2
                k = self.past(k) if self.is_(k, "(") and k < name else k
            elif self.tok[k] in _MODIFIERS:
                k += 1
            elif self.tok[k] == "<":
                j = self.past_angles(k)
                k = j if j > k else k + 1
            else:
                break
        return self.source(k, name)

    def _statement_end(self, i: int, end: int) -> int:
        while i < end:
            t = self.tok[i]
            if t == ";":
                return i + 1
            if t in ("}", ")"):
                return i
            if t in _CLOSE:
                i = self.past(i)
                if i < end and self.line(i) > self.line(i - 1) and self.kind[i] == "id":
                    return i
                continue
            i += 1
            if i < end and self.tok[i] in ("export", "import", "class", "function", "const", "let", "interface", "type", "@") and self.line(i) > self.line(i - 1):
                return i
        return end

    def _class(self, first: int, i: int, marks: list[str], kind: str) -> int:
        name = self.tok[i + 1]
        k = self.past_angles(i + 2)
        if kind == "record" and self.is_(k, "("):
            k = self.past(k)
        bases: list[tuple[str, str]] = []
        word = ""
        while k < len(self.tok) and self.tok[k] not in ("{", ";"):
            t = self.tok[k]
            if t in ("extends", "implements", "permits"):
                word = t
            elif t == "<":
                j = self.past_angles(k)
                for x in range(k + 1, j):
                    if word and self.kind[x] == "id":
                        self.uses.append((name, self.tok[x], self.line(x)))
                k = max(j, k + 1)
                continue
            elif t == "(":
                k = self.past(k)
                continue
            elif self.kind[k] == "id" and word in ("extends", "implements"):
                full = [t]
                while self.is_(k + 1, ".") and self.name_at(k + 2):
                    full += [".", self.tok[k + 2]]
                    k += 2
                bases.append((word, "".join(full)))
            k += 1
        close = self.mate.get(k, len(self.tok)) if self.is_(k, "{") else k
        row = self._row(first, i + 1, min(close, len(self.tok) - 1) + 1, kind, name, None, marks)
        row["bases"] = [b for _, b in bases]
        row["relations"] = bases
        row["is_abstract"] = "abstract" in self.tok[first:i]
        if self.is_(k, "{"):
            if self.language == "php":
                self._traits(row, k + 1, close)
            self._block(k + 1, close, name, kind)
        return close + 1

    def _traits(self, row: dict, i: int, end: int) -> None:
        row["traits"] = []
        while i < min(end, len(self.tok)):
            if self.tok[i] == "use" and self.name_at(i + 1):
                i += 1
                while i < end and self.tok[i] not in (";", "{"):
                    if self.kind[i] == "id":
                        row["traits"].append(self.tok[i])
                    i += 1
            i = self.past(i) if self.is_(i, "{") or self.is_(i, "(") else i + 1

    def _held(self, first: int, name: int, end: int, marks: list[str]) -> int | None:
        """A function that a variable holds: an arrow or a function expression."""
        k = name + 1
        if self.is_(k, ":"):
            while k < end and self.tok[k] not in ("=", ";"):
                k = self.past(k) if self.tok[k] in _CLOSE else k + 1
        if not self.is_(k, "="):
            return None
        k += 1
        mods = []
        if self.is_(k, "async"):
            mods, k = ["async"], k + 1
        if self.is_(k, "function"):
            k += 1 + self.is_(k + 1, "*")
            k += self.name_at(k)
            return self._callable(first, name, end, None, marks, None, k, mods) if self.is_(k, "(") else None
        k = self.past_angles(k)
        if self.name_at(k) and self.is_(k + 1, "=>"):
            return self._callable(first, name, end, None, marks, None, k, mods)
        if self.is_(k, "("):
            j = self.past(k)
            if self.is_(j, ":"):
                while j < end and self.tok[j] not in ("=>", ";"):
                    j = self.past(j) if self.tok[j] in _CLOSE else j + 1
            if self.is_(j, "=>"):
                return self._callable(first, name, end, None, marks, None, k, mods)
        return None

    def _callable(self, first: int, name: int, end: int, owner: str | None, marks: list[str], returns: str | None, args: int | None = None, mods: list[str] = ()) -> int:
        k = args if args is not None else self.past_angles(name + 1)
        if args is None and self.is_(k, "?"):
            k += 1
        if self.is_(k, "("):
            close = self.mate.get(k, len(self.tok))
            params = self._parameters(k + 1, close, owner or self.tok[name])
            k = close + 1
        else:  # one bare parameter of an arrow
            params = [{"name": self.tok[k], "type": None, "default": None}] if self.name_at(k) and args is not None else []
            k += bool(params)
        if self.is_(k, ":"):
            lo = k = k + 1
            while k < len(self.tok) and self.tok[k] not in (";", "=>"):
                if self.tok[k] == "{":
                    if self.language == "php" or k > lo and (self.kind[k - 1] in ("id", "s", "n") or self.tok[k - 1] in (">", "]", ")", "}")):
                        break
                    k = self.past(k)
                elif self.tok[k] == "<" and self.past_angles(k) > k:
                    k = self.past_angles(k)
                elif self.tok[k] in ("(", "["):
                    k = self.past(k)
                    if self.is_(k, "=>") and args is None:  # a function type
                        k += 1
                elif self.tok[k] == "}" or self.tok[k] == ",":
                    break
                else:
                    k += 1
            returns = self.source(lo, k)
            self._use(lo, k, owner or self.tok[name])
        while k < len(self.tok) and self.tok[k] not in ("{", ";", "=>", "}"):
            if self.language in ("js", "ts") and self.line(k) > self.line(k - 1):
                break
            k += 1
        body = k
        if self.is_(k, "{"):
            stop = self.mate.get(k, len(self.tok)) + 1
        elif self.is_(k, "=>"):
            stop = self.mate.get(k + 1, len(self.tok)) + 1 if self.is_(k + 1, "{") else self._statement_end(k + 1, end)
        else:
            stop = k + self.is_(k, ";")
        word = {*self.tok[first:name], *mods}
        row = self._row(first, name, stop, "method" if owner else "function", self.tok[name], owner, marks)
        row |= {"parameters": params, "return_type": returns, "is_async": "async" in word, "is_static": "static" in word, "is_abstract": "abstract" in word, "is_generator": "*" in self.tok[max(first, name - 2) : name]}
        n = 1
        for j in range(body, min(stop, len(self.tok))):
            t = self.tok[j]
            n += t in _DECISIONS or t in ("&&", "||") or t == "?" and not (self.tok[j + 1 : j + 2] in (["."], [":"], [","], [")"], ["?"]) or self.language == "java" and self.tok[j - 1] in ("<", ","))
        row["complexity"] = n
        if self.language == "java" and returns:
            self.uses += [(owner or "", x, self.line(name)) for x in re.findall(r"[A-Za-z_$][\w$]*", returns)]
        return stop

    def _use(self, i: int, j: int, owner: str) -> None:
        self.uses += [(owner, self.tok[k], self.line(k)) for k in range(i, min(j, len(self.tok))) if self.kind[k] == "id"]

    def _parameters(self, i: int, end: int, owner: str) -> list[dict]:
        out, lo = [], i
        end = min(end, len(self.tok))
        while i <= end:
            if i == end or self.tok[i] == ",":
                if i > lo and (p := self._parameter(lo, i, owner)):
                    out.append(p)
                lo = i = i + 1
                continue
            if self.tok[i] == "<" and (j := self.past_angles(i)) > i and self.language != "php":
                i = j
            else:
                i = self.past(i) if self.tok[i] in _CLOSE else i + 1
        return out

    def _parameter(self, i: int, end: int, owner: str) -> dict | None:
        while i < end and (self.tok[i] in ("@", "#[") or self.tok[i] in _MODIFIERS and i + 1 < end and (self.kind[i + 1] in ("id", "v") or self.tok[i + 1] in ("@", "?", "&", "..."))):
            if self.tok[i] == "@":
                i += 2
                i = self.past(i) if self.is_(i, "(") else i
            else:
                i = self.past(i) if self.tok[i] == "#[" else i + 1
        eq = next((k for k in self._level(i, end) if self.tok[k] == "="), end)
        default = self.source(eq + 1, end)
        if self.language == "php":
            v = next((k for k in range(i, eq) if self.kind[k] == "v"), None)
            if v is None:
                return None
            lo = v
            while lo > i and self.tok[lo - 1] in ("&", "..."):
                lo -= 1
            self._use(i, lo, owner)
            kind = self.source(i, lo)
            return {"name": self.tok[v].lstrip("$"), "type": kind and kind.replace(" ", ""), "default": default}
        if self.language == "java":
            k = eq - 1
            while k > i and self.tok[k] in ("[", "]"):
                k -= 1
            if k <= i or self.tok[k] == "this":
                return None
            self._use(i, k, owner)
            return {"name": self.tok[k], "type": self.source(i, k), "default": None}
        rest = "..." if self.is_(i, "...") else ""
        i += bool(rest)
        if i >= eq:
            return None
        colon = next((k for k in self._level(i, eq) if self.tok[k] == ":"), eq)
        name_end = colon - (self.is_(colon - 1, "?") and colon > i)
        if colon < eq:
            self._use(colon + 1, eq, owner)
        return {"name": self.source(i, max(name_end, i + 1)), "type": self.source(colon + 1, eq), "default": default}

    def _level(self, i: int, end: int):
        while i < end:
            yield i
            i = self.past(i) if self.tok[i] in _CLOSE else i + 1

    def _row(self, first: int, name: int, stop: int, kind: str, label: str, owner: str | None, marks: list[str]) -> dict:
        doc = self.docs.get(first)
        row = {"kind": kind, "name": label, "class_name": owner, "start_line": self.line(name), "end_line": self.line(max(stop - 1, name)), "docstring": prose(doc), "decorators": list(marks), "bases": None, "parameters": None, "return_type": None, "is_async": None, "is_abstract": None, "complexity": None}
        self.rows.append(row)
        return row

    def field_types(self) -> list[tuple[str, str, int]]:
        """(owner, type, line) of the types of fields: statements in a class's body that declare no method."""
        out: list[tuple[str, str, int]] = []
        for i, t in enumerate(self.tok):
            if t not in ("class", "interface", "record", "trait", "enum") or not self.name_at(i + 1) or self.is_(i - 1, ".") or self.is_(i - 1, "::"):
                continue
            k = i + 2
            while k < len(self.tok) and self.tok[k] not in ("{", ";"):
                k = self.past(k) if self.tok[k] == "(" else k + 1
            if not self.is_(k, "{"):
                continue
            end, owner = min(self.mate.get(k, len(self.tok)), len(self.tok)), self.tok[i + 1]
            lo = k = k + 1
            while k <= end:
                if k == end or self.tok[k] == ";" or self.tok[k] == "{" or self.language == "ts" and k > lo and self.line(k) > self.line(k - 1):
                    self._field(lo, k, owner, out)
                    k = self.past(k) if k < end and self.tok[k] == "{" else k + (k == end or self.tok[k] == ";")
                    lo = k
                    continue
                k = self.past(k) if self.tok[k] in ("(", "[") else k + 1
        return out

    def _field(self, i: int, end: int, owner: str, out: list[tuple[str, str, int]]) -> None:
        eq = next((k for k in range(i, end) if self.tok[k] in ("=", "(")), end)
        if eq < end and self.tok[eq] == "(":
            return
        while i < eq and (self.tok[i] in _MODIFIERS or self.tok[i] == "@" or self.is_(i - 1, "@")):
            i += 1
        if self.language == "ts":
            i = next((k + 1 for k in range(i, eq) if self.tok[k] == ":"), eq)
            last = eq
        elif self.language == "php":
            last = next((k for k in range(i, eq) if self.kind[k] == "v"), i)
        else:
            last = eq - 1
        out += [(owner, self.tok[k], self.line(k)) for k in range(i, last) if self.kind[k] == "id"]

    # --- imports
    def imports(self) -> list[dict]:
        """module_name, names (aliases win), line, is_wildcard."""
        out: list[dict] = []
        n, i, depth = len(self.tok), 0, 0
        while i < n:
            t = self.tok[i]
            if self.language in ("js", "ts"):
                if t == "import" and not (self.is_(i + 1, "(") or self.is_(i + 1, ".")) and not self.is_(i - 1, "."):
                    i = self._es_import(i, out)
                    continue
                if t == "export" and (self.is_(i + 1, "{") or self.is_(i + 1, "*")):
                    k = self.past(i + 1) if self.is_(i + 1, "{") else i + 2
                    if self.is_(k, "as"):
                        k += 2
                    if self.is_(k, "from") and k + 1 < n and self.kind[k + 1] == "s":
                        out.append({"module_name": self.tok[k + 1][1:-1], "names": self._specifiers(i + 2, k - 1) if self.is_(i + 1, "{") else ["*"], "line": self.line(i), "is_wildcard": self.is_(i + 1, "*")})
                if t == "require" and self.is_(i + 1, "(") and i + 2 < n and self.kind[i + 2] == "s":
                    out.append({"module_name": self.tok[i + 2][1:-1], "names": [], "line": self.line(i), "is_wildcard": False})
            elif self.language == "java" and t == "import":
                k = i + 1 + self.is_(i + 1, "static")
                j = k
                while j < n and self.tok[j] != ";" and (self.kind[j] == "id" or self.tok[j] in (".", "*")):
                    j += 1
                name = "".join(self.tok[k:j])
                if name:
                    out.append({"module_name": name, "names": [name.rsplit(".", 1)[-1]], "line": self.line(i), "is_wildcard": name.endswith("*")})
                i = j
            elif self.language == "php":
                depth += (t == "{") - (t == "}")
                if t in ("class", "trait", "function", "interface", "enum") and self.name_at(i + 1):
                    k = i
                    while k < n and self.tok[k] not in ("{", ";"):
                        k += 1
                    i = self.past(k) if self.is_(k, "{") else k
                    continue
                if t == "use" and self.name_at(i + 1):
                    i = self._php_use(i, out)
                    continue
            i += 1
        return out

    def _specifiers(self, i: int, end: int) -> list[str]:
        out, lo = [], i
        for k in range(i, end + 1):
            if k == end or self.tok[k] == ",":
                names = [x for x in self.tok[lo:k] if x not in ("type", "as")] or [x for x in self.tok[lo:k] if x != "as"]
                if names:
                    out.append(names[-1].strip("'\""))
                lo = k + 1
        return out

    def _es_import(self, i: int, out: list[dict]) -> int:
        k, names, wild = i + 1, [], False
        if self.is_(k, "type") and not self.is_(k + 1, "from") and not self.is_(k + 1, ","):
            k += 1
        while k < len(self.tok) and self.kind[k] != "s" and self.tok[k] != ";":
            if self.tok[k] == "{":
                names += self._specifiers(k + 1, self.mate.get(k, len(self.tok)))
                k = self.past(k)
            elif self.tok[k] == "*" and self.is_(k + 1, "as"):
                names.append(self.tok[k + 2] if k + 2 < len(self.tok) else "*")
                wild, k = True, k + 3
            elif self.tok[k] == "=" and self.is_(k + 1, "require"):
                k += 3
            else:
                if self.kind[k] == "id" and self.tok[k] != "from":
                    names.append(self.tok[k])
                k += 1
        if k < len(self.tok) and self.kind[k] == "s":
            out.append({"module_name": self.tok[k][1:-1], "names": names, "line": self.line(i), "is_wildcard": wild})
        return k + 1

    def _php_use(self, i: int, out: list[dict]) -> int:
        line, k = self.line(i), i + 1
        if self.tok[k] in ("function", "const") and self.name_at(k + 1):
            k += 1
        stem = ""
        while k < len(self.tok) and self.tok[k] != ";":
            t = self.tok[k]
            if t == "{":  # a group
                stem = out.pop()["module_name"].rstrip("\\") + "\\" if out and out[-1]["line"] == line else ""
            elif t == "as" and out:
                out[-1]["names"] = [self.tok[k + 1]] if k + 1 < len(self.tok) else []
                k += 1
            elif self.kind[k] == "id" and t not in ("function", "const"):
                full = stem + t.lstrip("\\")
                out.append({"module_name": full, "names": [full.rsplit("\\", 1)[-1]], "line": line, "is_wildcard": False})
            k += 1
        return k


def prose(doc: str | None) -> str | None:
    """A documentation block without its marks and without the lines of its tags."""
    if doc is None:
        return None
    lines = [re.sub(r"^\s*\*+\s?", "", x).strip() for x in re.sub(r"\*+/\s*$", "", doc[3:]).split("\n")]
    return "\n".join(x for x in lines if x and not x.startswith("@")) or None


def outline(text: str, language: str) -> Outline:
    return Outline(text, language).read()
