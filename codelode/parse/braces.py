"""JavaScript, TypeScript, Java and PHP source to rows, from the outline of a text."""

from __future__ import annotations

import re

from .outline import Outline, outline

_NOISE = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`", re.S)
_HASH = re.compile(r"#(?!\[)[^\n]*")
def blank(text: str, language: str) -> str:
    """The text with comments and the insides of strings as spaces; offsets and lines stay."""
    keep = lambda m: "".join(c if c == "\n" else " " for c in m.group())
    t = _NOISE.sub(keep, text)
    return _HASH.sub(keep, t) if language == "php" else t


def entities(text: str, language: str) -> list[dict]:
    """kind, name, class_name, start_line, end_line, docstring, decorators, bases, parameters, return_type, is_async,
    is_abstract, complexity of each class, interface, trait, enum, record, type alias, function and method, in order."""
    return outline(text, language).rows


def imports(text: str, language: str) -> list[dict]:
    """module_name, names, line, is_wildcard; an alias takes the name's place."""
    return Outline(text, language).imports()


#: Types that no reference is made of.
_PLAIN = {"int", "long", "short", "byte", "char", "float", "double", "boolean", "bool", "void", "string", "String", "Object", "number", "any", "unknown", "never", "null", "undefined", "array", "iterable", "callable", "mixed", "self", "static", "parent", "object", "false", "true", "var", "T", "K", "V"}
_NEW = re.compile(r"\bnew\s+([\w.\\]+)")
_ALIAS = re.compile(r"\b(?:export\s+)?type\s+([A-Za-z_$][\w$]*)\s*(?:<[^=]*>)?\s*=")
_EXPORT = re.compile(r"\bexport\s+(?:default\s+)?(?:declare\s+|abstract\s+|async\s+)*(?:class|interface|enum|type|function\s*\*?|const|let|var|namespace)\s+([A-Za-z_$][\w$]*)|\bexport\s*\{([^}]*)\}")


def exports(text: str, language: str = "ts") -> list[str]:
    """Names a JavaScript or TypeScript module exports, in order."""
    out = []
    for m in _EXPORT.finditer(blank(text, language)):
        if m.group(1):
            out.append(m.group(1))
        else:
            out += [x.split(" as ")[-1].strip() for x in m.group(2).split(",") if x.strip()]
    return out


def type_aliases(text: str) -> list[str]:
    return _ALIAS.findall(blank(text, "ts"))


def references(text: str, language: str) -> list[dict]:
    """(source, target, type, line): import per name, inherit, implement, interface_extends, trait_use, type_use, and of
    JavaScript function_definition."""
    o = outline(text, language)
    out = []
    for i in o.imports():
        names = i["names"] if language in ("js", "ts") and i["names"] else [None]
        out += [{"source": "", "target": i["module_name"] if n is None else f"{i['module_name']}.{n}", "type": "import", "line": i["line"]} for n in names]
    spans = []
    for r in o.rows:
        if "relations" in r:
            spans.append((r["start_line"], r["end_line"], r["name"]))
            for word, base in r["relations"]:
                kind = "implement" if word == "implements" else "interface_extends" if r["kind"] == "interface" else "inherit"
                out.append({"source": r["name"], "target": base, "type": kind, "line": r["start_line"]})
            out += [{"source": r["name"], "target": x, "type": "trait_use", "line": r["start_line"]} for x in r.get("traits", ())]
        elif language == "js" and r["kind"] == "function":
            out.append({"source": "", "target": r["name"], "type": "function_definition", "line": r["start_line"]})
    if language == "js":
        return out
    owner = lambda line: max((s for s in spans if s[0] <= line <= s[1]), default=(0, 0, ""))[2]
    t = blank(text, language)
    used = [*o.uses, *o.field_types()]
    used += [(owner(n), m.group(1), n) for m in _NEW.finditer(t) for n in (t.count("\n", 0, m.start()) + 1,)] if language != "ts" else []
    seen = set()
    for source, x, n in sorted(used, key=lambda u: u[2]):
        key = (source, x.lstrip("?"), n)
        if key[1] not in _PLAIN and key not in seen and not (len(key[1]) == 1 and key[1].isupper()):
            seen.add(key)
            out.append({"source": source, "target": key[1], "type": "type_use", "line": n})
    return out


def external(statements: list[str], stdlib: frozenset[str] = frozenset()) -> list[str]:
    """Modules that import statements name, without relative ones and those of the standard library, sorted."""
    out = set()
    for s in statements:
        m = re.search(r"\bfrom\s+['\"]([^'\"]+)['\"]|require\(\s*['\"]([^'\"]+)['\"]", s)
        name = next(filter(None, m.groups())) if m else (s.split() + ["", ""])[1].rstrip(";")
        if name and not name.startswith((".", "/")) and re.split(r"[./\\]", name)[0] not in stdlib:
            out.add(name)
    return sorted(out)
