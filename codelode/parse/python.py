"""Python source to rows, by the standard library's parser: entities, imports, references, complexity."""

from __future__ import annotations

import ast
import warnings

from pyspark.sql import functions as F
from pyspark.sql import types as T

Node = ast.AST
FUNCTION = (ast.FunctionDef, ast.AsyncFunctionDef)


def tree_of(text: str) -> tuple[ast.Module | None, str | None]:
    """The tree, or why there is none."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return ast.parse(text), None
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return None, f"{type(e).__name__}: {e}"


def complexity(node: Node) -> int:
    """1, and what each construct below adds: a branch, loop, comprehension, assertion or conditional lambda 1; a try its
    handlers and its finally; a with its items beyond the first; a chain of and/or 1."""
    n = 1
    for x in ast.walk(node):
        if isinstance(x, (ast.If, ast.IfExp, ast.For, ast.AsyncFor, ast.While, ast.Assert, ast.BoolOp, ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp)):
            n += 1
        elif isinstance(x, ast.Try):
            n += len(x.handlers) + bool(x.finalbody)
        elif isinstance(x, (ast.With, ast.AsyncWith)):
            n += len(x.items) - 1
        elif isinstance(x, ast.match_case):
            n += 1
    return n


def dotted(node: Node) -> str | None:
    """a.b.c of names and attributes, of a call what is called."""
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        base = dotted(node.value)
        return f"{base}.{node.attr}" if base else None
    if isinstance(node, ast.Call):
        return dotted(node.func)
    if isinstance(node, ast.Subscript):
        return dotted(node.value)
    return None


def parameters(f: Node) -> list[dict]:
    a = f.args
    plain = a.posonlyargs + a.args
    defaults = [None] * (len(plain) - len(a.defaults)) + list(a.defaults)
    both = [*zip(plain, defaults), *zip(a.kwonlyargs, a.kw_defaults)]
    text = lambda x: ast.unparse(x) if x is not None else None
    return [{"name": p.arg, "type": text(p.annotation), "default": text(d)} for p, d in both if p.arg not in ("self", "cls")]


def entities(text: str) -> list[dict]:
    """A row for the module and for each class, function and method."""
    tree, error = tree_of(text)
    lines = text.count("\n") + 1
    blank = {"kind": "module", "name": None, "class_name": None, "start_line": 1, "end_line": lines, "docstring": None, "bases": None, "decorators": None, "parameters": None, "return_type": None, "is_async": None, "is_generator": None, "is_abstract": None, "complexity": None, "error": error}
    if tree is None:
        return [blank]
    out = [blank | {"docstring": ast.get_docstring(tree)}]

    def add(f: Node, owner: str | None) -> None:
        marks = [dotted(x) or "" for x in f.decorator_list]
        own = [x for b in f.body for x in ast.walk(b)]
        out.append(blank | {"kind": "method" if owner else "function", "name": f.name, "class_name": owner, "start_line": f.lineno, "end_line": f.end_lineno, "docstring": ast.get_docstring(f), "decorators": marks, "parameters": parameters(f), "return_type": ast.unparse(f.returns) if f.returns else None, "is_async": isinstance(f, ast.AsyncFunctionDef), "is_generator": any(isinstance(x, (ast.Yield, ast.YieldFrom)) for x in own), "complexity": complexity(f)})

    def visit(body: list[Node], owner: str | None) -> None:
        for x in body:
            if isinstance(x, ast.ClassDef):
                marks = [dotted(y) or "" for y in x.decorator_list]
                methods = [y for y in x.body if isinstance(y, FUNCTION)]
                abstract = any("abstract" in m for m in marks) or any("abstractmethod" in (dotted(z) or "") for y in methods for z in y.decorator_list)
                out.append(blank | {"kind": "class", "name": x.name, "class_name": owner, "start_line": x.lineno, "end_line": x.end_lineno, "docstring": ast.get_docstring(x), "bases": [b for b in map(dotted, x.bases) if b], "decorators": marks, "is_abstract": abstract})
                visit(x.body, x.name)
            elif isinstance(x, FUNCTION):
                add(x, owner)
            elif isinstance(x, (ast.If, ast.Try, ast.With)):
                visit([y for y in ast.iter_child_nodes(x) if isinstance(y, ast.stmt)], owner)

    visit(tree.body, None)
    return out


def imports(text: str) -> list[dict]:
    """A row for each import statement's module: names, level of dots, line."""
    tree, _ = tree_of(text)
    out = []
    for x in ast.walk(tree) if tree else ():
        if isinstance(x, ast.Import):
            out += [{"module_name": a.name, "names": [a.asname or a.name], "is_relative": False, "level": 0, "line": x.lineno} for a in x.names]
        elif isinstance(x, ast.ImportFrom):
            out.append({"module_name": x.module or "", "names": [a.name for a in x.names], "is_relative": x.level > 0, "level": x.level, "line": x.lineno})
    return out


def references(text: str, module: str = "") -> list[dict]:
    """(source, target, type, line): import, inherit, decorator, type_hint, call, instantiate; async functions like others.

    Names are resolved through the file's imports; a relative import climbs one package a dot beyond the first.
    """
    tree, _ = tree_of(text)
    if tree is None:
        return []
    alias: dict[str, str] = {}
    out: list[dict] = []
    package = module.split(".")[:-1]

    def full(name: str | None) -> str | None:
        if not name:
            return None
        head, _, rest = name.partition(".")
        base = alias.get(head, head)
        return f"{base}.{rest}" if rest else base

    def put(source: str, target: str | None, kind: str, line: int) -> None:
        if target:
            out.append({"source": source, "target": target, "type": kind, "line": line})

    for x in ast.walk(tree):
        if isinstance(x, ast.Import):
            for a in x.names:
                alias[a.asname or a.name.split(".")[0]] = a.name if a.asname else a.name.split(".")[0]
                put(module, a.name, "import", x.lineno)
        elif isinstance(x, ast.ImportFrom):
            base = ".".join([*package[: len(package) - (x.level - 1)], x.module or ""] if x.level else [x.module or ""]).strip(".")
            for a in x.names:
                alias[a.asname or a.name] = f"{base}.{a.name}" if base else a.name
                put(module, alias[a.asname or a.name], "import", x.lineno)

    def visit(node: Node, scope: str) -> None:
        for x in ast.iter_child_nodes(node):
            inner = scope
            if isinstance(x, ast.ClassDef):
                inner = f"{scope}.{x.name}" if scope else x.name
                for b in x.bases:
                    put(inner, full(dotted(b)), "inherit", x.lineno)
                for y in x.decorator_list:
                    put(inner, full(dotted(y)), "decorator", x.lineno)
            elif isinstance(x, FUNCTION):
                inner = f"{scope}.{x.name}" if scope else x.name
                for y in x.decorator_list:
                    put(inner, full(dotted(y)), "decorator", x.lineno)
                for h in [x.returns, *[a.annotation for a in x.args.posonlyargs + x.args.args]]:
                    if h is not None:
                        put(inner, full(dotted(h)), "type_hint", x.lineno)
            elif isinstance(x, ast.Call):
                name = dotted(x.func)
                if name:
                    put(scope or module, full(name), "instantiate" if name.split(".")[-1][:1].isupper() else "call", x.lineno)
            visit(x, inner)

    visit(tree, module)
    return out


PARAMETER = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("name", "type", "default")]))
ENTITY = T.StructType([T.StructField("kind", T.StringType()), T.StructField("name", T.StringType()), T.StructField("class_name", T.StringType()), T.StructField("start_line", T.IntegerType()), T.StructField("end_line", T.IntegerType()), T.StructField("docstring", T.StringType()), T.StructField("bases", T.ArrayType(T.StringType())), T.StructField("decorators", T.ArrayType(T.StringType())), T.StructField("parameters", PARAMETER), T.StructField("return_type", T.StringType()), T.StructField("is_async", T.BooleanType()), T.StructField("is_generator", T.BooleanType()), T.StructField("is_abstract", T.BooleanType()), T.StructField("complexity", T.IntegerType()), T.StructField("error", T.StringType())])
IMPORT = T.StructType([T.StructField("module_name", T.StringType()), T.StructField("names", T.ArrayType(T.StringType())), T.StructField("is_relative", T.BooleanType()), T.StructField("level", T.IntegerType()), T.StructField("line", T.IntegerType())])
REFERENCE = T.StructType([T.StructField("source", T.StringType()), T.StructField("target", T.StringType()), T.StructField("type", T.StringType()), T.StructField("line", T.IntegerType())])


@F.udtf(returnType=ENTITY)
class ParseEntities:
    """SELECT * FROM files, LATERAL parse_entities(content)."""

    def eval(self, text: str):
        if text is not None:
            for r in entities(text):
                yield tuple(r[f.name] for f in ENTITY)


@F.udtf(returnType=IMPORT)
class ParseImports:
    def eval(self, text: str):
        if text is not None:
            for r in imports(text):
                yield tuple(r[f.name] for f in IMPORT)


@F.udtf(returnType=REFERENCE)
class ParseReferences:
    def eval(self, text: str, module: str):
        if text is not None:
            for r in references(text, module or ""):
                yield tuple(r[f.name] for f in REFERENCE)
