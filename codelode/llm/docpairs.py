"""Functions paired with their documentation.

An island grammar per language reads, from a function's line on, its annotations, signature and balanced body, and its
documentation: in Python the string that opens the body, elsewhere the ``/** */`` block right above the signature and
its annotations. All other code is water. Pairs whose documentation says nothing beyond the code are dropped.

Defined results
* the documentation is the field ``docstring`` or, where that is null, the one in the source;
* it is dropped if it is null or blank, stands in for documentation, restates the name or the signature, names author or
  date, points elsewhere, or equals the docstring of the function's class; text in tags counts if it explains;
* a function whose file, content or line is missing has no documentation in the source and no code;
* rows delivered twice count once; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.session import ship

from . import islands

EXTENSIONS = {"py": "py", "js": "js", "jsx": "js", "mjs": "js", "cjs": "js", "ts": "ts", "tsx": "ts", "mts": "ts", "cts": "ts", "java": "java", "php": "php"}


def starts_of(text: str) -> list[int]:
    """Offset of each line, lines split at line feeds."""
    at, out = 0, [0]
    while (at := text.find("\n", at) + 1) > 0:
        out.append(at)
    return out


class File:
    """A file's islands, read when the first of its functions is asked for."""

    def __init__(self, text: str | None, ext: str | None) -> None:
        self.text, self.kind = text, EXTENSIONS.get(ext or "")
        self.lines: list[int] = []
        self.read: islands.Braces | islands.Lines | None = None

    def island(self, name: str | None, line: int | None) -> tuple[str | None, str | None]:
        """(documentation, code) of the function ``name`` at the 1-based ``line``."""
        if self.text is None or self.kind is None or line is None or not name:
            return None, None
        if self.read is None:
            self.lines, self.read = starts_of(self.text), islands.reader(self.text, self.kind)
        if not 1 <= line <= len(self.lines):
            return None, None
        return self.read.island(name, self.lines[line - 1], self.lines[line] if line < len(self.lines) else len(self.text))


# --- what documentation says -----------------------------------------------------------------------------------------
_QUOTES = re.compile(r"^(\"\"\"|'''|[\"'])(.*)\1$", re.S)
_STAR = re.compile(r"^[ \t]*\*+[ \t]?", re.M)
_HTML = re.compile(r"</?[a-z][\w-]*\s*/?>")
_DROP_TAG = re.compile(r"^\s*[@\\:](?:author|since|version|date|created|copyright|license|see|link|inheritdoc|override|package|todo|internal|access|category|subpackage|api)s?\b:?", re.I)
_PARAM = re.compile(r"^\s*(?:[:@\\](?:param|parameter|arg|argument|type|rtype|returns?|throws?|raises?|exception|var|property|keyword|yields?|template|deprecated)\b)([^\n]*)$", re.I)
_HEADER = re.compile(r"^\s*(?:args?|arguments|parameters|params|returns?|raises|yields|throws|examples?|notes?|usage|attributes|keyword args)\s*:?\s*$", re.I)
_RULE = re.compile(r"^[\s\-=*_~#.]+$")
_ENTRY = re.compile(r"^\s+\*?\*?\$?\w+(?:\s*\([^)]*\))?\s*:\s*(.*)$")
_WORD = re.compile(r"[^\W_]+")
_CAMEL = re.compile(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|\d+|[^\W\d_A-Za-z]+")
_CJK = re.compile(r"[぀-ヿ㐀-鿿가-힯]")
_DATE = re.compile(r"\b(?:created|modified|updated|changed|added|written|erstellt|date|on|at|last)?[ :]*(?:on |at |am )?(?:\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}|\d{4}[/.-]\d{1,2}[/.-]\d{1,2})(?:[ T]\d{1,2}:\d{2}(?::\d{2})?)?\b", re.I)
_BY = re.compile(r"^\s*(?:(?:created|written|authored|added|maintained|modified|implemented|last (?:changed|modified))\s+by\b|(?:author|autor|maintainer|owner|date|created|version|since|last modified|copyright)\s*:)[^\n]*$", re.I | re.M)

#: Words that say nothing by themselves beside a name.
FILLER = set("a an the this that these those it its is are be to of for in on with and or by as from function functions func method methods class constructor procedure routine helper utility wrapper object instance module member member's name der die das eine ein funktion methode klasse la el un una le une función fonction método méthode".split())
TYPES = set("int integer long short byte float double number numeric bool boolean str string char text list array tuple set dict dictionary map object mixed any void none null nil undefined optional iterable iterator sequence record promise callable self cls this param params parameter parameters arg args argument arguments return returns value values type rtype".split())

#: Texts that only stand in for documentation, in lower case without marks; NAME is any one identifier.
STAND_IN = [
    r"(?:no|add|adds|write|insert|enter|put|missing|needs?|short|brief|long|some|your|the|a|an|give|provide|fill in|see|empty|default|method|function|class|generated)* ?(?:description|documentation|docstring|doc|docs|comment|comments|summary|text|javadoc|docblock)(?: (?:here|goes here|pending|missing|is missing|follows|follow|to follow|to come|needed|required|later|tbd|todo|fehlt|available|not available|of this method|of the method|string|comment|stub|for name|of name))*",
    r"(?:docs?|documentation|description|docstring) (?:for|of) NAME(?: (?:follow|follows|pending|missing|to follow|to come|here|goes here))?",
    r"(?:todo|fixme|xxx|tbd|tbc|hack|wip|nyi)(?: NAME)?(?: (?:document|describe|explain|comment|add docs?|write docs?|docs?|documentation|description|this|me|it|later|soon|(?:describe|document) NAME|write a description|add a description|add description|write description|add documentation|write documentation|write this|fill in|implement|fix))*",
    r"(?:document|describe|explain|comment|write|fix|implement|finish|complete|fill in)(?: (?:me|this|it|later|NAME|this function|this method|here))?",
    r"auto ?generated(?: (?:method|function|constructor|class|catch))? (?:stub|block|comment|documentation|doc)|(?:method|function|constructor) stub|generated (?:method|function)",
    r"non ?javadoc|inherit ?doc(?:s|umentation)?|(?:is |doc |docs |documentation )?inherited(?: (?:from|by) .{0,40})?|(?:copied|inherits) from (?:the )?(?:base|parent|super)(?: ?class| ?method)?|(?:documentation )?copied from interface",
    r"see(?: also)?(?: the)? (?:base|parent|super|superclass|interface|above|below|there|overridden|original|source|code|NAME)(?: (?:class|method|function|implementation|interface|documentation|docs|definition|doc))?(?: (?:for (?:details|more|docs|documentation|more details|more information)|NAME))?",
    r"(?:refer|cf|compare|vgl|siehe|voir|véase|ver)(?: to)?(?: the)? (?:base|parent|super|NAME|documentation|docs|interface|above)(?: (?:class|method|function|documentation|docs|implementation|interface))?(?: .{0,24})?",
    r"(?:overrides?|overriding|implements?|calls?|delegates? to|same as|like)(?: the)? (?:base|parent|super|superclass|interface|overridden|inherited)(?: (?:class|method|function|implementation|version|constructor))?(?:s)?",
    r"(?:default|base|standard|empty|dummy|initial|trivial|simple|the|this|an?)? ?(?:implementation|constructor|destructor|getter|setter|override|overload|placeholder|dummy|stub|initializer|initialiser|ctor|main|helper|internal|private|public|test|entry point|boilerplate)(?: (?:method|function|class|of this method|of this function|of NAME|here|implementation))?",
    r"(?:pass|xxx|tba|n ?a|none|null|nothing|test|foo|bar|blah(?: blah)*|lorem ipsum.*|self ?explanatory|obvious|as the name (?:says|suggests|implies)|does what it says|you know what this does|not documented|undocumented|undokumentiert|what it says|misc|stuff|unknown|placeholder|asdf|abc|to do|noch zu schreiben|wird nachgereicht|sin descripción|pendiente de documentar|descripción pendiente|documentación pendiente|à documenter|à compléter|description manquante|documentation manquante|beschreibung fehlt|dokumentation fehlt|todo|todo beschreibung|falta (?:la )?(?:descripción|documentación)|sans description|pas de description|keine beschreibung|ohne beschreibung|ドキュメント未作成|説明なし|説明|未記入|待补充|暂无说明|暂无描述|无描述|没有描述|文档待补|待完善|描述)",
]
_STAND_IN = re.compile("|".join(f"(?:{x})" for x in STAND_IN).replace("NAME", r"[\w.#:]+"))


def clean(doc: str) -> str:
    """Documentation without its comment marks and indentation."""
    t = doc.replace("\r\n", "\n").replace("\r", "\n").strip()
    m = _QUOTES.match(t)
    if m:
        t = m.group(2).strip()
    if t.startswith("/*"):
        t = re.sub(r"\**/$", "", re.sub(r"^/\*+", "", t))
    if "*" in t:
        t = _STAR.sub("", t)
    return t.strip()


@functools.lru_cache(65536)
def _parts(name: str) -> frozenset[str]:
    return frozenset(w.lower() for w in _CAMEL.findall(name))


@functools.lru_cache(65536)
def _stem(w: str) -> str:
    for end in ("ings", "ing", "ies", "ied", "ers", "es", "ed", "er", "s", "e", "y"):
        if w.endswith(end) and len(w) - len(end) >= 2:
            w = w[: -len(end)]
            break
    return w[:-1] if len(w) > 3 and w[-1] == w[-2] else w


def _news(text: str, known: frozenset[str]) -> int:
    """How many words of the text are none of the known ones, nor filler; characters of scripts without spaces count by twos."""
    news = 0
    for w in _WORD.findall(text):
        if _CJK.search(w):
            news += max(1, len(w) // 2)
            continue
        for p in (w.lower(),) if w.lower() in known or w.islower() else _CAMEL.findall(w):
            p = p.lower()
            if p in FILLER or p in known or _stem(p) in known or p.isdigit():
                continue
            news += 1
    return news


def tells(doc: str | None, name: str | None, params: list[str] | None = None, class_doc: str | None = None) -> bool:
    """Whether the documentation tells a reader something that name, parameters and types do not."""
    if doc is None:
        return False
    t = clean(doc)
    if not t:
        return False
    if class_doc is not None and t.split() == clean(class_doc).split():
        return False
    t = _HTML.sub(" ", t)
    own = frozenset(x for p in _parts(name or "") for x in (p, _stem(p)))
    given = frozenset(x for q in params or () if q for p in _parts(q) for x in (p, _stem(p), q.lower()))
    whole = (name or "").lower()
    prose: list[str] = []
    section = False
    for line in t.split("\n"):
        if not line.strip() or _RULE.match(line):
            section = section and bool(line.strip())
            continue
        if _HEADER.match(line):
            section = True
            continue
        if _DROP_TAG.match(line):
            continue
        m = _PARAM.match(line)
        if m:
            rest = m.group(1)
            if _news(rest, own | given | TYPES) >= 2:
                return True
            continue
        if section and (e := _ENTRY.match(line)):
            if _news(e.group(1), own | given | TYPES) >= 2:
                return True
            continue
        prose.append(line)
    text = _DATE.sub(" ", _BY.sub(" ", "\n".join(prose)))
    # what a TODO says counts, the mark itself doesn't
    for sentence in re.split(r"(?<=[.!?])\s+|\n\s*\n|\n(?=\s*[-*•])", text):
        flat = " ".join(re.findall(r"[^\W]+", re.sub(r"[{}@]", " ", sentence).lower()))
        if not flat or flat == whole or _STAND_IN.fullmatch(flat):
            continue
        body = re.sub(r"^\W*(?:todo|fixme|xxx|hack|note)\b(?:\([^)]*\))?\s*:?", "", sentence, flags=re.I)
        flat = " ".join(re.findall(r"[^\W]+", re.sub(r"[{}@]", " ", body).lower()))
        if not flat or _STAND_IN.fullmatch(flat):
            continue
        if body != sentence and len(flat.split()) < 3 and not _CJK.search(flat):
            continue
        if _news(body, own | (given if len(flat.split()) < 4 else frozenset())) >= 1 + (len(flat.split()) < 3 and not _CJK.search(flat)):
            return True
    return False


# --- on Spark --------------------------------------------------------------------------------------------------------
def pairs(functions: DataFrame, modules: DataFrame, classes: DataFrame, files: DataFrame, contents: DataFrame) -> DataFrame:
    """(function_id, name, class_docstring, description, code, agrees) of the functions whose documentation says something.

    Every function's island is read. ``agrees``: whether field and source hold the same documentation, null if one has none.
    """
    ship(functions.sparkSession)
    f = functions.select("id", "module_id", "class_id", "name", "docstring", F.transform("parameters", lambda p: p["name"]).alias("params"), "start_line").dropDuplicates(["id"])
    c = classes.filter(F.col("docstring").isNotNull()).select(F.col("id").alias("class_id"), F.col("docstring").alias("class_docstring")).dropDuplicates(["class_id"])
    # functions outside of classes, most of them, would be one key: they get keys of their own and lose what those find
    f = f.withColumn("loose", F.col("class_id").isNull()).withColumn("class_id", F.coalesce("class_id", -F.col("id"))).join(c, "class_id", "left")
    f = f.withColumn("class_docstring", F.when(~F.col("loose"), F.col("class_docstring"))).drop("class_id", "loose")
    m = modules.filter(F.col("file_id").isNotNull()).select(F.col("id").alias("module_id"), "file_id").dropDuplicates(["module_id"])
    ext = files.select(F.col("id").alias("file_id"), F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1)).alias("ext")).dropDuplicates(["file_id"])
    # a function without a module or file keeps its field: it gets a group of its own
    placed = f.join(m, "module_id", "left").withColumn("file_id", F.coalesce("file_id", -F.col("id") - 1))
    one = F.struct("id", "name", "docstring", "params", "start_line", "class_docstring")
    by_file = placed.groupBy("file_id").agg(F.collect_list(one).alias("functions")).join(ext, "file_id", "left")
    text = contents.filter(F.col("content").isNotNull()).select("file_id", "content").dropDuplicates(["file_id"])
    src = by_file.join(text, "file_id", "left").select("functions", "ext", "content")

    schema = "function_id long, name string, class_docstring string, description string, code string, agrees boolean"
    fields = pa.schema([("function_id", pa.int64()), ("name", pa.string()), ("class_docstring", pa.string()), ("description", pa.string()), ("code", pa.string()), ("agrees", pa.bool_())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for fs, x, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                file = File(t, x)
                for g in fs:
                    found, body = file.island(g["name"], g["start_line"])
                    doc = g["docstring"] if g["docstring"] is not None else found
                    if tells(doc, g["name"], g["params"], g["class_docstring"]):
                        said = clean(doc)
                        same = None if found is None or g["docstring"] is None else said.split() == clean(found).split()
                        rows.append((g["id"], g["name"], g["class_docstring"], said, body, same))
            yield pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(zip(*rows) if rows else [[]] * 6, fields.types)], schema=fields)

    return src.mapInArrow(read, schema)
