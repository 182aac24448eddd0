"""Generated, minified and vendored source files, and bulk data saved as code.

Attribute files of a repository (``.gitattributes``) say which paths are generated or vendored; the last matching line of
the deepest directory wins, and an attribute that is unset or false overrules the rest. To repositories that declare
nothing, patterns of the same form apply: well-known ones, and those mined from this corpus. A pattern (a directory at any
depth, or the end of a file's name) is mined if three repositories declare it, if nearly all files under it are foreign
or generated by what their content tells in several repositories, or if so many of them carry a generator's mark that the
rest must be of the same make. Content tells too: a generator's mark in the file's head, minified layout, tables of data,
accessors made by rule, a foreign project's notice, and the same code in three or more repositories.

Defined results
* only .py, .js, .ts, .java and .php files with content get a row; null content, other extensions: none;
* marks count in comments before the first code only, not in strings, and not the names of method stubs;
* the same text counts without comments and white space, so a notice or a patch note added on top does not hide a copy;
  texts with hardly any code never count, nor do other branches of one repository;
* ``!attribute`` takes back what was said of it before, as if no line had named it;
* texts of fewer than 200 characters have no layout, code of fewer than 120 is no copy; both are parameters;
* rows delivered twice count once; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.session import shared_dir, ship

EXTENSIONS = r"\.(py|js|ts|java|php)$"

#: Well-known patterns, in the form of an attribute file at a repository's root.
KNOWN = """
node_modules/** vendored
bower_components/** vendored
jspm_packages/** vendored
Godeps/** vendored
**/_vendor/** vendored
**/vendored/** vendored
**/site-packages/** vendored
vendor/*/** vendored
third_party/** vendored
third-party/** vendored
3rdparty/** vendored
extern/*/** vendored
external/*/** vendored
externals/*/** vendored
deps/*/** vendored
Pods/** vendored
Carthage/** vendored
wp-includes/** vendored
**/*.min.js generated
**/*-min.js generated
**/*.bundle.js generated
**/*_pb2.py generated
**/*_pb2_grpc.py generated
**/*_pb.js generated
**/*_pb.ts generated
**/*.pb.ts generated
**/*.generated.* generated
**/*.g.ts generated
**/__generated__/** generated
**/generated-sources/** generated
**/generated-src/** generated
**/generated/** generated
**/autogen/** generated
**/autogenerated/** generated
**/gen/*_client.py generated
**/gen/*_pb* generated
var/cache/** generated
build/generated/** generated
**/_generated/** generated
"""


# --- attribute files --------------------------------------------------------------------------------------------------
@functools.lru_cache(65536)
def glob_regex(pattern: str) -> re.Pattern[str]:
    """An attribute file's pattern as a regular expression over paths relative to that file's directory.

    A pattern without a slash (but for the last character) matches at any depth; ``**`` spans directories.
    """
    p = pattern.lstrip("/")
    anchored = "/" in pattern.rstrip("/")
    out, i = [], 0
    while i < len(p):
        if p.startswith("**/", i):
            out.append("(?:[^/]+/)*")
            i += 3
        elif p.startswith("/**", i) and i + 3 == len(p):
            out.append("/.+")
            i += 3
        elif p.startswith("**", i):
            out.append(".*")
            i += 2
        elif p[i] == "*":
            out.append("[^/]*")
            i += 1
        elif p[i] == "?":
            out.append("[^/]")
            i += 1
        elif p[i] == "[" and "]" in p[i + 2 :]:
            j = p.index("]", i + 2)
            body = p[i + 1 : j].replace("\\", "\\\\")
            out.append("[" + ("^" + body[1:] if body[0] == "!" else body) + "]")
            i = j + 1
        else:
            out.append(re.escape(p[i + 1] if p[i] == "\\" and i + 1 < len(p) else p[i]))
            i += 2 if p[i] == "\\" else 1
    try:
        return re.compile(("" if anchored else "(?:.*/)?") + "".join(out).rstrip("/") + r"\Z", re.S)
    except re.error:
        return re.compile(r"(?!)")


def parse_attributes(text: str) -> list[tuple[str, str, bool | None]]:
    """(pattern, vendored or generated, set, unset or None if taken back) of each line in order."""
    out: list[tuple[str, str, bool | None]] = []
    for line in text.split("\n"):
        parts = line.strip().split()
        if len(parts) < 2 or parts[0].startswith("#"):
            continue
        for a in parts[1:]:
            name, _, value = a.lstrip("-!").partition("=")
            kind = name.removeprefix("linguist-")
            if kind in ("vendored", "generated"):
                state = None if a[0] == "!" else a[0] != "-" and value.lower() not in ("false", "0", "no")
                out.append((parts[0].strip('"'), kind, state))
    return out


@functools.lru_cache(4096)
def compiled(files: tuple[tuple[str, str], ...]) -> list[tuple[str, list[tuple[re.Pattern[str], str, bool | None]]]]:
    """A repository's attribute files (directory, text), shallow ones first, with their patterns compiled."""
    order = sorted(files, key=lambda x: (x[0].count("/") + bool(x[0]), x))
    return [(at, [(glob_regex(p), kind, on) for p, kind, on in parse_attributes(text)]) for at, text in order]


def declared(path: str, files: list[tuple[str, str]]) -> dict[str, bool]:
    """What the attribute files (directory, text) of a repository say of a path: vendored and generated, if they say it."""
    said: dict[str, bool | None] = {}
    for at, rules in compiled(tuple(files)):
        if at and not path.startswith(at + "/"):
            continue
        rel = path[len(at) + 1 :] if at else path
        for rx, kind, on in rules:
            if rx.match(rel):
                said[kind] = on
    return {kind: on for kind, on in said.items() if on is not None}


@functools.cache
def _known() -> list[tuple[str, re.Pattern[str]]]:
    by: dict[str, list[str]] = {}
    for pattern, kind, _ in parse_attributes(KNOWN):
        by.setdefault(kind, []).append(f"(?:{glob_regex(pattern).pattern})")
    return [(k, re.compile("|".join(v), re.S)) for k, v in by.items()]


#: A project inside a larger repository stands two directories down and has its own root.
_WORKSPACE = re.compile(r"^[\w.-]+/[\w.-]+/")
_JAVA_ROOT = re.compile(r"(?:^|/)src/(?:main|test)/java/")


def by_path(path: str) -> str | None:
    """What the well-known patterns say of a path at the repository's root or that of a project inside it."""
    root = _WORKSPACE.sub("", path, count=1)
    for kind, rx in _known():
        if rx.match(path) or (root != path and rx.match(root)):
            if kind == "vendored" and _JAVA_ROOT.search(path):
                continue
            return kind
    return None


_DIRECTORY = re.compile(r"/?(?:\*\*/)?([\w.-]+)/(?:\*\*?(?:/\*)?)?")
_ENDING = re.compile(r"/?(?:\*\*/)?\*([._-][\w.-]+)")


def general(pattern: str) -> str | None:
    """The pattern's form at any depth, as ``candidates`` has it; None if it's of another kind."""
    if m := _DIRECTORY.fullmatch(pattern):
        return f"**/{m.group(1)}/**"
    m = _ENDING.fullmatch(pattern)
    return f"**/*{m.group(1)}" if m else None


def candidates(path: Column) -> Column:
    """The patterns a path could be an instance of: its directories at any depth and the ends of its name."""
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    directories = F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda d: F.concat(F.lit("**/"), d, F.lit("/**")))
    dot = F.length(name) - F.locate(".", F.reverse(name)) + 1  # an extension alone is no pattern
    places = F.when(dot > 2, F.filter(F.sequence(F.lit(2), F.greatest(dot - 1, F.lit(2))), lambda i: F.substring(name, i, 1).isin(".", "_", "-"))).otherwise(F.array().cast("array<int>"))
    endings = F.transform(places, lambda i: F.concat(F.lit("**/*"), F.substring(name, i, F.length(name))))
    return F.array_distinct(F.concat(directories, endings))


# --- content ----------------------------------------------------------------------------------------------------------
_HEAD_PY = re.compile(r"\s*(?:\#[^\n]*\n?|(?:r|u)?\"\"\"(?:[^\\]|\\.)*?\"\"\"|(?:r|u)?'''(?:[^\\]|\\.)*?'''|\"[^\"\n]*\"(?=\s*\n)|'[^'\n]*'(?=\s*\n))", re.S)
_HEAD_C = re.compile(r"\s*(?://[^\n]*\n?|/\*.*?(?:\*/|\Z)|\#![^\n]*\n|<\?php\b|declare\(strict_types=1\);|['\"]use strict['\"];?)", re.S)


def head_of(text: str, ext: str) -> str:
    """The comments before the first code; of Python the module's docstring too."""
    rx = _HEAD_PY if ext == "py" else _HEAD_C
    at = 1 if text.startswith("﻿") else 0
    start = at
    while m := rx.match(text, at):
        if m.end() == at:
            break
        at = m.end()
    return text[start:at]


_MARKS = re.compile(
    "|".join(
        [
            r"@generated\b(?! here)",
            r"<auto-?generated\b",
            r"\bauto-?generated (?:file|code|by|from|client|source|module|class|do not|with|using|content)",
            r"\b(?:this|the) (?:is an? |file is |code is |file was |code was |\w+ (?:is|was|were|has been) )(?:auto(?:matically)?[- ])?(?:re)?(?:generated|created|produced|built) (?:automatically )?(?:by|from|with|using)\b",
            r"\b(?:this|the) \w+ (?:is|was|has been) (?:automatically|auto-?|machine-?)\s?(?:generated|created|produced)\b",
            r"\bis an auto-?generated\b",
            r"\bcode generated (?:by|from|with)\b",
            r"(?:^|(?<=[\s*#/]))(?:auto(?:matically)? ?)?generated (?:by|from|with|using|on) [\w./@<\"'-]+(?: [\w./-]+){0,3}\s*(?:$|[.;,:\-–—(]| do not|don't|on )",
            r"\b(?:do not|don't|never) (?:edit|modify|change|touch)\b[^\n]{0,40}\b(?:generated|rebuilt|regenerated|overwritten|by hand|manually|directly)",
            r"\b(?:do not|don't) (?:edit|modify|touch)\b\s*(?:$|[.!*\-–—]|this file)",
            r"\bmachine[- ]?(?:made|generated|written)\b",
            r"\b(?:manual|hand) (?:edits?|changes?|modifications?) (?:are|is|will be|get)\b[^\n]{0,12}\b(?:overwritten|lost|discarded)",
            r"\bwill be (?:overwritten|lost|regenerated)\b",
            r"\bregenerate with\b|\bregenerated? (?:by|from|with) (?:running )?[`'\"]?\w",
            r"\bcodegen: ?\w",
            r"\brerun `[^`\n]+` to (?:refresh|regenerate|update|rebuild)",
            r"\boutput, rerun\b",
            r"\bderived from \S+\.\w+, see the \S+ target of the build",
            r"^[ \t#/*\"']{0,16}[\w-]{1,64} export of \S+\.\w+",
            r"\bproduced by [\w-]+ v?\d+\.\d+",
            r"\brebuilt by [\w-]+ (?:every|on each|each)",
            r"\bedit \S+\.\w+ and (?:rebuild|regenerate)",
            r"automatisch (?:erzeugt|generiert|erstellt)|maschinell erzeugt|nicht von hand (?:ändern|bearbeiten)",
            r"(?:généré|generé) (?:automatiquement|par)|ne pas (?:modifier|éditer)",
            r"generado (?:automáticamente|por)|no (?:editar|modificar)\b",
            r"自動生成|自动生成|编集しない|編集しないで|请勿(?:手动)?(?:编辑|修改)|勿手动修改",
        ]
    ),
    re.I | re.M,
)
_FOREIGN = re.compile(
    r"\bpart of (?P<a>[\w.@/-]+) v?\d+\.\d+[\w.]*\. see the licen[cs]e of"
    r"|^[ \t#/*\"']{0,16}(?P<b>[\w.@/-]{1,80}) v\d+\.\d+[\w.]* \| [\w.+-]+ licen[cs]ed"
    r"|\bspdx-filecopyrighttext: (?:\d{4}\S* )?(?:the )?(?P<c>[\w.@/ -]+?)(?: project| authors| contributors)?\s*(?:\*/)?\s*$"
    r"|^[ \t#/*\"']{0,16}(?P<d>[\w.@/-]{1,80}) - [^\n]*\n[ \t#/*]{0,16}version:? v?\d+\.\d+[^\n]*\n[ \t#/*]{0,16}licen[cs]e:",
    re.I | re.M,
)
_COMMENT_OUT = re.compile(r"\"\"\"(?:[^\\]|\\.)*?\"\"\"|'''(?:[^\\]|\\.)*?'''|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`|\#[^\n]*|//[^\n]*|/\*.*?(?:\*/|\Z)", re.S)
_NUMBER = re.compile(r"-?\b0[xX][\da-fA-F]+\b|-?\b\d[\d_]*(?:\.\d+)?(?:[eE][+-]?\d+)?\b")
_BLOB = re.compile(r"[\"'][A-Za-z0-9+/=_\\-]{40,}[\"']")
_DIGITS = re.compile(r"\d+")


def foreign(head: str, own: str) -> bool:
    """Whether the head holds the notice of a project that isn't this repository's."""
    for m in _FOREIGN.finditer(head):
        name = next(x for x in m.groups() if x)
        if name.lower() != own.lower():
            return True
    return False


def layout(text: str, least: int = 200) -> str | None:
    """minified, data or by_rule if the text's layout says so; a text of fewer than ``least`` characters has none."""
    n = len(text)
    if n < least:
        return None
    lines = [x for x in text.split("\n") if x.strip()]
    if not lines:
        return None
    long_ = sum(len(x) for x in lines if len(x) > 200)
    numbers = sum(len(x) + 2 for x in _NUMBER.findall(text))
    blobs = sum(map(len, _BLOB.findall(text)))
    if numbers > 0.7 * n or blobs > 0.6 * n:
        return "data"
    if long_ > 0.6 * n and text.count(" ") < 0.12 * n and n / len(lines) > 200:
        return "minified"
    kinds: dict[str, int] = {}
    for x in lines:
        k = _DIGITS.sub("0", x.strip())
        kinds[k] = kinds.get(k, 0) + 1
    common = sum(sorted(kinds.values(), reverse=True)[:8])
    if len(kinds) < 0.2 * len(lines) and common > 0.85 * len(lines):
        return "by_rule"
    return None


def code_key(text: str, ext: str, least: int = 120) -> bytes | None:
    """A fingerprint of the code without comments, docstrings and white space; None if there is hardly any."""

    def keep(m: re.Match[str]) -> str:
        t = m.group()
        if t[:3] in ('"""', "'''") or t[:2] in ("//", "/*"):
            return " "
        if t[0] == "#":
            return " " if ext in ("py", "php") else t
        return t

    code = "".join(_COMMENT_OUT.sub(keep, text.removeprefix("<?php")).split())
    return hashlib.blake2b(code.encode("utf-8", "replace"), digest_size=16).digest() if len(code) >= least else None


def by_content(path: str, text: str, own: str) -> str | None:
    """Why a file's content says that it isn't hand-written in its repository."""
    head = head_of(text, path.rsplit(".", 1)[-1])
    if head:
        for m in _MARKS.finditer(head):
            lo, hi = head.rfind("\n", 0, m.start()) + 1, head.find("\n", m.end())
            line = head[lo : hi if hi >= 0 else len(head)]
            if "method stub" not in line.lower():
                return MARKED
        if foreign(head, own):
            return "notice of another project"
    return layout(text)


def judge(path: str, text: str, own: str, attributes: list[tuple[str, str]] | None = None) -> str | None:
    """Why a file isn't hand-written in its repository, as far as the file by itself tells."""
    said = declared(path, attributes) if attributes else {}
    for kind in ("generated", "vendored"):
        if said.get(kind):
            return f"declared {kind}"
    kind = None if attributes else by_path(path)
    return f"path of {kind}" if kind else by_content(path, text, own)


MARKED = "marked generated"


# --- on Spark --------------------------------------------------------------------------------------------------------
def attribute_rules(files: DataFrame, contents: DataFrame) -> DataFrame:
    """(repository_id, attributes: array of (at, text)) of the repositories whose attribute files name what counts here."""
    f = files.filter(F.col("path").rlike(r"(^|/)\.gitattributes$"))
    c = contents.filter(F.col("content").isNotNull()).select("file_id", "content")
    says = f.join(c, "file_id").filter(F.col("content").rlike(r"(?:vendored|generated)"))
    return says.groupBy("repository_id").agg(F.array_sort(F.collect_set(F.struct(F.regexp_replace("path", r"/?\.gitattributes$", "").alias("at"), F.col("content").alias("text")))).alias("attributes"))


def said_of(files: DataFrame, rules: DataFrame, most_bytes: int = 16 << 20, salts: int = 16) -> DataFrame:
    """(file_id, said: declared generated, declared vendored, or nothing of both) of the files of repositories with rules.

    Rules of a small total size are broadcast; beyond ``most_bytes`` they are joined with salted keys, as one repository
    may hold a third of all files.
    """
    size = rules.select(F.sum(F.length(F.to_json("attributes")))).first()[0] or 0
    src = files.select("file_id", "repository_id", "path")
    if size <= most_bytes:
        both = src.join(F.broadcast(rules), "repository_id")
    else:
        spread = rules.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        both = src.withColumn("salt", F.pmod("file_id", F.lit(salts)).cast("int")).join(spread, ["repository_id", "salt"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for p, a in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                said = declared(p, [(x["at"], x["text"]) for x in a])
                out.append(next((f"declared {k}" for k in ("generated", "vendored") if said.get(k)), ""))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["file_id", "said"])

    return both.select("file_id", "path", "attributes").mapInArrow(read, "file_id long, said string")


def mined(seen: DataFrame, rules: DataFrame, repositories: int = 3, pure: float = 0.95, marked: float = 0.2) -> DataFrame:
    """(pattern, kind) of the patterns that declarations or the content of the files below them speak for.

    Each needs ``repositories`` of them. ``pure``: the share of files whose content tells; ``marked``: the share that a
    generator marked, which it does to a part of what it writes, and hand-written directories hold next to none.
    """
    rows = seen.select("file_id", "repository_id", F.coalesce("why", F.when(F.col("copied"), F.lit("copied"))).alias("why"), F.explode(candidates(F.col("path"))).alias("pattern"))
    told, mark = F.col("why").isNotNull(), F.coalesce(F.col("why") == MARKED, F.lit(False))
    per = rows.groupBy("pattern", "repository_id").agg(F.count("*").alias("n"), F.count_if(told).alias("told"), F.count_if(mark).alias("marked"))
    stats = per.groupBy("pattern").agg(F.sum("n").alias("n"), F.sum("told").alias("told"), F.sum("marked").alias("marked"), F.count_if(F.col("told") > 0).alias("r"), F.count_if(F.col("marked") > 0).alias("mr"))
    foreign_ = stats.filter((F.col("r") >= repositories) & (F.col("told") >= pure * F.col("n"))).select("pattern", F.lit("vendored").alias("kind"))
    # a directory whose marks all come from one below it is not spoken for: each file counts for its likeliest pattern only
    likely = stats.filter((F.col("mr") >= repositories) & (F.col("marked") >= marked * F.col("n"))).select("pattern", F.struct(F.col("marked") / F.col("n"), "n", "pattern").alias("rank"))
    one = rows.select("file_id", "repository_id", mark.alias("mark"), "pattern").join(likely, "pattern").groupBy("file_id").agg(F.max("rank")["pattern"].alias("pattern"), F.first("repository_id").alias("repository_id"), F.first("mark").alias("mark"))
    left = one.groupBy("pattern").agg(F.count("*").alias("n"), F.count_if("mark").alias("marked"), F.count_distinct(F.when(F.col("mark"), F.col("repository_id"))).alias("mr"))
    made = left.filter((F.col("mr") >= repositories) & (F.col("marked") >= marked * F.col("n"))).select("pattern", F.lit("generated").alias("kind"))
    found = made.unionByName(foreign_)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(r, g, k) for r, a in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for x in a for p, k, on in parse_attributes(x["text"]) if on and (g := general(p))]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string()))], ["repository_id", "pattern", "kind"])

    said = rules.select("repository_id", "attributes").mapInArrow(read, "repository_id long, pattern string, kind string").distinct().groupBy("pattern").agg(F.min("kind").alias("kind"), F.countDistinct("repository_id").alias("r")).filter(F.col("r") >= repositories).select("pattern", "kind")
    return found.unionByName(said).groupBy("pattern").agg(F.min("kind").alias("kind"))


def not_handwritten(files: DataFrame, contents: DataFrame, repositories: DataFrame, copies: int = 3) -> DataFrame:
    """(file_id, repository_id, path, why) of the files nobody wrote by hand in their repository.

    What the pass over the texts finds, a few bytes a file, is checkpointed; what is declared, copied or mined joins it by
    key. The count of repositories per fingerprint and the counts per pattern aggregate before their shuffles, so a text
    or a directory that a third of all files share is a few rows a task.
    """
    spark = files.sparkSession
    ship(spark)
    shared_dir(spark)
    f = files.filter(F.col("path").isNotNull()).select(F.col("id").alias("file_id"), "repository_id", "path").dropDuplicates(["file_id"])
    own = repositories.select(F.col("id").alias("repository_id"), F.col("name").alias("own")).dropDuplicates(["repository_id"])
    c = contents.filter(F.col("content").isNotNull()).select("file_id", "content")
    rules = attribute_rules(f, c).checkpoint()
    src = f.filter(F.col("path").rlike(EXTENSIONS)).join(own, "repository_id", "left").join(c, "file_id").select("file_id", "repository_id", "path", "own", "content")
    fields = pa.schema([("file_id", pa.int64()), ("repository_id", pa.int64()), ("path", pa.string()), ("why", pa.string()), ("known", pa.string()), ("key", pa.binary())])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = {n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)}
            why = [by_content(p, t, o or "") for p, t, o in zip(cols["path"], cols["content"], cols["own"])]
            known = [by_path(p) for p in cols["path"]]
            key = [code_key(t, p.rsplit(".", 1)[-1]) for p, t in zip(cols["path"], cols["content"])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(why, pa.string()), pa.array(known, pa.string()), pa.array(key, pa.binary())], schema=fields)

    seen = src.mapInArrow(look, "file_id long, repository_id long, path string, why string, known string, key binary").dropDuplicates(["file_id"])
    shared = F.col("key").isNotNull()
    seen = seen.checkpoint()
    often = seen.filter(shared).select("key", "repository_id").distinct().groupBy("key").count().filter(F.col("count") >= copies).select("key", F.lit(True).alias("copied"))
    both = seen.filter(shared).join(often, "key", "left").unionByName(seen.filter(~shared).withColumn("copied", F.lit(None).cast("boolean"))).drop("key")
    said = said_of(seen, rules)
    patterns = mined(both, rules)
    like = both.select("file_id", F.explode(candidates(F.col("path"))).alias("pattern")).join(patterns, "pattern").groupBy("file_id").agg(F.min("kind").alias("mined"))
    out = both.join(said, "file_id", "left").join(like, "file_id", "left")
    free = F.col("said").isNull()  # the repository declares nothing
    why = F.coalesce(
        F.when(F.col("said") != "", F.col("said")),
        F.when(free & F.col("known").isNotNull(), F.concat(F.lit("path of "), "known")),
        F.col("why"),
        F.when(F.col("copied"), F.lit("the same code in several repositories")),
        F.when(free & F.col("mined").isNotNull(), F.concat(F.lit("mined path of "), "mined")),
    )
    return out.withColumn("why", why).filter(F.col("why").isNotNull()).select("file_id", "repository_id", "path", "why")
