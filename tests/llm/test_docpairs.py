import pytest

from codelode.llm import docpairs as dp

SAYS = ["Rounds half to even.", "Assumes UTC.", "Works lazily.", "Never returns an empty list.", ":param x: upper bound of rows read", "@return pairs in reading order, oldest first", "TODO: the cache must be warm before the first call", "索引每晚重建一次。", "/**\n * Load queue. Caller must hold the write lock.\n */", "Args:\n    a: name without the package part", "Falls back to parse_file."]
SAYS_NOT = [None, "", "  \n", "Load queue.", "Loads the queue", "loadQueue.", "LOAD_QUEUE", "--- load_queue ---", "Method load_queue", "Function to load queue.", "This function loads the queue.", "Loading a queue.", "TODO", "TODO(x): document", "FIXME: describe load_queue", "{@inheritDoc}", "@author someone", "Created 18/11/2018", "See base class.", "@see super", "(non-Javadoc)", "Auto-generated method stub", ":param a:\n:return:", "@param string a\n@return", "<summary></summary>", "...", "???", "-", "No description.", "Beschreibung fehlt.", "/**\n *\n */", "Load queue.\n\n@param Map<String, Integer> a\n@return"]


@pytest.mark.parametrize("doc", SAYS)
def test_says(doc):
    assert dp.tells(doc, "load_queue", ["a", "x"])


@pytest.mark.parametrize("doc", SAYS_NOT)
def test_says_not(doc):
    assert not dp.tells(doc, "load_queue", ["a", "x"])


def test_docstring_of_the_class():
    assert not dp.tells("Holds the open locks.", "run", [], "Holds the open\n  locks.")


PY = 'import os\n\n@deco\ndef f(a=")", b: dict[str, int] = {}):\n    # note\n    """Says a thing."""\n    x = 1\n\n    return x\n\ndef g(): pass\n'
TS = "/** Header. */\n\n/** First. */\n@dec()\nfunction a(x: string) {\n  return '}';\n}\n/* no doc */\nfunction b() {}\n"


def island(text, name, line, ext):
    return dp.File(text, ext).island(name, line)


def test_islands():
    doc, code = island(PY, "f", 4, "py")
    assert doc == "Says a thing." and code.startswith("@deco\ndef f") and code.endswith("return x")
    assert island(PY, "g", 11, "py") == (None, "def g(): pass")
    doc, code = island(TS, "a", 5, "ts")
    assert dp.clean(doc) == "First." and code == "@dec()\nfunction a(x: string) {\n  return '}';\n}"
    assert island(TS, "b", 9, "ts")[0] is None
    assert island("/** Header. */\n\nfunction a() {}", "a", 3, "js")[0] is None
    assert island(PY, "f", None, "py") == island(PY, "f", 99, "py") == island(PY, None, 4, "py") == island(None, "f", 4, "py") == island(PY, "f", 4, "md") == (None, None)


#: (extension, text, name, line, documentation, code from its first to its last character)
ISLANDS = [
    ("js", "function f({a, b}, c = {}) {\n  return a + b;\n}\nx();", "f", 1, None, ("function f({a", "a + b;\n}")),
    ("js", "/** Cuts. */\nexport function g(s) {\n  return s.replace(/[}]\\/{/g, `}${h({a: '}'})}`) / 2;\n}\nlet y = 1;", "g", 2, "Cuts.", ("export function", "/ 2;\n}")),
    ("js", "const o = {\n  a() { return 1 },\n  /** Says. */\n  b(x = {}) { return /}/.test(x) },\n}", "b", 4, "Says.", ("b(x", "test(x) }")),
    ("js", "class A {\n  x = {a: 1};\n  /** Runs. */\n  @log({deep: true})\n  static async *run(a, b = ')') {\n    yield '}'\n  }\n}", "run", 5, "Runs.", ("@log", "'}'\n  }")),
    ("js", "/** Adds. */\nexport const add = async (a, {b} = {}) => {\n  return a;\n};\n", "add", 2, "Adds.", ("export const", "return a;\n}")),
    ("js", "const twice = x => x * 2;\nconst z = 1;", "twice", 1, None, ("const twice", "x * 2;")),
    ("ts", "/** Maps. */\nfunction m<T extends { k: string }>(a: { b: T }, f: (x: T) => void): { r: T[] } | null {\n  return { r: [] };\n}\n", "m", 2, "Maps.", ("function m", "[] };\n}")),
    ("ts", "abstract class Q {\n  /** Opens. */\n  abstract open(a: Map<string, { x: 1 }>, b?: string): Promise<void>;\n  next() {}\n}", "open", 3, "Opens.", ("abstract open", "Promise<void>;")),
    ("java", "class A {\n  int x;\n  /** Reads all rows. */\n  @Get(\n    path = \"/{id}\",\n    codes = {1, 2}\n  )\n  @Deprecated\n  public Map<String, List<int[]>> rows(@P(\")\") int a, String... b) throws E, F {\n    char c = '}';\n    return null;\n  }\n}", "rows", 9, "Reads all rows.", ("@Get(", "null;\n  }")),
    ("java", "interface I {\n  /** Counts. */\n  int count(List<? super T> a);\n}", "count", 3, "Counts.", ("int count", "a);")),
    ("php", "<?php\n/** Opens it. */\n#[Route(\n  '/x',\n  methods: ['GET'],\n)]\nfunction open(array $a = ['}'], ?int $b = null): ?array {\n  // }\n  return [<<<T\n }\n T];\n}\n", "open", 7, "Opens it.", ("#[Route(", "T];\n}")),
    ("php", "<?php $a = 1; ?>\n<p>{</p>\n<?php\n/** Shows. */\nfunction show() { return 1; }", "show", 5, "Shows.", ("function show", "1; }")),
    ("py", "class A:\n    @deco(\n        a=1,\n    )\n    @other\n    async def f(self, a=lambda: ')', b: dict = {1: 2}) -> dict[str, int]:\n        # first\n        r\"\"\"Says: \\d.\"\"\"\n        x = \"\"\"\nnot the end\n\"\"\"\n        return (x,\n  1)\n\n    # next\n    def g(self): pass\n", "f", 6, "Says: \\d.", ("@deco(", "  1)")),
    ("py", "def f(a): 'One line.'; return a\nx = 1\n", "f", 1, "One line.", ("def f", "return a")),
]


@pytest.mark.parametrize(("ext", "text", "name", "line", "says", "span"), ISLANDS)
def test_code_is_the_source_span(ext, text, name, line, says, span):
    doc, code = island(text, name, line, ext)
    assert (doc if doc is None else dp.clean(doc)) == says
    begin, end = text.index(span[0]), text.index(span[1]) + len(span[1])
    assert code is not None and code.strip() == text[begin:end]


@pytest.fixture(scope="module")
def tables(spark):
    fn = "id long, module_id long, class_id long, name string, docstring string, parameters array<struct<name:string,type:string,default:string>>, start_line int, content string"
    f = [(1, 1, None, "f", None, None, 4, "x"), (1, 1, None, "f", None, None, 4, "x"), (2, 1, None, "g", "Needs the lock.", [("a", None, None)], 11, "y"), (3, 9, None, "h", "Works in place.", None, None, None), (4, 1, 5, "run", "Shared text here.", None, None, ""), (5, None, None, None, None, None, None, None), (6, 1, None, "f", "TODO", None, 4, "")]
    return [
        spark.createDataFrame(f, fn),
        spark.createDataFrame([(1, 1, "m"), (1, 1, "m"), (2, None, "n")], "id long, file_id long, name string"),
        spark.createDataFrame([(5, "Shared text here.", "c"), (5, "Shared text here.", "c"), (6, None, "d")], "id long, docstring string, name string"),
        spark.createDataFrame([(1, "a/b.py"), (1, "a/b.py"), (2, None)], "id long, path string"),
        spark.createDataFrame([(1, PY), (1, PY), (2, None)], "file_id long, content string"),
    ]


def test_table(tables):
    rows = {r.function_id: r for r in dp.pairs(*tables).collect()}
    assert sorted(rows) == [1, 2, 3] and rows[1].description == "Says a thing." and "return x" in rows[1].code and rows[3].code is None


def test_empty(tables):
    assert dp.pairs(*[t.limit(0) for t in tables]).count() == 0
