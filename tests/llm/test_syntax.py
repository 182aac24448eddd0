import ast
import pathlib
import warnings

import pytest

from codelode.llm import syntax as sx

GOOD = {
    "js": [
        "", "#!/usr/bin/env node\nconsole.log(1)", "import a, { b as c } from './x'\nexport default class extends a { #p = 1; static x = () => 2; get y() { return this.#p } async *z() {} }",
        "const re = /[({[]/g.test(x) ? a / b / c : `t ${a + `${b}`} }`;\nlet {a, b: [c = 1, ...d], ...e} = f?.g?.[0]?.(1) ?? {}", "for (const [k, v] of m) if (k) continue\nelse break", "label: for (;;) { break label }",
        "a = b\n++c\nvar f = async x => { await x }\n;(function () { return\n1 })()", "export * as ns from 'm'\nexport { a as default }\nx = { get a() { return 1 }, set a(v) {}, async *g() {}, ['k']: 1, b, ...c }", "switch (a) { case 1: default: b() }\ndo x++; while (x < 5) y()",
        "if (a) b()\nelse c()\ntry { x() } catch { y() } finally { z() }\nnew A\nnew (foo())(1)", "const x = '<<<<<<< HEAD'\n// <<<<<<< ours\n/* ======= */",
    ],
    "ts": [
        "export interface A<T extends B = C> extends D<T>, E { readonly x?: string; [k: string]: any; m<U>(a: U): asserts a is string; new (x: number): A }",
        "type M<T> = { readonly [K in keyof T]?: T[K] extends (infer U)[] ? U : never } & Partial<Record<'a' | `b${string}`, number[]>>", "enum E { A = 1, B = A << 2, 'C' }\ndeclare module 'x' { export function f(a: number, ...b: string[]): void }",
        "abstract class K<T> extends L<T> implements I, J { constructor(private readonly a: string, public b?: number) { super() } abstract f(): void; static #x: Map<string, Array<number>> = new Map<string, Array<number>>(); get v(): T { return this.t! } }",
        "const f = async <T,>(a: T, b?: number): Promise<T> => a as unknown as T satisfies T\nlet x = <any>y;\nfunction g(this: Window, a: string): a is 'x' { return true }", "import type { A } from './a'\nimport fs = require('fs')\nexport = fs", "namespace N.M { export const a: unique symbol = Symbol() }", "@dec() class A { @prop x: number = 1; @meth() f(@par a: string) {} }",
    ],
    "java": [
        "package a.b; import static java.util.List.*; public sealed interface S permits A, B {} record A(int x, String... y) implements S { A { if (x < 0) throw new IllegalArgumentException(); } }",
        "class A<T extends Comparable<? super T> & I> { int[] a[] = {1, 2}, b; static { int x = 1; } <U> A(U u) throws E { this.<U>f(u); } Map<String, List<int[]>> m = new HashMap<>() {{ put(\"a\", null); }}; }",
        "class A { void f() { for (int i = 0, j = 1; i < 3; i++, j--) ; for (var x : xs) {} int y = switch (z) { case 1, 2 -> 3; case Foo f -> { yield 4; } default -> throw e; }; Runnable r = () -> {}; Function<A, B> g = A::new; Object o = (Object & Runnable) () -> {}; if (o instanceof String s && s.length() > 1) {} String t = \"\"\"\n  a \"b\" ${c}\n  \"\"\"; a[i] >>>= 2; long l = (long) -1 >> 2; } }",
        "@interface X { int v() default 1; String[] w() default {\"a\"}; } enum E implements I { A(1) { void f() {} }, B; private final int x; E(int... x) { this.x = x.length; } }",
        "class A { void f() { try (var r = open(); s) { } catch (A | B e) { } finally { } synchronized (this) { } do x++; while (x < 3); label: while (true) { break label; } assert x > 0 : \"m\"; char c = '\\''; int h = 0xFF_FF; double d = 1e-3, e = .5f; } }",
    ],
    "php": [
        "", "<html><?= $a ?><p><?php if ($a): ?>x<?php elseif ($b): ?>y<?php else: ?>z<?php endif ?></p>", "<?php declare(strict_types=1); namespace A\\B; use C\\{D, E as F}; use function g; final readonly class K extends L implements M, N { use T { a as protected b; } public function __construct(private ?int $x = null, protected string|array $y = []) {} public const string Z = 'q'; public static ?self $i; abstract protected function f(int ...$a): static; }",
        "<?php $f = fn(int $x): int => $x ** 2; $g = static function () use (&$a, $b): void { yield 1 => 2; yield from h(); }; echo match(true) { $a > 1, $b => 'x', default => throw new E() };", "<?php $s = <<<EOT\n  text {$a['b']} <<<<<<<\n  EOT;\n$t = <<<'X'\nraw\nX;\n[$a, [, $b]] = $c; list('k' => $v) = $d; $o?->p->{$q}[0]::r(...); $x = $y ?: $z ?? (int) $w <=> 1;",
        "<?php enum Suit: string { case A = 'a'; case B = 'b'; const X = self::A; public function f(): self { return $this; } } foreach ($a as $k => [&$v, $w]) { continue 2; } while (1): endwhile; switch ($a) { case 1; default: } try { } catch (A | B) { } finally { } #[Attr(1)] function q(&...$r) { static $n = 0; global $m; }", "<?php // <<<<<<< HEAD\n$mark = '=======';\n# >>>>>>> x\n",
    ],
    "py": [
        "", "\n# only a comment", "def f(a, /, b: int = 1, *c, d=2, **e) -> None:\n\treturn lambda x, *y: (yield)\n", "@a.b(c)\nasync def g[T: int](x):\n    async with a as b, c: pass\n    async for i in x: await i\n    else:\n        pass\n", "match x:\n    case {'a': [1, *_], **r} if r: pass\n    case A(b=1) | None as n:\n        pass\n    case _: pass\nmatch = case = 1\ntype X[T] = list[T]\n",
        "try:\n  pass\nexcept* (A, B) as e:\n  pass\nelse:\n  x = y = z, *w\nfinally:\n  del x[1:2, ::3], y.z\n", "x: int = 1; y += 2 if a else b; print(*a, c=1, *[d for d in e if f for g in h], **b)\nassert x, 'm'\nraise A from b\nif (n := 3) > 2 and not a in b is not c: pass\n", "class A(B, metaclass=C): x = {**a, 'b': 1}; y = {*c, 1}; z = {k: v for k, v in w}\nfrom . import (a, b as c,)\nfrom ...x import *\n", "a = '''<<<<<<< HEAD'''\nb = f'{a!r:>{10}}' r'x' if 0 else b\"\\\n\"\n",
    ],
}
BAD = {
    "js": ["let x = ;", "function f( {", "if (a { }", "x = 1;\n<<<<<<< HEAD\ny = 2;\n=======\ny = 3;\n>>>>>>> b\n", "a b", "def f():\n    return 1\n", "class A { x = }", "const s = 'unclosed", "`${a`", "let y: number = 1", "for (let i of) {}", "return 08", "/* open"],
    "ts": ["interface A { x: }", "type = ;", "let x: = 1", "class A { f(: string) {} }", "enum E { A = }", "const x: Array<string = 1;\nlet a b"],
    "java": ["class A { int x }", "class A { void f() { int = 3; } }", "public class { }", "class A { void f() { if (x) } }", "class A { String s = \"open; }", "x = 1;", "class A { void f() { for (int i = 0; i < 3) {} } }", "class A {"],
    "php": ["<?php $a = ;", "<?php function (", "<?php class { }", "<?php if ($a) { ", "<?php $x = 'open", "<?php foreach ($a) {}", "<?php\n<<<<<<< HEAD\n$a = 1;\n=======\n"],
    "py": ["def f(:\n  pass", "if x\n  pass", "x = (1", "  x = 1\n y = 2", "class A:\n", "a b", "x = 'open", "1abc = 2", "f(a=1, 2)", "x = 5 = y", "f'{a b}'"],
}


@pytest.mark.parametrize(("ext", "text"), [(e, t) for e, ts in GOOD.items() for t in ts])
def test_valid(ext, text):
    assert sx.broken(text, ext) is None
    assert sx.recognisers().why_not(text, sx.DIALECTS[ext][0]) is None


@pytest.mark.parametrize(("ext", "text"), [(e, t) for e, ts in BAD.items() for t in ts])
def test_invalid(ext, text):
    assert sx.broken(text, ext) is not None


#: valid files that only another dialect than the standard takes
OTHER = [
    ("js", "script", "with (a) { b = 010 }\n<!-- old\nvar yield = 1"), ("js", "script", "x = 1\n--> done\n"),
    ("js", "jsx", "export default function App({ a }) {\n  return (\n    <Box.Item on={() => a < 1} {...rest} data-x='q'>\n      text {a ? <b>x</b> : null} {/* none */}\n      <></>\n    </Box.Item>\n  )\n}\nconst y = a < b / c;"),
    ("ts", "tsx", "const f = <T,>(x: T): JSX.Element => <A x={x as any} />;"), ("ts", "tsx", "export const C = (p: P) => <div className=\"a\">{p.xs.map((x: X) => <li key={x!.id}>{x.n}</li>)}</div>"),
    ("java", "java 21", "class A { int f(Object o) { return switch (o) { case Integer i when i > 5 -> 1; case P(int x, var y) when x > 0 -> 2; case null, default -> 0; }; } boolean g(Object o) { return o instanceof P(Q(var a), int b) && a > b; } }"),
    ("php", "php 7", "<?php $a = $b{0}; $c = (real) $d; $e[1]{2} = 3;"),
    ("py", "python 2", "import os\ntry:\n    print 'a', b\n    print >>f, `c`\n    exec 'x' in d\nexcept (A, B), e:\n    raise A, 'm', tb\nx = 0777 + 10L\nif a <> b: s = ur'x'\n"),
]
MORE_GOOD = {
    "php": ["<?php class A { public string $n { get => $this->n; set(string $v) { $this->n = $v; } } public private(set) int $k = 1; abstract protected int $z { get; } }"],
    "py": ['f"{x["a"]!r:>{w}} {{}} {y=} {lambda_:{a}.{b}}" rf"\\d{n}"\n', "x = [*a, *b]; (y), z.q[1:2] = 1, 2\nfor (a, b), *c in d: pass\nwith (open(a) as b, c as d.e): pass\n", "if 1:\n\tx = 1\n\n# c\n\ty = '\\N{BULLET}'\nelse:\n        z = 1 \\\n  + 2\n", "f(*a, b, *c, d=1, *e, **g)\nf(x for x in y)\ndef f(a, b=1, /, c=2, *, d, e=3, **k): pass\nlambda *, a: a\n"],
}
MORE_BAD = {
    "py": ["f() = 1\n", "x + 1 = 2\n", "for f() in x: pass\n", "del f()\n", "with a as 1: pass\n", "f(x for x in y, 1)\n", "f(**a, b)\n", "def f(a=1, b): pass\n", "def f(*): pass\n", "[*a for a in b]\n", "f'{}'\n", "f'{a'\n", "f'}'\n", "f'{a!x}'\n", 'f"""{a\n', "'\\x1'\n", "'\\N{no such}'\n", "b'é'\n", "'a' b'c'\n", "if 1:\n\tx\n        y\n", "print 'a'\n", "except A, e: pass\n", "x = 1 \\", "try: pass\nexcept A: pass\nexcept* B: pass\n", "a <> b\n", "x = 0777\n", "(a, b): int = 1\n", "a, b += 1\n"],
    "js": ["with (a) {}", "x = 010", "let a = <b/>"],
    "php": ["<?php $a{0};", "<?php (unset) $a;"],
}


@pytest.mark.parametrize(("ext", "dialect", "text"), OTHER)
def test_other_dialects(ext, dialect, text):
    got, why = sx.verdict(text, ext)
    assert got == dialect and why.startswith(sx.DIALECTS[ext][0])


@pytest.mark.parametrize(("ext", "text"), [(e, t) for e, ts in MORE_GOOD.items() for t in ts])
def test_more_valid(ext, text):
    assert sx.broken(text, ext) is None


@pytest.mark.parametrize(("ext", "text"), [(e, t) for e, ts in MORE_BAD.items() for t in ts])
def test_more_invalid(ext, text):
    assert sx.broken(text, ext) is not None
    if ext == "py":
        assert python_rejects(text)


def python_rejects(text):
    """The interpreter's own parser."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            compile(text, "f", "exec", ast.PyCF_ONLY_AST, dont_inherit=True)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return True
    return False


def test_the_standard_library_is_valid():
    for p in sorted(pathlib.Path(ast.__file__).parent.glob("[a-d]*.py"))[:40]:
        assert sx.recognisers().why_not(p.read_text("utf-8"), "python 3") is None, p.name


def test_python_recogniser_agrees_with_the_exact_check(spark, sf_dir):
    f = spark.read.parquet(f"{sf_dir}/code_files.parquet").filter("path like '%.py'").selectExpr("id as file_id")
    texts = [r.content for r in spark.read.parquet(f"{sf_dir}/file_contents.parquet").join(f, "file_id").collect() if r.content is not None]
    assert len(texts) > 10
    for t in texts:
        assert (sx.recognisers().why_not(t, "python 3") is not None) == python_rejects(t)


def test_table(spark):
    files = spark.createDataFrame([(1, 1, "a.py", "x"), (1, 1, "a.py", "x"), (2, 1, "b.js", None), (3, 2, "c.md", ""), (4, 2, None, "z"), (5, None, "d.ts", "q"), (6, 1, "e.php", "w")], "id long, repository_id long, path string, why string")
    contents = spark.createDataFrame([(1, "x ="), (1, "x ="), (2, ""), (3, "# x ="), (4, "x"), (5, "let a: = 1"), (6, None), (None, "x")], "file_id long, content string")
    got = {r.file_id: r.invalid for r in sx.flag(files, contents).collect()}
    assert got == {1: True, 2: False, 5: True}
    assert sum(r.files for r in sx.rates(sx.flag(files, contents)).collect()) == 3
    assert sx.flag(files.limit(0), contents).count() == 0 and sx.flag(files, contents.limit(0)).count() == 0
