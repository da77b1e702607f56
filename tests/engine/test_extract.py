import hashlib

import pytest

from codeloom.operators.extract import registry
from codeloom.operators.extract.lexer import Code

PYTHON = '''import os, sys as s
from json import dumps, loads as l
from . import x
class Base(object, abc.ABC):
    """Base doc."""
    @staticmethod
    def ping(self):
        return helper(1).go(a.b())  # not(a_call)
    async def _q(self): pass
def helper(n):
    "one 'quoted' doc"
    def __inner():
        return loads("def fake(): no()")
    return inner()
'''
GO = '''package main
import "fmt"
import (
	"os"
	m "math"
	. "x/y"
)
// two lines
// Animal doc
type Animal struct {
	Base
	*Other
	name string `json:"x"`
	pkg.T
}
type (
	// I doc
	I interface {
		Base
		Speak(a int) string
	}
	F func(int) error
	Al = int
)
// Speak doc
func (a *Animal) Speak() (string, error) {
	x := []byte("s")
	return helper(x), fmt.Println(a.name, "func ( {", `func no() {`, '{')
}
func Run[T any](f func(T) bool) error { helper(1); go a.b.C(d()) }
func (s Stack[T]) Push(v T) {}
/* func no() {} */
'''
RUST = '''use std::io;
pub use a::b::{c, d as e, self};
use x::*; use q as z;
extern crate serde;
/// Doc of S
pub struct S<T> { a: i32 }
#[derive(Debug)]
enum E { A(i32), B }
pub(crate) trait Tr { fn req(&self); fn dflt(&self) -> i32 { helper(1) } }
impl<T> Tr for S<T> {
    fn req(&self) { println!("x {}", foo(1)); self.a.go(); Self::new(2); std::mem::swap(a, b); }
}
impl S<i32> { pub async fn new(x: &'a str) -> Self { let Some(y) = opt(x) else { return }; match q() { Some(z) if chk(z) => act(z), Err(_) => {} } } }
impl fmt::Display for E { fn fmt(&self) {} }
fn main() { let c = '{'; let r = r#"fn no() {"#; /* nested /* fn no2() {} */ */ vec![a(1)].len(); x.iter()
    .map(|v| f(v)).collect::<Vec<_>>(); }
macro_rules! m { () => { fn hidden() {} } }
'''
JAVASCRIPT = '''import d, { a, b as c } from 'mod';
import * as ns from "ns"; import "side";
const fs = require('fs');
/** doc */
async function main({x}) { const y = /\\/{2}"/.test(x); return foo(`t ${bar(x)} {`); }
const add = (a, b) => a + b, sub = async x => { return inner(x) };
var old = y => old2(y)
export default class Widget extends Base.Other { constructor() { super(); this.x = new Map(); } _p() { this.go() } static async get(x) { return a?.b(x) } #z() {} f = () => k() }
class B extends Widget {}
const o = { m() { q() }, async n() {} };
if (x) { yy() }
function* gen() {}
// function no() {}
tag`x`;
'''
TYPESCRIPT = '''import type { T } from './t'; import E, { F } from "e";
/** d */
function priv(a: number): { x: number } { return g<T>(a) }
export function pub(): void { }
export default function defa() {}
declare function nope(x: string): void;
interface Shape<T> extends Base, Gen<T> { area(): number; }
type U<T> = | A<T>
  | { k: string };
export const f = async <T>(x: T): Promise<T> => { await h(x) };
export class C<T> extends D<T> implements I, J<T> {
  private x: number = mk();
  constructor(private a: string) { super(); }
  protected foo<T>(x: T): Map<string, T> { return this.x.y(x)! }
  overload(): void;
  get v(): number { return 1 }
  @Dec() async bar() { const q = <number>z(1); }
}
abstract class Abs { a() {} }
'''
CPP = '''#include <vector>
#include "my.h"
#define X(a) foo(a)
using namespace std; using std::string; using V = int;
namespace ns {
// doc
class Foo : public Base, private ns::Other, Tmpl<int> {
  int x_;
public:
  Foo() : x_(1), y{2} { init(); }
  virtual ~Foo() = default;
  void decl(int a) const;
  int inl() const { return obj->get(x_) + ns::f(1); }
protected:
  static std::vector<int> mk() { return make<int>(3); }
};
struct Pod { int a; };
enum class Color : int { Red, Green };
class Fwd;
template <typename T, class U> T* tmpl(T a) { int b(1); auto c = new Foo(2); return static_cast<T>(a); }
}
int ns::Foo::outer(int a) { if (a) { g(a); } const char* s = R"(fn( { )"; return 0; }
int proto(int);
int& ref() { return *p; }
'''


def found(language, source, compat=False):
    row = registry.extract_file("f", language, source.encode(), compat)
    assert row["error"] is None
    symbols = [(s["kind"], s["name"], s["start_line"], s["end_line"]) for s in row["symbols"]]
    imports = [(i["target"], i["alias"], i["items"], i["line"]) for i in row["imports"]]
    calls = [(c["callee_name"], c["line"]) for c in row["calls"]]
    inherits = [(i["child_name"], i["parent_name"]) for i in row["inherits"]]
    return row, symbols, imports, calls, inherits


def test_python():
    row, symbols, imports, calls, inherits = found("Python", PYTHON)
    assert symbols == [("Function", "ping", 7, 8), ("Function", "_q", 9, 9), ("Function", "helper", 10, 14), ("Function", "__inner", 12, 13), ("Class", "Base", 4, 9), ("Method", "ping", 7, 8), ("Method", "_q", 9, 9)]
    assert imports == [("os", None, [], 1), ("sys", "s", [], 1), ("json", None, ["dumps", "loads"], 2), (".", None, ["x"], 3)]
    assert calls == [("go", 8), ("helper", 8), ("b", 8), ("loads", 13), ("inner", 14)]
    assert inherits == [("Base", "object"), ("Base", "abc.ABC")]
    by = {(s["kind"], s["name"]): s for s in row["symbols"]}
    assert by["Class", "Base"]["docstring"] == "Base doc." and by["Function", "helper"]["docstring"] == "\"one 'quoted' doc\""
    assert [by["Function", n]["visibility"] for n in ("ping", "_q", "__inner")] == ["public", "protected", "private"]
    assert by["Function", "_q"]["is_async"] and by["Method", "ping"]["parent_id"] == "f:Base:4"
    assert by["Function", "helper"]["signature"] == "def helper(n)" and by["Class", "Base"]["signature"] == "class Base(object, abc.ABC)"
    assert row["line_count"] == 15


def test_python_compat():
    row, symbols, imports, calls, _ = found("Python", PYTHON, True)
    assert ("Method", "ping", 7, 8) not in symbols and ("Method", "_q", 9, 9) in symbols
    assert imports == [("os", "s", [], 1), ("json", None, ["dumps"], 2), ("x", None, [], 3)]
    assert ("a", 8) in calls and ("b", 8) not in calls and not any(s["is_async"] for s in row["symbols"])


def test_python_that_does_not_parse():
    source = PYTHON + "\ndef broken(:\n    print 'x'\n    call_me(1)\nclass After(Base):\n    def m(self): pass\n"
    _, symbols, imports, calls, inherits = found("Python", source)
    names = [s[:2] for s in symbols]
    assert ("Function", "broken") in names and ("Method", "m") in names and ("Class", "After") in names and ("Method", "ping") in names
    assert ("call_me", 18) in calls and ("After", "Base") in inherits and ("json", None, ["dumps", "loads"], 2) in imports
    assert not any(n[1] == "fake" for n in names)


def test_go():
    row, symbols, imports, calls, inherits = found("Go", GO)
    assert symbols == [("Function", "Run", 30, 30), ("Method", "Speak", 26, 29), ("Method", "Push", 31, 31), ("Struct", "Animal", 10, 15), ("Interface", "I", 18, 21), ("Interface", "F", 22, 22)]
    assert imports == [("fmt", None, [], 2), ("os", None, [], 4), ("math", "m", [], 5), ("x/y", ".", [], 6)]
    assert calls == [("helper", 28), ("Println", 28), ("helper", 30), ("C", 30), ("d", 30)]
    assert inherits == [("Animal", "Base"), ("Animal", "Other"), ("I", "Base")]
    by = {s["name"]: s for s in row["symbols"]}
    assert by["Speak"]["parent_name"] == "Animal" and by["Push"]["parent_name"] == "Stack" and by["Speak"]["docstring"] == "// Speak doc"
    assert by["Animal"]["signature"] == "Animal struct {" and by["I"]["docstring"] == "// I doc" and by["Animal"]["docstring"] is None
    assert by["Speak"]["signature"] == "func (a *Animal) Speak() (string, error)"
    assert by["Run"]["visibility"] == "public" and by["F"]["visibility"] == "public"
    row, _, imports, _, _ = found("Go", GO, True)
    assert imports[0] == ("os", None, [], 4) and all(s["parent_name"] is None for s in row["symbols"])


def test_rust():
    row, symbols, imports, calls, inherits = found("Rust", RUST)
    assert [s[:2] for s in symbols] == [("Function", n) for n in ("dflt", "req", "new", "fmt", "main")] + [("Struct", "S"), ("Enum", "E"), ("Trait", "Tr")] + [("Method", n) for n in ("req", "new", "fmt")]
    assert imports == [("std::io", None, [], 1), ("a::b", None, ["c", "d"], 2), ("x::*", None, [], 3), ("q", None, [], 3), ("serde", None, [], 4)]
    assert calls == [("helper", 9), ("go", 11), ("Self::new", 11), ("std::mem::swap", 11), ("opt", 13), ("q", 13), ("chk", 13), ("act", 13), ("len", 15), ("iter", 15), ("map", 15), ("f", 16)]
    assert inherits == [("S", "Tr"), ("E", "Display")]
    by = {(s["kind"], s["name"]): s for s in row["symbols"]}
    assert by["Struct", "S"]["docstring"] == "Doc of S" and by["Enum", "E"]["docstring"] is None
    assert by["Function", "new"]["is_async"] and by["Function", "new"]["visibility"] == "public" and by["Function", "new"]["signature"] == "pub async fn new(x: &'a str) -> Self"
    assert [by["Method", n]["parent_name"] for n in ("req", "new", "fmt")] == ["S", "S", "E"] and by["Trait", "Tr"]["visibility"] == "public"
    row, _, imports, _, inherits = found("Rust", RUST, True)
    assert imports[1] == ("use", None, [], 2) and inherits == [("S<T>", "Tr")]
    assert [s["parent_name"] for s in row["symbols"] if s["kind"] == "Method"] == ["Tr", "S<i32>", "E"]


def test_javascript():
    row, symbols, imports, calls, inherits = found("JavaScript", JAVASCRIPT)
    assert [s[:3] for s in symbols] == [("Function", "main", 5), ("Function", "add", 6), ("Function", "sub", 6), ("Function", "old", 7), ("Class", "Widget", 8), ("Method", "constructor", 8), ("Method", "_p", 8), ("Method", "get", 8), ("Class", "B", 9)]
    assert imports == [("mod", None, ["a", "b", "d"], 1), ("ns", None, [], 2), ("side", None, [], 2), ("fs", None, [], 3)]
    assert calls == [("test", 5), ("foo", 5), ("bar", 5), ("inner", 6), ("old2", 7), ("go", 8), ("b", 8), ("k", 8), ("q", 10), ("yy", 11), ("tag", 14)]
    assert inherits == [("B", "Widget")]
    by = {s["name"]: s for s in row["symbols"]}
    assert by["main"]["signature"] == "async function main(" and by["main"]["is_async"] and by["main"]["docstring"] == "/** doc */"
    assert by["sub"]["signature"] == "const sub = async x =>" and by["old"]["signature"] == "const old = y =>" and by["add"]["docstring"] is None
    assert by["_p"]["visibility"] == "private" and by["get"]["signature"] == "static async get(x)"


def test_typescript():
    row, symbols, imports, calls, inherits = found("TypeScript", TYPESCRIPT)
    assert symbols == [("Function", "priv", 3, 3), ("Function", "pub", 4, 4), ("Function", "defa", 5, 5), ("Function", "f", 10, 10), ("Class", "C", 11, 18), ("Method", "constructor", 13, 13), ("Method", "foo", 14, 14), ("Method", "v", 16, 16), ("Method", "bar", 17, 17), ("Interface", "Shape", 7, 7), ("Interface", "U", 8, 9)]
    assert imports == [("./t", None, ["T"], 1), ("e", None, ["F", "E"], 1)]
    assert calls == [("g", 3), ("h", 10), ("mk", 12), ("y", 14), ("Dec", 17), ("z", 17)]
    assert inherits == [("C", "D"), ("C", "I"), ("Shape", "Base")]
    by = {s["name"]: s for s in row["symbols"]}
    assert [by[n]["visibility"] for n in ("priv", "pub", "defa", "foo", "constructor", "v")] == ["private", "public", "private", "protected", "private", "public"]
    assert by["U"]["signature"] == "type U<T> = | A<T>\n  | { k: string };" and by["C"]["signature"] == "export class C<T> extends D<T> implements I, J<T>".removeprefix("export ")
    assert by["f"]["signature"] == "const f = async <T>(x: T): Promise<T> =>" and by["bar"]["is_async"]


def test_cpp():
    row, symbols, imports, calls, inherits = found("C++", CPP)
    assert [s[:2] for s in symbols] == [("Function", n) for n in ("Foo", "~Foo", "inl", "mk", "tmpl", "ns::Foo::outer", "ref")] + [("Class", "Foo")] + [("Method", n) for n in ("Foo", "~Foo", "decl", "inl", "mk")] + [("Class", "Fwd"), ("Struct", "Pod"), ("Enum", "Color")]
    assert imports == [("vector", None, [], 1), ("my.h", None, [], 2), ("namespace std", None, [], 4), ("std::string", None, [], 4)]
    assert calls == [("init", 10), ("get", 13), ("ns::f", 13), ("make", 15), ("static_cast", 20), ("g", 22)]
    assert inherits == [("Foo", "Base"), ("Foo", "ns::Other")]
    methods = {s["name"]: s for s in row["symbols"] if s["kind"] == "Method"}
    assert methods["decl"]["signature"] is None and methods["decl"]["visibility"] == "public" and methods["mk"]["visibility"] == "protected"
    assert methods["inl"]["parent_id"] == "f:Foo:7" and methods["inl"]["signature"] == "int inl() const"
    assert next(s for s in row["symbols"] if s["kind"] == "Class")["docstring"] == "// doc"
    _, symbols, *_ = found("C++", CPP, True)
    assert [s[1] for s in symbols if s[0] == "Method"] == ["Foo", "~Foo"]


@pytest.mark.parametrize("language", list(registry.EXTRACTORS))
def test_broken_files_never_fail(language):
    source = {"Python": PYTHON, "Go": GO, "Rust": RUST, "JavaScript": JAVASCRIPT, "TypeScript": TYPESCRIPT, "C++": CPP}[language]
    for text in ["", "\n", "(((", "}}}", '"', "`", "/*", "'", "import", "func", "class", "fn x", "const a =", "type", "enum", "use", "impl", "template<", "#include", "\x00", "é𝔘"]:
        assert registry.extract_file("p", language, text.encode())["error"] is None
    for cut in range(0, len(source), 7):
        for compat in (False, True):
            assert registry.extract_file("p", language, source[:cut].encode(), compat)["error"] is None
            assert registry.extract_file("p", language, source[cut:].encode(), compat)["error"] is None
    assert registry.extract_file("p", language, b"\xff\xfe\x80 x")["error"] is None


def test_deep_nesting_is_linear():
    code = Code("(" * 50_000 + ")" * 50_000, "go")
    assert code.close[0] == 99_999
    for language in ("Go", "Rust", "JavaScript", "TypeScript", "C++"):
        assert registry.extract_file("p", language, b"f(" * 3000)["error"] is None


def test_table_operator(spark):
    files = spark.createDataFrame([("a.py", "Python", bytearray(b"def f(): g()\n")), ("b.xx", "Cobol", bytearray(b"")), ("c.go", "Go", None)], "path string, language string, content binary")
    rows = {r.path: r for r in registry.extract(files).collect()}
    assert rows["a.py"].symbols[0].id == "a.py:f:1" and rows["a.py"].calls[0].callee_name == "g" and rows["a.py"].error is None
    assert rows["b.xx"].error.startswith("Unknown language") and rows["c.go"].error == "unreadable"
    assert rows["a.py"].content_hash == hashlib.sha256(b"def f(): g()\n").hexdigest()
