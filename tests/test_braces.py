"""Definitions, calls, bases, reads and writes of JavaScript, Java and C."""

import pytest

from plumbline.functions.braces import LANGUAGES, brace_tags

JS = '''import util from './b'
// class Not {}
export default class Shape extends Base {
  #side = 1;
  static make = (x) => new Shape(x);
  constructor(x) { super(x); this.area = x; }
  get area2() { return this.compute(`a ${helper(x)} b`); }
  async *gen(a, {b}) { yield a.b.c(1).d(2); }
}
const add = async (a, b) => {
  let s = a + b; s += 1;
  return list.map(v => twice(v));
};
function outer(x) {
  function inner(y) { return y / 2 / x; }
  const re = /class X {/g;
  return inner(x);
}
const obj = { run() { go(); }, key: function () { stop(); }, fn: z => z + 1 };
'''
JAVA = '''package a.b;
import a.b.C;
/* class Nope {} */
@Entity(name = "x")
public abstract class Foo<T extends Bar> extends Base<T> implements I {
  private final Map<String, List<Integer>> m = new HashMap<>();
  @Override
  public <R> List<R> get(int x, String... names) throws IOException, E {
    int y = x + size;
    this.count = y;
    names.stream().map(n -> trim(n)).toList();
    return Other.<R>make(y, "}{");
  }
  abstract int area(double r);
  Foo(int a) { super(a); init(a); }
  interface Inner { void go(); }
  static class Nested { void run() { new Thread() { public void start() { tick(); } }; } }
}
'''
C = '''#include "tool.h"
#define MAX(a, b) ((a) > (b) ? foo(a) : (b))
static int *find(struct node *n, int key) {
  node_t *p = n->next;
  int i;
  for (i = 0; i < key; i++) { p->count = step(p, i); total += i; }
  return (int *) p;
}
int main(void)
{
  return find(0, 1) ? 1 : 0; /* } */
}
'''


def defs(text, language):
    return [(t["category"], t["name"], t["first"], t["last"], t["owner"]) for t in brace_tags(text, language) if t["kind"] == "def"]


def calls(text, language):
    return {(t["owner"], t["receiver"], t["name"], t["first"]) for t in brace_tags(text, language) if t["kind"] == "call"}


def uses(text, language, kind, owner):
    return {t["name"] for t in brace_tags(text, language) if t["kind"] == kind and t["owner"] == owner}


def test_javascript():
    assert defs(JS, "js") == [
        ("class", "Shape", 3, 9, None), ("function", "make", 5, 5, "Shape"), ("function", "constructor", 6, 6, "Shape"), ("function", "area2", 7, 7, "Shape"), ("function", "gen", 8, 8, "Shape"),
        ("function", "add", 10, 13, None), ("function", "outer", 14, 18, None), ("function", "inner", 15, 15, None), ("function", "run", 19, 19, None), ("function", "key", 19, 19, None), ("function", "fn", 19, 19, None),
    ]
    assert calls(JS, "js") == {
        ("area2", "this", "compute", 7), ("area2", None, "helper", 7), ("gen", "a.b", "c", 8), ("gen", "a.b.c(1)", "d", 8), ("add", "list", "map", 12), ("add", None, "twice", 12),
        ("outer", None, "inner", 17), ("run", None, "go", 19), ("key", None, "stop", 19),
    }
    assert [(t["owner"], t["name"]) for t in brace_tags(JS, "js") if t["kind"] == "inherits"] == [("Shape", "Base")]
    assert uses(JS, "js", "write", "constructor") == {"this.area"} and uses(JS, "js", "write", "add") == {"s"}
    assert uses(JS, "js", "read", "inner") == {"x", "y"} and uses(JS, "js", "write", "outer") == {"re"}


def test_java():
    assert defs(JAVA, "java") == [
        ("class", "Foo", 4, 18, None), ("function", "get", 7, 13, "Foo"), ("function", "area", 14, 14, "Foo"), ("function", "Foo", 15, 15, "Foo"),
        ("class", "Inner", 16, 16, None), ("function", "go", 16, 16, "Inner"), ("class", "Nested", 17, 17, None), ("function", "run", 17, 17, "Nested"), ("function", "start", 17, 17, None),
    ]
    assert calls(JAVA, "java") == {
        ("get", "names", "stream", 11), ("get", "names.stream()", "map", 11), ("get", None, "trim", 11), ("get", "names.stream().map(n -> trim(n))", "toList", 11), ("get", "Other", "make", 12),
        ("Foo", None, "init", 15), ("run", None, "tick", 17), ("start", None, "tick", 17),
    }
    assert [(t["owner"], t["name"]) for t in brace_tags(JAVA, "java") if t["kind"] == "inherits"] == [("Foo", "Base")]
    assert uses(JAVA, "java", "write", "get") == {"y", "this.count"} and {"x", "size", "names", "n"} <= uses(JAVA, "java", "read", "get")
    assert not {"List", "Map", "IOException", "String"} & uses(JAVA, "java", "read", "get")


def test_c():
    assert defs(C, "c") == [("function", "find", 3, 8, None), ("function", "main", 9, 12, None)]
    assert calls(C, "c") == {("find", None, "step", 6), ("main", None, "find", 11)}
    assert uses(C, "c", "write", "find") == {"p", "i", "p->count", "total"} and {"n", "n->next", "key"} <= uses(C, "c", "read", "find")
    assert not {"node", "node_t", "MAX"} & uses(C, "c", "read", "find")


@pytest.mark.parametrize("language", LANGUAGES)
@pytest.mark.parametrize("text", ["", "}", "{", "((((", "a ? b : c", "/* open", "'open", "`a ${b", "class", "class A", "function", "x =>", "=> {", "new", "a.b.", "@", "f(", "int f(", "#include", "é = ü(ß)", "x" * 3000, "{" * 3000 + "f()", "f(" * 400 + ")" * 400])
def test_broken_text_gives_what_can_be_read(text, language):
    for tag in brace_tags(text, language):
        assert 1 <= tag["first"] <= tag["last"]


def test_strings_comments_and_expressions_hide_nothing_and_give_nothing():
    text = "function f() {\n  // g()\n  const a = 'h()', b = \"i()\" + /j()\\/k(/.test(x); return `${m(`${n(1)}`)} o()`;\n}\n"
    assert {c[2] for c in calls(text, "js")} == {"test", "m", "n"}
    assert {c[2] for c in calls('class A { void f() { String s = """\n g() { " }\n"""; h(); } }', "java")} == {"h"}
    assert {c[2] for c in calls("#define M(x) \\\n  g(x)\nint f(void) { return h('{', \"}\"); }\n", "c")} == {"h"}
