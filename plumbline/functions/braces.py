"""Definitions, calls, bases, reads and writes of JavaScript, Java and C, by a lexer and a descent through scopes.

The lexer knows comments, strings, regular expressions, template literals with code inside, and preprocessor lines.
The descent follows brackets: a class or function is a head and a body, within which it descends again; everything
else is names, which are called, read or written by what stands beside them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

LANGUAGES = ("js", "java", "c")
# Words that are no names.
_SHARED = "break case const continue default do else enum for goto if return static switch volatile while sizeof"
_OBJECTS = "abstract assert async await boolean byte catch class debugger delete export extends final finally function get implements import in instanceof interface let native new null of package private protected public set strictfp super synchronized this throw throws transient true false try typeof undefined var void with yield"
KEYWORDS = {
    "js": set(f"{_SHARED} {_OBJECTS}".split()) - set("abstract boolean byte final native of get set async package private protected public strictfp synchronized throws transient sizeof goto volatile assert interface".split()),
    "java": set(f"{_SHARED} {_OBJECTS} char double float int long short".split()) - set("async await debugger delete export function get in let of set sizeof typeof undefined var with yield".split()),
    "c": set(f"{_SHARED} auto char double extern float inline int long register restrict short signed struct typedef union unsigned void".split()),
}
TYPES = {"class", "interface", "enum", "record"}
ASSIGN = {"=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "**=", "&&=", "||=", "??=", "<<="}
MEMBER = {"js": {".", "?."}, "java": {".", "::"}, "c": {".", "->"}}
_PAIRS = {"(": ")", "[": "]", "{": "}"}
#: Words after which a slash begins a regular expression.
_BEFORE_VALUE = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "await", "yield"}

_TOKEN = re.compile(
    r"""(?P<space>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<name>[^\W\d][\w$]*|\$[\w$]*|\#[^\W\d]\w*)|(?P<number>\.?\d(?:[eEpP][+-]|[\w.])*)
    |(?P<block>\"\"\".*?(?:\"\"\"|\Z))|(?P<string>"(?:[^"\\\n]|\\.)*"?|'(?:[^'\\\n]|\\.)*'?)|(?P<template>`)
    |(?P<op>\.\.\.|===|!==|\*\*=|&&=|\|\|=|\?\?=|<<=|=>|\?\.(?!\d)|->|::|==|!=|<=|>=|&&|\|\||\?\?|\+\+|--|[-+*/%&|^]=|<<|.)""",
    re.S | re.X,
)
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/\w*")
_DIRECTIVE = re.compile(r"[ \t]*#(?:[^\n\\]|\\.)*", re.S)
_PIECE = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*", re.S)


class Token(NamedTuple):
    kind: str
    text: str
    start: int
    end: int


def tokens_of(text: str, language: str, at: int = 0, closing: str | None = None) -> tuple[list[Token], int]:
    """Tokens of a text from a place on, to its end or to the brace that closes a template's code, and where that is."""
    out: list[Token] = []
    depth, line_start = 0, True
    while at < len(text):
        if language == "c" and line_start and (m := _DIRECTIVE.match(text, at)):
            at = m.end()
            continue
        line_start = False
        if text[at] == "/" and language == "js" and text[at + 1 : at + 2] not in ("/", "*") and _value_may_begin(out) and (m := _REGEX.match(text, at)):
            out.append(Token("string", m[0], at, m.end()))
            at = m.end()
            continue
        m = _TOKEN.match(text, at)
        kind, found = m.lastgroup, m[0]
        at = m.end()
        if kind == "space":
            line_start = "\n" in found
        elif kind == "template" and language == "js":
            start = m.start()
            while True:
                at = _PIECE.match(text, at).end()
                if text.startswith("${", at):
                    inner, at = tokens_of(text, language, at + 2, "}")
                    out += [Token("op", "(", at, at), *inner, Token("op", ")", at, at)]
                else:
                    at = min(at + 1, len(text))
                    break
            out.append(Token("string", "``", start, at))
        else:
            if closing and found in "{}" and kind == "op":
                depth += 1 if found == "{" else -1
                if depth < 0:
                    return out, at
            out.append(Token("string" if kind in ("block", "template") else kind, found, m.start(), at))
    return out, at


def _value_may_begin(before: list[Token]) -> bool:
    last = before[-1] if before else None
    return last is None or last.kind == "op" and last.text not in (")", "]", "}") or last.text in _BEFORE_VALUE


class Reader:
    """Tags of one text."""

    def __init__(self, text: str, language: str):
        self.text, self.language, self.keywords, self.member = text, language, KEYWORDS[language], MEMBER[language]
        self.tokens = tokens_of(text, language)[0]
        if language == "java":
            self._drop_type_arguments()
        self.tags: list[dict] = []
        self.functions: list[str] = []
        self._breaks = [m.start() for m in re.finditer("\n", text)]
        self.match: dict[int, int] = {}
        open_: list[int] = []
        for i, t in enumerate(self.tokens):
            if t.kind == "op" and t.text in _PAIRS:
                open_.append(i)
            elif t.kind == "op" and t.text in (")", "]", "}"):
                while open_:
                    k = open_.pop()
                    self.match[k], self.match[i] = i, k
                    if _PAIRS[self.tokens[k].text] == t.text:
                        break
        for k in open_:  # what nothing closes reaches to the end
            self.match[k] = len(self.tokens)

    def _drop_type_arguments(self) -> None:
        """Leave out what stands between a dot and the method that it calls: `Other.<R>make()`."""
        kept, i = [], 0
        while i < len(self.tokens):
            kept.append(self.tokens[i])
            i = (self.after_generics(i + 1) or i + 1) if self.at(i) == "." and self.at(i + 1) == "<" else i + 1
        self.tokens = kept

    # ---- small questions

    def at(self, i: int) -> str:
        return self.tokens[i].text if 0 <= i < len(self.tokens) and self.tokens[i].kind != "string" else ""

    def is_name(self, i: int) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i].kind == "name" and self.tokens[i].text not in self.keywords

    def line(self, offset: int) -> int:
        low, high = 0, len(self._breaks)
        while low < high:
            middle = (low + high) // 2
            low, high = (middle + 1, high) if self._breaks[middle] < offset else (low, middle)
        return low + 1

    def span(self, first: int, last: int) -> dict:
        """Lines from one token to another."""
        last = min(last, len(self.tokens) - 1)
        return {"first": self.line(self.tokens[first].start), "last": self.line(self.tokens[last].end - 1)}

    def add(self, kind: str, category: str, name: str, first: int, last: int, **more) -> None:
        self.tags.append({"kind": kind, "category": category, "name": name, **self.span(first, last), **more})

    def use(self, kind: str, category: str, name: str, first: int, last: int, **more) -> None:
        """A tag for each function around a place."""
        for owner in dict.fromkeys(self.functions):
            self.add(kind, category, name, first, last, owner=owner, **more)

    def after_generics(self, i: int) -> int | None:
        """The place after a list of type arguments that begins at i, if it is one."""
        depth, k = 0, i
        while k < len(self.tokens):
            t = self.at(k)
            if t == "<":
                depth += 1
            elif t == ">":
                depth -= 1
                if not depth:
                    return k + 1
            elif not (self.tokens[k].kind == "name" or t in (",", "?", ".", "&", "[", "]")):
                return None
            k += 1
        return None

    # ---- the descent

    def read(self) -> list[dict]:
        self.walk(0, len(self.tokens), None)
        return self.tags

    def walk(self, i: int, end: int, owner: str | None) -> None:
        """Tokens i to end of a body; owner is the class whose body it is, directly."""
        statement = i
        while i < end:
            done = self.class_at(i, statement) or self.function_at(i, statement, owner) or self.lambda_at(i, owner)
            if done is None:
                if self.at(i) == "{":  # a block or an object, which is no class's own
                    done = min(self.match[i], end)
                    self.walk(i + 1, done, "" if self.is_anonymous(i) else None)
                    done += 1
                else:
                    done = self.leaf(i)
            closed = self.at(done - 1) in (";", "{", "}") or self.at(done) == "}"
            i = done
            if closed:
                statement = i

    def is_anonymous(self, i: int) -> bool:
        """Whether the brace at i opens the body of a class without a name: `new Base(…) {`."""
        if self.language != "java" or self.at(i - 1) != ")" or i - 1 not in self.match:
            return False
        k = self.match[i - 1] - 1
        while k > 0 and (self.is_name(k) or self.at(k) in (".", ",", "?", "<", ">", "[", "]")):
            k -= 1
        return self.at(k) == "new"

    def class_at(self, i: int, statement: int) -> int | None:
        word = self.at(i)
        if self.language == "c" or word not in TYPES or self.at(i - 1) in self.member or word != "class" and (self.language == "js" or not self.is_name(i + 1)):
            return None
        if word == "record" and self.at(i + 2) not in ("(", "<"):
            return None
        name = self.at(i + 1) if self.is_name(i + 1) else None
        if name is None and self.at(i + 1) not in ("{", "extends"):
            return None
        k, bases, extending = i + (2 if name else 1), [], False
        while k < len(self.tokens) and self.at(k) != "{":
            if self.at(k) == ";":
                return None
            if self.at(k) == "<":
                k = self.after_generics(k) or k + 1
                continue
            if self.at(k) in ("(", "["):
                self.walk(k + 1, self.match[k], None)
                k = self.match[k] + 1
                extending = False
                continue
            if self.tokens[k].kind == "name" and self.at(k) in ("extends", "implements", "permits"):
                extending = self.at(k) == "extends"
            elif extending and self.is_name(k) and self.at(k + 1) not in (".", "("):
                bases.append(self.at(k))
            k += 1
        if k >= len(self.tokens):
            return None
        name = name or self.given_name(i)
        if name:
            self.add("def", "class", name, statement if self.language == "java" else i, self.match[k], owner=None)
            for base in bases:
                self.add("inherits", "class_inheritance", base, i, self.match[k], owner=name)
        self.walk(k + 1, self.match[k], name or "")
        return self.match[k] + 1

    def given_name(self, i: int) -> str | None:
        """The name that a function or class without one is assigned to: `name = …` or `name: …`."""
        return self.at(i - 2) if self.at(i - 1) in ("=", ":") and self.is_name(i - 2) else None

    def function_at(self, i: int, statement: int, owner: str | None) -> int | None:
        """A function whose head begins at i, with a body in braces or, in a Java class, without one."""
        name_at, open_, first = i, i + 1, statement
        if self.language == "js" and self.at(i) == "function":
            name_at, open_ = i + 1, i + 2
            if self.at(name_at) == "*":
                name_at, open_ = name_at + 1, open_ + 1
            if self.at(name_at) == "(":
                name_at, open_ = None, name_at
            first = i - 1 if self.at(i - 1) == "async" else i
        elif self.tokens[i].kind not in ("name", "string") or self.tokens[i].text in self.keywords or self.at(i - 1) in self.member or self.at(i - 1) in ("new", "@"):
            return None
        elif self.language == "java" and owner is None or self.language == "c" and self.functions:
            return None
        elif self.tokens[i].kind == "string" and self.language != "js":
            return None
        if self.at(open_) != "(" or self.match[open_] >= len(self.tokens):
            return None
        body = self.match[open_] + 1
        if self.language == "java":
            if self.at(body) == "throws":
                while body < len(self.tokens) and self.at(body) not in ("{", ";"):
                    body += 1
            if self.at(body) == ";" and (self.is_name(i - 1) or self.at(i - 1) in (">", "]") or self.tokens[i - 1].text in self.keywords) and self.at(i - 1) not in ("=", "return"):
                self.add("def", "function", self.at(i), statement, body, owner=owner)
                self.functions.append(self.at(i))
                self.walk(open_ + 1, self.match[open_], None)
                self.functions.pop()
                return body + 1
        if self.at(body) != "{":
            return None
        if name_at is None:
            name = self.given_name(first)
        else:
            name = self.tokens[name_at].text.strip("'\"") if self.tokens[name_at].kind == "string" else self.at(name_at)
        if self.language == "js" and self.at(i) != "function":
            first = i
            while self.at(first - 1) in ("async", "static", "get", "set", "*"):
                first -= 1
        end = self.match[body]
        self.function(name, first, end, owner, [(open_ + 1, self.match[open_]), (body + 1, end)])
        return end + 1

    def lambda_at(self, i: int, owner: str | None) -> int | None:
        """An arrow function or lambda: a definition if it has a name (JavaScript), else a part of what is around it."""
        arrow = {"js": "=>", "java": "->"}.get(self.language)
        if arrow is None:
            return None
        if self.at(i) == "(" and self.match[i] < len(self.tokens):
            at, params = self.match[i] + 1, (i + 1, self.match[i])
        elif self.is_name(i) and self.at(i - 1) not in self.member:
            at, params = i + 1, (i, i)  # a name alone, which the body reads if it matters
        else:
            return None
        if self.at(at) != arrow:
            return None
        if self.at(at + 1) == "{":
            start, end = at + 2, self.match[at + 1]
            done = end + 1
        else:
            start = end = at + 1
            while end < len(self.tokens) and self.at(end) not in (",", ";", ")", "]", "}"):
                if self.at(end) in _PAIRS:
                    end = self.match[end]
                elif self.line(self.tokens[end].start) > self.line(self.tokens[end - 1].end - 1) and end > start and self.tokens[end].kind != "op" and self.tokens[end - 1].kind != "op":
                    break  # a new statement on a new line
                end += 1
            done = end
        first = i - 1 if self.at(i - 1) == "async" else i
        name = self.given_name(first) if self.language == "js" else None
        self.function(name, first - 2 if name else first, max(done - 1, first), owner, [params, (start, end)])
        return done

    def function(self, name: str | None, first: int, last: int, owner: str | None, ranges: list[tuple[int, int]]) -> None:
        if name:
            self.add("def", "function", name, first, last, owner=owner or None)
            self.functions.append(name)
        for a, b in ranges:
            self.walk(a, b, None)
        if name:
            self.functions.pop()

    # ---- names

    def leaf(self, i: int) -> int:
        """One token that begins nothing: a name is called, read or written."""
        t = self.tokens[i]
        if self.at(i) == "@" and self.language == "java":  # an annotation: only its arguments say something
            k = i + 2
            while self.at(k) == ".":
                k += 2
            return k
        if t.kind != "name":
            return i + 1
        if self.at(i - 1) in self.member:
            if self.at(i + 1) == "(" and t.text not in self.keywords:
                self.call(i)
            return i + 1
        special = t.text in ("this", "super") and self.at(i + 1) in self.member
        if not self.is_name(i) and not special or self.is_key(i):
            return i + 1
        if (after := self.type_end(i)) is not None:
            return after
        last = i
        while self.at(last + 1) in self.member and last + 2 < len(self.tokens) and self.tokens[last + 2].kind == "name":
            last += 2
        called = self.at(last + 1) == "("
        if called and last == i and self.at(i - 1) != "new":
            self.call(i)
        kind = "write" if self.at(last + 1) in ASSIGN | {"++", "--"} or self.at(i - 1) in ("++", "--") else "read"
        if not special:
            self.use(kind if last == i else "read", "var_dependency", t.text, i, i)
        shown = last - 2 if called else last
        if shown > i:
            self.use(kind, "var_dependency", "".join(self.tokens[k].text for k in range(i, shown + 1)), i, shown)
        return i + 1

    def is_key(self, i: int) -> bool:
        """Whether a name is a key of an object or a label."""
        return self.at(i + 1) == ":" and self.at(i - 1) in ("{", ",", ";", "}", "") and not (self.at(i - 1) == "," and "?" in (self.at(k) for k in range(max(0, i - 12), i)))

    def type_end(self, i: int) -> int | None:
        """The place after a type name that begins at i, if it is one."""
        if self.language == "js":
            return None
        before = self.at(i - 1)
        if before in ("new", "extends", "implements", "throws", "instanceof", "struct", "union", "enum", "goto"):
            k = i + 1
            while self.at(k) == ".":
                k += 2
            return (self.after_generics(k) or k) if self.at(k) == "<" else k
        k = i + 1
        while self.language == "java" and self.at(k) == "." and self.is_name(k + 1):
            k += 2
        if self.language == "java" and self.at(k) == "<":
            k = self.after_generics(k) or k
        while self.at(k) == "[" and self.at(k + 1) == "]":
            k += 2
        if self.language == "java" and self.at(k) == "..." or self.is_name(k) and (k > i + 1 or self.at(k) != ""):
            return k
        if self.language == "c" and self.at(k) == "*" and before in ("", ";", "{", "}", "(", ",", "const", "static", "extern"):
            while self.at(k) in ("*", "const"):
                k += 1
            if self.is_name(k) and self.at(k + 1) in ("=", ";", ",", ")", "["):
                return k
        return None

    def call(self, i: int) -> None:
        """A call of the name at i; the receiver is the source of what stands before the dot."""
        receiver = None
        if self.at(i - 1) in self.member:
            start = self.receiver_start(i - 2)
            receiver = self.text[self.tokens[start].start : self.tokens[i - 2].end]
        self.use("call", "function_call", self.at(i), i, min(self.match[i + 1], len(self.tokens) - 1), receiver=receiver)

    def receiver_start(self, i: int) -> int:
        """The first token of the expression that ends at i."""
        while True:
            if self.at(i) in (")", "]") and i in self.match:
                i = self.match[i]
                if self.tokens[i - 1].kind == "name" and i or self.at(i - 1) in (")", "]"):
                    i -= 1
                    continue
            if self.at(i - 1) in self.member and i >= 2:
                i -= 2
                continue
            return i - 1 if self.at(i - 1) == "new" else i


_IMPORTS = {"js": re.compile(r"^[ \t]*import\s[^\n;]*", re.M), "java": re.compile(r"^[ \t]*import\s[^\n;]*;?", re.M), "c": re.compile(r"^[ \t]*#[ \t]*include[ \t][^\n]*", re.M)}
IMPORTED = re.compile(r"(?:from\s+([\w.]+)\s+import)|(?:import\s+([\w.]+))")
INCLUDED = re.compile(r'#\s*include\s+"([^"]+)"')


def imports(text: str, language: str) -> Iterator[dict]:
    """A tag for each import, named by its statement."""
    for m in _IMPORTS[language].finditer(text):
        statement = m[0].strip()
        found = INCLUDED.search(statement) or IMPORTED.match(statement)
        module = next((g for g in found.groups() if g), None) if found else None
        first = text.count("\n", 0, m.start()) + 1
        yield {"kind": "import", "category": "import", "name": statement, "module": module, "first": first, "last": first + m[0].count("\n")}


def brace_tags(text: str, language: str) -> list[dict]:
    """Tags of a language with braces: definitions (a class's functions with it as owner), bases, calls, reads and
    writes (owner: each function around them), imports.  A function or class without a name has that which it is
    assigned to, or none and no tag; text that does not parse gives what can be read of it."""
    try:
        tags = Reader(text, language).read()
    except RecursionError:
        tags = []
    return [*tags, *imports(text, language)]
