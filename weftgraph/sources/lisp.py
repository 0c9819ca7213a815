"""Observations of Clojure and Janet source files: a reader with positions, and what a file defines, requires and uses.

The reader is run file by file inside Spark (``observe``); everything after it is joins.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame

OPEN = {"(": ")", "[": "]", "{": "}"}
KINDS = {"(": "list", "[": "vector", "{": "map"}
DELIMITERS = set("()[]{}\"; \t\r\n,")

# Forms that define a var, and what they make of it.
DEFINERS = {
    "def": "variable", "defonce": "variable", "defn": "function", "defn-": "function", "defmacro": "macro", "defmulti": "multimethod", "defprotocol": "protocol",
    "defrecord": "record", "deftype": "type", "deftest": "test", "declare": "declare", "definterface": "type", "var": "variable", "varfn": "function",
    "def-": "variable", "var-": "variable", "defmacro-": "macro",
}
BINDERS = {"let", "loop", "for", "doseq", "binding", "when-let", "if-let", "when-some", "if-some", "with-open", "dotimes", "let*", "loop*", "each", "eachp", "with-redefs"}
FUNCTIONS = {"fn", "fn*", "defn", "defn-", "defmacro", "defmacro-", "varfn"}
TOPIC_NAMESPACE = "re-frame.core"
TOPIC_CALLS = {"reg-event-db", "reg-event-fx", "reg-event-ctx", "reg-sub", "reg-fx", "reg-cofx", "dispatch", "dispatch-sync", "subscribe"}
HEAD_OF_VECTOR = TOPIC_CALLS - {"reg-fx", "reg-cofx"}  # where a vector's first item is the key
STATE_READS, STATE_WRITES = {"get", "get-in"}, {"assoc", "assoc-in", "update", "update-in", "dissoc"}
ATOM_CALLS = {"swap!", "deref", "reset!"}
CORE = {"clojure.core", "cljs.core"}
IMPLEMENTERS = {"defrecord", "deftype", "extend-type", "extend-protocol", "reify"}
SPECIAL = {"if", "do", "quote", "recur", "throw", "try", "catch", "finally", "new", "set!", "var", "&", ".", "nil", "true", "false", "break", "while"}


@dataclass
class Node:
    kind: str
    text: str
    start: int
    end: int
    children: list[Node] = field(default_factory=list)


class Malformed(ValueError):
    def __init__(self, message: str, at: int):
        super().__init__(f"{message} at {at}")
        self.at = at


class Reader:
    def __init__(self, text: str, platform: str = "clj"):
        self.s, self.i, self.platform, self.janet = text, 0, platform, platform == "janet"

    def forms(self) -> list[Node]:
        out = []
        while (n := self._next(None)) is not None:
            out.append(n)
        return out

    def _blank(self) -> None:
        s, comment = self.s, "#" if self.janet else ";"
        while self.i < len(s):
            c = s[self.i]
            if c in " \t\r\n," and not (self.janet and c == ",") or c in "\f\v":
                self.i += 1
            elif c == comment or (c == "#" and s.startswith("#!", self.i) and self.i == 0):
                end = s.find("\n", self.i)
                self.i = len(s) if end < 0 else end
            else:
                return

    def _next(self, closing: str | None) -> Node | None:
        """The next form; None at the end or at the closing delimiter, which stays."""
        while True:
            self._blank()
            s, at = self.s, self.i
            if at >= len(s):
                if closing:
                    raise Malformed(f"no {closing}", at)
                return None
            c = s[at]
            if c in ")]}":
                if c != closing:
                    raise Malformed(f"unexpected {c}", at)
                return None
            if c in OPEN:
                return self._group(KINDS[c], OPEN[c], 1)
            if c == '"':
                return self._string(1)
            if self.janet and c == "`":
                return self._long_string()
            if self.janet and c == "@" and at + 1 < len(s) and s[at + 1] in "([{\"`":
                self.i += 1
                n = self._next(closing)
                n.start = at
                return n
            if c == "\\" and not self.janet:
                self.i += 2
                while self.i < len(s) and s[self.i] not in DELIMITERS:
                    self.i += 1
                return Node("char", s[at : self.i], at, self.i)
            prefix = next((p for p in ("~@", "#'", "'", "`", "~", "@", "#=", ",", ";", "|") if s.startswith(p, at) and (self.janet if p in ",;|" else not self.janet or p in "'~")), None)
            if prefix:
                self.i += len(prefix)
                return self._wrapped("quote" if prefix in ("'", "`") else "unquote" if prefix in ("~", "~@", ",") else "deref", at, closing)
            if c == "^" and not self.janet:
                self.i += 1
                meta = self._need(closing)
                n = self._need(closing)
                n.start = at
                n.children = n.children if n.kind != "symbol" else [Node("meta", meta.text, meta.start, meta.end, meta.children)]
                return n
            if c == "#" and not self.janet:
                n = self._dispatch(closing)
                if n is None:
                    continue
                return n
            return self._atom()

    def _need(self, closing: str | None) -> Node:
        n = self._next(closing)
        if n is None:
            raise Malformed("a form is missing", self.i)
        return n

    def _wrapped(self, kind: str, at: int, closing: str | None) -> Node:
        n = self._need(closing)
        return Node(kind, "", at, self.i, [n])

    def _group(self, kind: str, closing: str, width: int) -> Node:
        at = self.i
        self.i += width
        children = []
        while (n := self._next(closing)) is not None:
            children += n.children if n.kind == "splice" else [n]
        self.i += 1
        return Node(kind, "", at, self.i, children)

    def _string(self, width: int) -> Node:
        at = self.i
        self.i += width
        while self.i < len(self.s) and self.s[self.i] != '"':
            self.i += 2 if self.s[self.i] == "\\" else 1
        if self.i >= len(self.s):
            raise Malformed("a string has no end", at)
        self.i += 1
        return Node("string", self.s[at + width : self.i - 1], at, self.i)

    def _long_string(self) -> Node:
        at = self.i
        while self.i < len(self.s) and self.s[self.i] == "`":
            self.i += 1
        ticks = self.s[at : self.i]
        end = self.s.find(ticks, self.i)
        if end < 0:
            raise Malformed("a string has no end", at)
        self.i = end + len(ticks)
        return Node("string", self.s[at + len(ticks) : end], at, self.i)

    def _dispatch(self, closing: str | None) -> Node | None:
        s, at = self.s, self.i
        nxt = s[at + 1 : at + 2]
        if nxt == "_":
            self.i += 2
            self._need(closing)
            return None
        if nxt == "{":
            return self._group("set", "}", 2)
        if nxt == "(":
            return self._group("list", ")", 2)
        if nxt == '"':
            return self._string(2)
        if nxt == "?":
            splice = s.startswith("#?@", at)
            self.i += 3 if splice else 2
            choices = self._need(closing).children
            for key, value in zip(choices[::2], choices[1::2], strict=False):
                if key.text in (f":{self.platform}", ":default"):
                    return Node("splice", "", at, self.i, value.children) if splice else value
            return None
        if nxt == ":":
            self.i += 2
            self._atom()
            return self._need(closing)
        self.i += 1
        tag = self._need(closing)  # a tagged literal
        n = self._need(closing)
        n.start = tag.start
        return n

    def _atom(self) -> Node:
        at = self.i
        stop = DELIMITERS - {";"} if self.janet else DELIMITERS
        while self.i < len(self.s) and self.s[self.i] not in stop:
            self.i += 1
        if self.i == at:
            raise Malformed("unreadable", at)
        text = self.s[at : self.i]
        kind = "keyword" if text[0] == ":" else "number" if text[0].isdigit() or (text[0] in "+-" and text[1:2].isdigit()) else "symbol"
        return Node(kind, text, at, self.i)


SCHEMA = "path string, platform string, kind string, ns string, name string, target_ns string, target string, detail string, start_line long, start_column long, end_line long, end_column long, start_byte long, end_byte long"


class Observer:
    """What one file on one platform defines, requires and uses."""

    def __init__(self, path: str, text: str, platform: str):
        self.path, self.text, self.platform = path, text, platform
        self.ns = path.rsplit(".", 1)[0] if platform == "janet" else "user"
        self.alias: dict[str, str] = {}
        self.refers: dict[str, str] = {}
        self.rows: list[tuple] = []
        self.starts = [0, *[i + 1 for i, c in enumerate(text) if c == "\n"]]
        self.bytes = None if text.isascii() else list(accumulate((len(c.encode()) for c in text), initial=0))
        self.owner: str | None = None
        self.imports: dict[str, str] = {}
        self.atoms: set[str] = set()
        self.handlers: list[tuple[int, int, str]] = []  # where a handler's first parameter is the state
        self.pending: list[tuple[Node, Node | None, tuple]] = []  # accesses whose root is known when the file is read

    def _place(self, n: Node) -> tuple:
        a, b = bisect_right(self.starts, n.start) - 1, bisect_right(self.starts, n.end) - 1
        first, last = (n.start, n.end) if self.bytes is None else (self.bytes[n.start], self.bytes[n.end])
        return a + 1, n.start - self.starts[a] + 1, b + 1, n.end - self.starts[b] + 1, first, last

    def _row(self, kind: str, n: Node, name: str | None = None, target_ns: str | None = None, target: str | None = None, detail: str | None = None) -> None:
        self.rows.append((self.path, self.platform, kind, self.ns, name, target_ns, target, detail, *self._place(n)))

    def run(self) -> list[tuple]:
        try:
            forms = Reader(self.text, self.platform).forms()
        except (Malformed, RecursionError) as e:
            self.rows = [(self.path, self.platform, "malformed", None, None, None, None, str(e)[:200], None, None, None, None, None, None)]
            return self.rows
        if self.platform == "janet":
            self._row("namespace", Node("symbol", self.ns, 0, len(self.text)), self.ns)
        for f in forms:
            self._top(f)
        for head, root, row in self.pending:
            if self._is_state(head, root):
                self._row(*row)
        return self.rows

    def _top(self, f: Node) -> None:
        self.owner = None
        if f.kind != "list" or not f.children or f.children[0].kind != "symbol":
            return self._walk(f, frozenset())
        head = f.children[0].text
        if head == "ns" and len(f.children) > 1:
            return self._ns(f)
        if head in ("import", "use", "require") and self.platform == "janet":
            return self._janet_import(f)
        short = head.rsplit("/", 1)[-1]
        if short in DEFINERS and len(f.children) > 1 and f.children[1].kind == "symbol":
            return self._define(f, short)
        return self._walk(f, frozenset())

    def _ns(self, f: Node) -> None:
        self.ns = f.children[1].text
        doc = next((c.text for c in f.children[2:3] if c.kind == "string"), None)
        self._row("namespace", f, self.ns, detail=doc)
        for clause in f.children[2:]:
            if clause.kind == "list" and clause.children and clause.children[0].text in (":require", ":use", ":require-macros", ":refer-clojure", ":import"):
                if clause.children[0].text == ":refer-clojure":
                    continue
                if clause.children[0].text == ":import":
                    if self.platform == "clj":
                        for spec in clause.children[1:]:
                            self._import(spec)
                    continue
                for spec in clause.children[1:]:
                    self._require(spec, "")

    def _import(self, spec: Node) -> None:
        """A class by its full name, or a package and its classes."""
        package = spec.children[0].text if spec.kind in ("vector", "list") and spec.children else None
        for c in spec.children[1:] if package else [spec]:
            if c.kind == "symbol":
                full = f"{package}.{c.text}" if package else c.text
                self.imports[full.rsplit(".", 1)[-1]] = full
                self._row("java", c, target=full, detail="references\x1fexternal")

    def _require(self, spec: Node, prefix: str) -> None:
        if spec.kind == "symbol":
            return self._row("require", spec, target_ns=prefix + spec.text)
        items = spec.children
        if not items or items[0].kind != "symbol":
            return None
        name = prefix + items[0].text
        if spec.kind == "list" and any(c.kind in ("vector", "symbol") for c in items[1:]):
            for c in items[1:]:
                self._require(c, items[0].text + ".")
            return None
        self._row("require", spec, target_ns=name)
        for key, value in zip(items[1::2], items[2::2], strict=False):
            if key.text in (":as", ":as-alias"):
                self.alias[value.text] = name
            elif key.text == ":refer" and value.kind in ("vector", "list"):
                self.refers |= {c.text: name for c in value.children}
        return None

    def _janet_import(self, f: Node) -> None:
        if len(f.children) < 2:
            return
        target = f.children[1].text
        base = self.path.rsplit("/", 1)[0] + "/" if "/" in self.path else ""
        parts: list[str] = []
        for p in ((base + target) if target.startswith(".") else target.lstrip("/")).split("/"):
            if p == ".." and parts:
                parts.pop()
            elif p not in (".", "..", ""):
                parts.append(p)
        name = "/".join(parts)
        self._row("require", f, target_ns=name)
        options = {k.text: v.text for k, v in zip(f.children[2::2], f.children[3::2], strict=False)}
        self.alias[options.get(":as", options.get(":prefix", name.rsplit("/", 1)[-1] + "/").rstrip("/"))] = name

    def _define(self, f: Node, short: str) -> None:
        name = f.children[1]
        kind = DEFINERS[short]
        if kind == "declare":
            for c in f.children[1:]:
                self._row("declare", c, c.text, detail="declare")
            return
        meta = name.children[0] if name.children and name.children[0].kind == "meta" else None
        flags = {meta.text, *[c.text for c in meta.children]} if meta else set()
        private = short.endswith("-") or ":private" in flags
        if kind == "variable" and ":const" in flags:
            kind = "constant"
        rest = f.children[2:]
        doc = rest[0].text if rest and rest[0].kind == "string" and (len(rest) > 1 or kind in ("protocol", "multimethod")) else None
        params = next((c for c in rest if c.kind == "vector"), None) if kind in ("function", "macro") else None
        signature = self.text[params.start : params.end] if params else None
        detail = "\x1f".join([kind, "private" if private else "public", signature or "", doc or ""])
        self._row("var", f, name.text, detail=detail)
        self.owner = name.text
        if kind == "protocol":
            for m in rest:
                if m.kind == "list" and m.children and m.children[0].kind == "symbol":
                    self._row("var", m, m.children[0].text, target=name.text, detail="\x1f".join(["method", "public", "", ""]))
            return
        if kind in ("function", "macro"):
            self._function(rest, frozenset())
        elif short in IMPLEMENTERS:
            fields_ = self._names(rest[0]) if rest and rest[0].kind == "vector" else frozenset()
            self._implements(short, rest[1:] if fields_ or rest and rest[0].kind == "vector" else rest, fields_)
        else:
            for c in rest:
                self._walk(c, frozenset())
        if kind == "variable" and rest and rest[-1].kind in ("map", "vector", "set"):
            self._literal(name.text, rest[-1])

    def _implements(self, form: str, parts: list[Node], scope: frozenset) -> None:
        """Types or protocols, each followed by the methods that implement it; options come in pairs of a keyword and a value."""
        protocol = parts[0] if form in ("extend-type", "extend-protocol") and parts else None
        if form == "extend-type" and parts:
            self._walk(parts[0], scope)
        for c in parts[1:] if protocol else parts:
            if c.kind == "list" and c.children and c.children[0].kind == "symbol":
                if protocol is not None and protocol.kind == "symbol":
                    space, name = self._resolved(protocol.text)
                    self._row("protocol-impl", c, self.owner, space, c.children[0].text, name)
                self._function(c.children[1:], scope | {c.children[0].text})
            elif c.kind != "keyword":
                if c.kind == "symbol" and form != "extend-protocol":
                    protocol = c
                self._walk(c, scope)

    def _resolved(self, text: str) -> tuple[str, str]:
        """(namespace, name) of a symbol that isn't a local."""
        space, slash, short = text.partition("/")
        if slash and space and short:
            return self.alias.get(space, space), short
        return self.refers.get(text, self.ns), text

    def _literal(self, owner: str, n: Node) -> None:
        """A collection that is a var's value, with its members in order."""
        self._row("aggregate", n, owner, detail=n.kind)
        members = list(zip(n.children[::2], n.children[1::2], strict=False)) if n.kind == "map" else [(None, c) for c in n.children]
        for k, c in members:
            plain = c.kind in ("keyword", "string", "number", "char") or (c.kind == "symbol" and c.text in ("nil", "true", "false"))
            self._row("member", c, owner, target=self.text[c.start : c.end], detail="\x1f".join(["literal" if plain else "expression", c.kind, self.text[k.start : k.end] if k else ""]))

    def _function(self, parts: list[Node], scope: frozenset) -> None:
        """Parameters and body, or several lists of them."""
        for at, c in enumerate(parts):
            if c.kind == "vector":
                inner = scope | self._names(c)
                for b in parts[at + 1 :]:
                    self._walk(b, inner)
                return
            if c.kind == "list" and c.children and c.children[0].kind == "vector":
                self._function(c.children, scope)
            elif c.kind == "map":
                self._walk(c, scope)

    def _names(self, n: Node) -> frozenset:
        if n.kind == "symbol":
            return frozenset([n.text])
        return frozenset().union(*[self._names(c) for c in n.children]) if n.kind in ("vector", "map") else frozenset()

    def _walk(self, n: Node, scope: frozenset, call: bool = False) -> None:
        if n.kind == "symbol":
            self._use(n, scope, call)
        elif n.kind == "list" and n.children:
            head = n.children[0]
            name = head.text.rsplit("/", 1)[-1] if head.kind == "symbol" else ""
            if name in BINDERS and len(n.children) > 1 and n.children[1].kind == "vector":
                self._walk(head, scope, True)
                pairs = n.children[1].children
                for left, right in zip(pairs[::2], pairs[1::2], strict=False):
                    self._walk(right, scope)
                    if left.kind != "keyword":
                        scope = scope | self._names(left)
                for c in n.children[2:]:
                    self._walk(c, scope)
            elif name in FUNCTIONS:
                rest = n.children[1:]
                if rest and rest[0].kind == "symbol":
                    scope = scope | {rest[0].text}
                self._function(rest, scope)
            elif name == "quote":
                return
            else:
                if head.kind == "symbol" and self.platform == "cljs" and name in TOPICAL and head.text not in scope and head.text.partition("/")[0] not in scope:
                    self._topical(n, name)
                if name in ("extend-type", "extend-protocol", "reify"):
                    self._walk(head, scope, True)
                    return self._implements(name, n.children[1:], scope)
                self._walk(head, scope, True)
                for c in n.children[1:]:
                    self._walk(c, scope)
        elif n.kind == "quote":
            return
        else:
            if n.kind == "deref" and self.platform == "cljs" and self.text[n.start] == "@" and n.children[0].kind == "symbol" and n.children[0].text not in scope:
                self._atom_access(n, n.children[0], "state-reads", "deref", True)
            for c in n.children:
                if c.kind != "meta":
                    self._walk(c, scope)

    # topics: what a call reads, writes, registers or sends, where its key is literal
    def _topical(self, n: Node, name: str) -> None:
        """Rows ``topic`` of a call: target_ns and target as called, detail: relation, kind of topic, key (empty where it is
        computed), the argument's text, and whether the name is a plain one."""
        head, args = n.children[0], n.children[1:]
        arg = lambda i: args[i] if i < len(args) else None
        space, short = self._resolved(head.text)
        plain = "/" not in head.text and head.text not in self.refers
        if space == TOPIC_NAMESPACE and short in TOPIC_CALLS:
            self._topic_row(n, (space, short, False), "", "", arg(0), short in HEAD_OF_VECTOR)
            handler = next((c for c in args[1:] if c.kind == "list" and c.children and c.children[0].text.rsplit("/", 1)[-1] == "fn"), None)
            params = next((c for c in handler.children[1:] if c.kind == "vector"), None) if handler and short == "reg-event-db" else None
            if params and params.children and params.children[0].kind == "symbol":
                self.handlers.append((n.start, n.end, params.children[0].text))
        elif not plain and space not in CORE:
            return
        elif short == "atom":
            self.atoms |= {self.owner, f"{self.ns}/{self.owner}"} if self.owner else set()
        elif short in STATE_READS | STATE_WRITES:
            edge = "state-reads" if short in STATE_READS else "state-writes"
            self._topic_row(n, (space, short, plain), edge, "state-key", arg(1), False, (n, arg(0)))
        elif short in ATOM_CALLS and arg(0) is not None:
            edge = "state-reads" if short == "deref" else "state-writes"
            self._atom_access(n, arg(0), edge, short, plain)
            if short == "swap!" and self._key(arg(2), False):
                self._topic_row(n, (space, short, plain), edge, "state-key", arg(2), False, (n, self._atom_symbol(arg(0), True)))

    def _atom_access(self, n: Node, root: Node, edge: str, short: str, plain: bool) -> None:
        named = self._atom_symbol(root, short != "deref")
        if named is not None:
            where = self.ns if plain else "cljs.core"
            detail = "\x1f".join([edge, "state-key", f"atom:{root.text}" if root.kind == "symbol" else f"atom:{named.text}", "", "plain" if plain else "qualified"])
            self.pending.append((n, Node("atom", named.text, n.start, n.end), ("topic", n, self.owner, where, short, detail)))

    def _topic_row(self, n: Node, called: tuple[str, str, bool], edge: str, kind: str, argument: Node | None, first: bool, root: tuple | None = None) -> None:
        space, short, plain = called
        said = self.text[argument.start : argument.end] if argument is not None else "<computed-topic>"
        detail = "\x1f".join([edge, kind, self._key(argument, first) or "", said, "plain" if plain else "qualified"])
        row = ("topic", n, self.owner, space, short, detail)
        if root is None:
            self._row(*row)
        elif root[1] is not None:
            self.pending.append((*root, row))

    @staticmethod
    def _atom_symbol(n: Node | None, deref: bool) -> Node | None:
        """The symbol that names an atom, or the one that is dereferenced."""
        if n is None or n.kind == "symbol":
            return n
        if deref and n.kind == "deref" and n.children[0].kind == "symbol":
            return n.children[0]
        if deref and n.kind == "list" and len(n.children) > 1 and n.children[0].text.rsplit("/", 1)[-1] == "deref" and n.children[1].kind == "symbol":
            return n.children[1]
        return None

    def _is_state(self, call: Node, root: Node | None) -> bool:
        """Whether a root is an atom of this file, or, as a symbol, the state that a handler around the call is given."""
        named = root if root is not None and root.kind == "atom" else self._atom_symbol(root, True)
        if named is None:
            return False
        if named.text in self.atoms:
            return True
        return root.kind == "symbol" and any(a <= call.start < b and root.text == name for a, b, name in self.handlers)

    def _key(self, n: Node | None, first: bool) -> str | None:
        """A topic's key: a keyword, or a vector of literals, as it prints; None for all that is computed."""
        if n is None or not self._static(n):
            return None
        if first and n.kind == "vector":
            n = n.children[0] if n.children else None
        return self._printed(n) if n is not None and n.kind in ("keyword", "vector") else None

    def _static(self, n: Node) -> bool:
        if n.kind in ("vector", "map", "set"):
            return all(self._static(c) for c in n.children)
        return n.kind in ("keyword", "string", "number", "char") or (n.kind == "symbol" and n.text in ("nil", "true", "false"))

    def _printed(self, n: Node) -> str:
        if n.kind in ("vector", "map", "set"):
            a, b = {"vector": "[]", "map": "{}", "set": ("#{", "}")}[n.kind]
            return a + " ".join(map(self._printed, n.children)) + b
        return self._keyword(n.text) if n.kind == "keyword" else self.text[n.start : n.end]

    def _keyword(self, text: str) -> str:
        """``::name`` in its namespace, ``::alias/name`` in the one that the alias stands for."""
        if not text.startswith("::"):
            return text
        space, slash, name = text[2:].partition("/")
        return f":{self.alias.get(space, space)}/{name}" if slash else f":{self.ns}/{space}"

    def _use(self, n: Node, scope: frozenset, call: bool) -> None:
        name = n.text
        if self.platform == "clj" and name not in scope and self._java(n, name, call):
            return
        if name in SPECIAL or name.startswith((".", "%")) or name.endswith("."):
            return
        kind = "call" if call else "mention"
        space, slash, short = name.partition("/")
        if name in scope or (slash and space in scope):
            if call:
                self._row("local-call", n, self.owner, target=name, detail=kind)
            return
        if slash and space and short:
            self._row("usage", n, self.owner, self.alias.get(space, space), short, f"{kind}\x1fqualified")
        elif name in self.refers:
            self._row("usage", n, self.owner, self.refers[name], name, f"{kind}\x1fqualified")
        else:
            self._row("usage", n, self.owner, self.ns, name, f"{kind}\x1fplain")


    def _java(self, n: Node, name: str, call: bool) -> bool:
        """Calls of members are dynamic, classes by themselves external; both are told by the name alone."""
        if name in SPECIAL or name == ".." or name.startswith("%"):
            return False
        if name.startswith("."):
            if call and len(name) > 1:
                self._row("java", n, self.owner, target=name, detail="calls\x1fdynamic")
            return True
        space, slash, member = name.partition("/")
        bare = space.removesuffix(".") if not slash else space
        known = self.imports.get(bare) or (bare if "." in bare and bare.rsplit(".", 1)[-1][:1].isupper() else None)
        if slash and member and space not in self.alias and (known or space[:1].isupper()):
            self._row("java", n, self.owner, target=f"{known or 'java.lang.' + space}/{member}", detail="calls\x1fdynamic")
            return True
        if not slash and (known or (name.endswith(".") and len(name) > 1)):
            self._row("java", n, self.owner, target=known or bare, detail="references\x1fexternal")
            return True
        return False


TOPICAL = TOPIC_CALLS | STATE_READS | STATE_WRITES | ATOM_CALLS | {"atom"}
PLATFORMS = {"clj": ("clj",), "cljs": ("cljs",), "cljc": ("clj", "cljs"), "janet": ("janet",)}


def observe(files: DataFrame) -> DataFrame:
    """files (path, text): observations of each file on each platform of its extension, SCHEMA columns.

    A file that can't be read gives one row of kind malformed and nothing else. Null texts are empty.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for f in frames:
            rows: list[tuple] = []
            for path, text in zip(f["path"], f["text"], strict=True):
                for platform in PLATFORMS.get(path.rsplit(".", 1)[-1], ()):
                    rows += Observer(path, text or "", platform).run()
            out = pd.DataFrame(rows, columns=names)
            for c in names[8:]:
                out[c] = out[c].astype("Int64")
            yield out

    return files.select("path", "text").mapInPandas(run, SCHEMA)
