"""Linear scan of one TypeScript/JavaScript text: tokens, bracket pairs, rules.

A small per-file helper for ``rules_ts`` (run in Arrow batches inside the scan stage). One
pass cuts the text into tokens and pairs brackets with a stack, at any depth; every rule
then looks pairs up instead of searching the text again, so a file costs time and
memory in proportion to its size. A text that is no valid program never raises: unpaired
brackets stay unpaired and rules skip them.
"""
from __future__ import annotations

import re
from bisect import bisect_right

# --- fixed values -----------------------------------------------------------------
RESPONSE_NAMES = frozenset(("res", "response", "resp", "reply", "ctx"))
WRITE_METHODS = frozenset(("post", "put", "patch", "delete"))
AXIOS_WRITES = frozenset(("post", "put", "patch"))

_TOKEN = re.compile(r"""
    (?P<skip>\s++|//[^\n]*+|/\*(?:[^*]++|\*(?!/))*+(?:\*/)?)
  | (?P<word>(?:[^\W\d]|\$)[\w$]*+)
  | (?P<num>\d[\w.]*+)
  | (?P<str>'(?:[^'\\\n]++|\\[\s\S])*+'|"(?:[^"\\\n]++|\\[\s\S])*+")
  | (?P<op>\?\.(?!\d)|\.\.\.|=>|[=!]==?|[<>]=|&&=?|\|\|=?|\?\?=?|\+\+|--|[-+*%&|^]=|[\s\S])
""", re.X)
_TEMPLATE = re.compile(r"(?:[^`\\$]++|\\[\s\S]|\$(?!\{))*+")
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*+\])++/\w*+")
_BEFORE_REGEX = frozenset("return typeof case in of delete void throw new else do instanceof yield await".split())
_NOT_CALLED = frozenset("if for while switch catch with return typeof case in of delete void throw else do "
                        "instanceof yield await function const let var".split())
_IN_TYPES = frozenset((".", ",", "|", "&", "=>", "?", ":", "...", "-", "(", ")", "[", "]", "{", "}", "${"))
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}", "${": "}"}, frozenset(")]}")
_TYPE_PREFIX = frozenset("keyof readonly typeof unique infer asserts new abstract".split())
_STATEMENT = frozenset("const let var function return if for while switch class interface type import export "
                       "throw try break continue do".split())


class Tokens:
    """kind, text, position and line of each token; ``pair`` the partner of a bracket (-1: none),
    ``parent`` the innermost open bracket around a token (-1: none), ``start`` the first
    token of the postfix expression that ends at a token."""

    def __init__(self, text: str):
        self.source = text
        self.kind: list[str] = []
        self.text: list[str] = []
        self.pos: list[int] = []
        self.pair: list[int] = []
        self.parent: list[int] = []
        self._breaks = [m.start() for m in re.finditer("\n", text)]
        self._cut()
        self._starts()

    def __len__(self) -> int:
        return len(self.text)

    def line(self, i: int) -> int:
        return self.line_at(self.pos[i])

    def line_at(self, pos: int) -> int:
        return bisect_right(self._breaks, pos - 1) + 1 if pos else 1

    def at(self, i: int) -> str:
        """The token's text if it is a word or an operator ('' outside and for literals)."""
        return self.text[i] if 0 <= i < len(self.text) and self.kind[i] in ("word", "op") else ""

    def is_word(self, i: int) -> bool:
        return 0 <= i < len(self.text) and self.kind[i] == "word"

    def _cut(self) -> None:
        text, n, at = self.source, len(self.source), 0
        stack: list[int] = []
        depth = {")": 0, "]": 0, "}": 0}

        def add(kind: str, value: str, pos: int) -> int:
            self.kind.append(kind)
            self.text.append(value)
            self.pos.append(pos)
            self.pair.append(-1)
            self.parent.append(stack[-1] if stack else -1)
            return len(self.text) - 1

        def template(pos: int) -> int:
            """Template characters up to ``${`` or the end of the literal."""
            end = _TEMPLATE.match(text, pos).end()
            if text.startswith("${", end):
                stack.append(add("op", "${", end))
                depth["}"] += 1
                return end + 2
            add("str", "`", min(end, n - 1))
            return end + 1

        while at < n:
            found = _TOKEN.match(text, at)
            kind, value = found.lastgroup, found[0]
            if kind == "skip":
                at = found.end()
                continue
            before = self.text[-1] if self.text else ""
            if kind == "str" and at and self.kind and self.kind[-1] == "word" and before not in _BEFORE_REGEX \
                    and self.pos[-1] + len(before) == at:
                at += 1  # an apostrophe inside a word of JSX text
                continue
            if value == "`":
                at = template(at + 1)
                continue
            if value == "/" and (not self.text or (self.kind[-1] == "op" and before not in (")", "]", "}", "<"))
                                 or (self.kind[-1] == "word" and before in _BEFORE_REGEX)):
                literal = _REGEX.match(text, at)
                if literal:
                    add("str", literal[0], at)
                    at = literal.end()
                    continue
            at = found.end()
            if kind == "op" and value in _OPEN:
                stack.append(add(kind, value, found.start()))
                depth[_OPEN[value]] += 1
            elif kind == "op" and value in _CLOSE:
                if not depth[value]:
                    add(kind, value, found.start())
                    continue
                while _OPEN[self.text[stack[-1]]] != value:
                    depth[_OPEN[self.text[stack.pop()]]] -= 1
                opened = stack.pop()
                depth[value] -= 1
                i = add(kind, value, found.start())
                self.pair[i], self.pair[opened] = opened, i
                if self.text[opened] == "${":
                    at = template(at)
            else:
                add(kind, value, found.start())

    def _angles(self) -> None:
        """Pairs '<' and '>' that have only what types may hold between them, within one bracket."""
        self.angle = [-1] * len(self)
        opened: dict[int, list[int]] = {}
        for i in range(len(self)):
            if self.kind[i] != "op":
                continue
            value, here = self.text[i], opened.setdefault(self.parent[i], [])
            if value == "<":
                here.append(i)
            elif value == ">":
                if here:
                    self.angle[i] = here.pop()
                    self.angle[self.angle[i]] = i
            elif value not in _IN_TYPES:
                here.clear()

    def _starts(self) -> None:
        self._angles()
        self.start = list(range(len(self)))
        self.generic: dict[int, int] = {}  # '>' of type arguments before a call -> '<'
        for i in range(len(self)):
            value = self.at(i)
            if self.kind[i] == "word":
                if self.at(i - 1) in (".", "?.") and i >= 2:
                    self.start[i] = self.start[i - 2]
            elif value == ">" and self.at(i + 1) == "(":
                opened = self._type_arguments(i)
                if opened:
                    self.generic[i] = opened
                    self.start[i] = self.start[opened - 1]
            elif value in _CLOSE and self.pair[i] >= 0:
                opened = self.pair[i]
                self.start[i] = opened
                j = opened - 1
                if self.at(j) == "?." and j:
                    j -= 1
                if self.text[opened] in ("(", "[") and self.ends_operand(j):
                    self.start[i] = self.start[j]
            elif value == "!" and self.ends_operand(i - 1) and self.at(i + 1) in (".", "?.", "(", "[", ")", ",", ";"):
                self.start[i] = self.start[i - 1]

    def ends_operand(self, i: int) -> bool:
        if i < 0:
            return False
        if self.kind[i] == "word":
            return self.text[i] not in _NOT_CALLED or self.at(i - 1) in (".", "?.")
        return self.kind[i] != "op" or (self.text[i] in _CLOSE and self.pair[i] >= 0) or i in self.generic

    def _type_arguments(self, i: int) -> int:
        """The '<' right behind a word that the '>' at ``i`` closes, or 0."""
        j = self.angle[i]
        word = j > 0 and self.kind[j - 1] == "word" and self.pos[j - 1] + len(self.text[j - 1]) == self.pos[j]
        return j if word else 0

    def parts(self, opened: int) -> list[tuple[int, int]]:
        """Token ranges between the commas at depth 1 of a bracket; a last empty one is left out."""
        out, i, end = [], opened + 1, self.pair[opened]
        begin = i
        while i < end:
            if self.kind[i] == "op":
                if self.text[i] == ",":
                    out.append((begin, i))
                    begin = i + 1
                elif self.pair[i] > i:
                    i = self.pair[i]
            i += 1
        if begin < end:
            out.append((begin, end))
        return out

    def literal(self, begin: int, end: int) -> int:
        """The brace of the object literal that the range is, or -1."""
        return begin if begin < end and self.at(begin) == "{" and self.pair[begin] == end - 1 else -1


def object_fields(t: Tokens, brace: int) -> list[tuple[str, int]]:
    """(name, token) of the assigned and shorthand properties of an object literal."""
    out = []
    for a, b in t.parts(brace):
        if t.kind[a] == "op":
            continue
        key = t.text[a][1:-1] if t.kind[a] == "str" and t.text[a][0] in "'\"" else t.text[a]
        if t.at(a + 1) == ":" and a + 2 < b or (a + 1 == b and t.kind[a] == "word"):
            out.append((key, a))
    return out


def _property(t: Tokens, brace: int, name: str) -> tuple[int, int] | None:
    """Range of the initializer of the first property ``name``, if it is an assignment."""
    for a, b in t.parts(brace):
        if t.is_word(a) and t.text[a] == name:
            return (a + 2, b) if t.at(a + 1) == ":" else None
    return None


class Scopes:
    """Declarations by the brace they belong to (-1: the file)."""

    def __init__(self, t: Tokens, lists: dict[int, int]):
        self.t, self.names = t, {}
        self.bodies = set(lists.values())  # braces of function bodies
        self.patterns: list[int] = []  # brackets of binding patterns
        for i in range(len(t)):
            word = t.text[i] if t.kind[i] == "word" else ""
            if word in ("const", "let", "var") and t.at(i - 1) not in (".", "?."):
                self._declarators(i, self._scope(i, word == "var"))
            elif word in ("function", "class", "enum") and t.is_word(i + 1):
                self._add(self._scope(i, False), t.text[i + 1], -1)
            elif word == "import" and t.at(i - 1) != ".":
                self._imports(i)
        for opened, body in lists.items():
            for a, b in t.parts(opened):
                self._parameter(a, b, body)

    def _add(self, scope: int, name: str, literal: int) -> None:
        self.names.setdefault((scope, name), []).append(literal)

    def _scope(self, i: int, function: bool) -> int:
        p = self.t.parent[i]
        if p >= 0 and self.t.text[p] == "(" and self.t.at(p - 1) == "for" and not function:
            body = self.t.pair[p] + 1
            return body if self.t.at(body) == "{" else p
        while p >= 0 and (self.t.text[p] != "{" or (function and p not in self.bodies)):
            p = self.t.parent[p]
        return p

    def _declarators(self, i: int, scope: int) -> None:
        t, i = self.t, i + 1
        while True:
            name, literal = "", -1
            if t.is_word(i):
                name = t.text[i]
            elif t.at(i) in ("{", "[") and t.pair[i] > i:
                self.patterns.append(i)
                i = t.pair[i]
            else:
                return
            i += 1
            if t.at(i) == "!":
                i += 1
            if t.at(i) == ":":
                i = skip_type(t, i + 1)
            if t.at(i) == "=":
                i += 1
                if t.at(i) == "{" and t.pair[i] > i and self._ends(t.pair[i]):
                    literal = i
                i = self._after_expression(i)
            if name:
                self._add(scope, name, literal)
            if t.at(i) != ",":
                return
            i += 1

    def _ends(self, i: int) -> bool:
        """Whether an initializer ends with token ``i``."""
        t = self.t
        after = t.at(i + 1)
        if i + 1 >= len(t) or after in (",", ";", ")", "]", "}"):
            return True
        return t.line(i + 1) > t.line(i) and t.kind[i + 1] != "op" and after not in ("as", "satisfies", "in", "of")

    def _after_expression(self, i: int) -> int:
        """The comma at depth 0 behind an expression, or where it surely is over."""
        t = self.t
        while i < len(t):
            value = t.at(i)
            if value in (",", ";") or value in _CLOSE:
                return i
            if value in _STATEMENT and t.at(i - 1) not in (".", "?.", "="):
                if t.line(i) > t.line(i - 1):
                    return i
            i = t.pair[i] + 1 if t.pair[i] > i else i + 1
        return i

    def _imports(self, i: int) -> None:
        t, j = self.t, i + 1
        while j < len(t) and t.kind[j] != "str" and t.at(j) not in (";", "(", "="):
            if t.is_word(j) and t.text[j] not in ("from", "as", "type"):
                self._add(-1, t.text[j], -1)
            j += 1

    def _parameter(self, a: int, b: int, body: int) -> None:
        t = self.t
        while a < b and (t.at(a) in ("...", "public", "private", "protected", "readonly") or t.at(a) == "@"):
            if t.at(a) != "..." and t.is_word(a) and t.at(a + 1) in (",", "", ":", "?", "=", ")"):
                break
            a += 1 if t.at(a) != "@" else 2
        if a < b and t.at(a) in ("{", "[") and t.pair[a] > a:
            self.patterns.append(a)
        elif t.is_word(a):
            self._add(body, t.text[a], -1)

    def resolve(self, i: int) -> int:
        """The brace of the object literal that the identifier at token ``i`` stands for, or -1: its nearest
        enclosing declaration must be the only one there and have that literal as initializer."""
        t, name, p = self.t, self.t.text[i], self.t.parent[i]
        while True:
            found = self.names.get((p, name))
            if found is not None:
                return found[0] if len(found) == 1 else -1
            if p < 0:
                return -1
            p = t.parent[p]


def skip_type(t: Tokens, i: int) -> int:
    """The token behind the type that begins at ``i``."""
    n = len(t)
    if t.at(i) in ("|", "&"):
        i += 1
    while i < n:
        while t.at(i) in _TYPE_PREFIX and (t.is_word(i + 1) or t.at(i + 1) in ("(", "{", "[")):
            i += 1
        value = t.at(i)
        if value in ("(", "{", "[") and t.pair[i] > i:
            i = t.pair[i] + 1
            if value == "(" and t.at(i) == "=>":
                i += 1
                continue
        elif t.kind[i] in ("word", "num", "str"):
            i += 1
            while t.at(i) == "." and t.is_word(i + 1):
                i += 2
        elif value == "${" and t.pair[i] > i:
            i = t.pair[i] + 1
            continue
        elif value == "-":
            i += 1
            continue
        else:
            return i
        if t.at(i) == "<":
            i = _skip_angles(t, i)
        while t.at(i) == "[" and t.pair[i] > i and t.line(i) == t.line(i - 1):
            i = t.pair[i] + 1
        if t.at(i) in ("|", "&") or (t.at(i) == "is" and t.line(i) == t.line(i - 1)):
            i += 1
            continue
        if t.at(i) == "extends":  # conditional type
            i = skip_type(t, i + 1)
            if t.at(i) != "?":
                return i
            i = skip_type(t, i + 1)
            if t.at(i) != ":":
                return i
            i += 1
            continue
        return i
    return i


def _skip_angles(t: Tokens, i: int) -> int:
    """Behind the '>' of the '<' at ``i`` (behind '<' itself if it has none)."""
    return max(t.angle[i], i) + 1


def parameter_lists(t: Tokens) -> dict[int, int]:
    """'(' of each parameter list -> '{' of its body (or the '(' itself where there is none)."""
    out: dict[int, int] = {}
    for i in range(len(t)):
        close = t.pair[i]
        if t.at(i) != "(" or close < i:
            continue
        name, j = t.at(i - 1), close + 1
        if name in ("if", "for", "while", "switch", "with"):
            continue
        if t.at(j) == ":":
            after = skip_type(t, j + 1)
            if t.at(after) == "=>" or (t.at(after) == "{" and (t.is_word(i - 1) or name in ("", ">", "]"))):
                j = after
        if t.at(j) == "=>":
            out[i] = j + 1 if t.at(j + 1) == "{" and t.pair[j + 1] > 0 else i
        elif t.at(j) == "{" and t.pair[j] > 0 and i and (t.kind[i - 1] != "op" or name in (">", "]", "*")):
            out[i] = j
    return out


def type_ranges(t: Tokens, lists: dict[int, int]) -> list[tuple[int, int]]:
    """Token ranges that hold types: no property is read there."""
    out: list[tuple[int, int]] = []

    def annotated(colon: int) -> None:
        out.append((colon, skip_type(t, colon + 1)))

    bodies: set[int] = set()
    for i in range(len(t)):
        word = t.at(i)
        free = t.at(i - 1) not in (".", "?.")
        if word in ("as", "satisfies") and free and t.ends_operand(i - 1) and t.at(i - 1) not in ("import", "export", "*"):
            out.append((i, skip_type(t, i + 1)))
        elif word in ("const", "let", "var") and free:
            j = i + 1
            j = t.pair[j] + 1 if t.at(j) in ("{", "[") and t.pair[j] > j else j + 1
            if t.at(j) == "!":
                j += 1
            if t.at(j) == ":":
                annotated(j)
        elif word == "type" and free and t.is_word(i + 1) and t.at(i + 2) in ("=", "<"):
            j = _skip_angles(t, i + 2) if t.at(i + 2) == "<" else i + 2
            if t.at(j) == "=":
                out.append((i, skip_type(t, j + 1)))
        elif word in ("interface", "class") and free and (t.is_word(i + 1) or t.at(i + 1) == "{"):
            j = i + 1
            while j < len(t) and t.at(j) not in ("{", ";", ")") and t.at(j) not in _STATEMENT:
                if t.at(j) == "implements":
                    k = j + 1
                    while k < len(t) and t.at(k) not in ("{", ";", "implements") and t.at(k) not in _STATEMENT:
                        k += 1
                    out.append((j, k))
                    j = k
                    continue
                j = _skip_angles(t, j) if t.at(j) == "<" else t.pair[j] + 1 if t.pair[j] > j else j + 1
            if t.at(j) == "{" and t.pair[j] > j:
                if word == "interface":
                    out.append((j, t.pair[j]))
                else:
                    bodies.add(j)
        elif word == ":" and t.at(i - 1) == ")" and t.pair[i - 1] in lists:
            annotated(i)
        elif word == "<" and t.is_word(i - 1) and t.pos[i - 1] + len(t.text[i - 1]) == t.pos[i] and t.is_word(i + 1):
            end = _skip_angles(t, i)
            if end > i + 1 and t.at(end) in ("(", ")", ",", ";", "{", "=", ">", "[", ".", "|", "&"):
                out.append((i, end))
    for opened in lists:
        for a, b in t.parts(opened):
            j = t.pair[a] + 1 if t.pair[a] > a else a
            while j < b and t.at(j) not in (":", "="):
                j = t.pair[j] + 1 if t.pair[j] > j else j + 1
            if j < b and t.at(j) == ":":
                out.append((j, max(j + 1, min(b, skip_type(t, j + 1)))))
    for body in bodies:  # members: name: type
        j, fresh = body + 1, True
        while j < t.pair[body]:
            value = t.at(j)
            if value == ":" and fresh:
                end = skip_type(t, j + 1)
                out.append((j, end))
                j = max(end, j + 1)
                continue
            if value == "=":
                fresh = False
            elif value in (";", "}") or (not fresh and t.line(j) > t.line(j - 1) and t.kind[j] == "word"):
                fresh = True
            j = t.pair[j] + 1 if t.pair[j] > j else j + 1
            if t.at(j - 1) == "}":
                fresh = True
    return out


def calls(t: Tokens) -> list[int]:
    """'(' of each call, in the order of the calls' first tokens (outer ones first)."""
    found = []
    for i in range(len(t)):
        if t.at(i) == "(" and t.pair[i] > i and i:
            j = i - 1
            if t.at(j) == "?.":
                j -= 1
            if t.ends_operand(j) and t.at(t.start[j] - 1) != "new":
                found.append((t.start[j], -t.pair[i], i))
    return [i for _, _, i in sorted(found)]


def _callee(t: Tokens, opened: int) -> int:
    """Last token of what is called."""
    j = opened - 1
    if j in t.generic:
        j = t.generic[j] - 1
    return j - 1 if t.at(j) == "?." else j


def _is_plain(t: Tokens, j: int, owner: str, names) -> bool:
    """Whether the callee that ends at ``j`` reads ``owner.name`` without a blank, and nothing before."""
    return (t.is_word(j) and t.text[j] in names and t.at(j - 1) == "." and t.at(j - 2) == owner
            and t.pos[j] - t.pos[j - 2] == len(owner) + 1 and t.at(j - 3) not in (".", "?."))


def request_facts(t: Tokens, scopes: Scopes, order: list[int]) -> list[tuple[str, str, int]]:
    """(rule, name, line) of request bodies, call by call."""
    out: list[tuple[str, str, int]] = []

    def add(rule: str, brace: int) -> None:
        out.extend((rule, name, t.line(a)) for name, a in object_fields(t, brace))

    for opened in order:
        j, args = _callee(t, opened), t.parts(opened)
        if not args:
            continue
        if _is_plain(t, j, "axios", AXIOS_WRITES) and len(args) > 1 and t.literal(*args[1]) >= 0:
            add("ts_axios_body", args[1][0])
        options = t.literal(*args[-1])
        if options >= 0:
            method, body = _property(t, options, "method"), _property(t, options, "body")
            if method and body and t.at(body[1] - 1) == ")":
                spoken = t.source[t.pos[method[0]]:t.pos[method[1] - 1] + len(t.text[method[1] - 1])]
                if t.text[method[1] - 1] == "`":
                    spoken = t.source[t.pos[method[0] - 1] + 1:t.pos[method[1] - 1]]
                inner = t.pair[body[1] - 1]
                if re.sub("['\"` ]", "", spoken.strip()).lower() in WRITE_METHODS and inner >= 0 \
                        and _is_plain(t, _callee(t, inner), "JSON", ("stringify",)) and t.start[_callee(t, inner)] == body[0]:
                    given = t.parts(inner)
                    if given and t.literal(*given[0]) >= 0:
                        add("ts_options_body", given[0][0])
                    elif given and given[0][1] - given[0][0] == 1 and t.is_word(given[0][0]):
                        brace = scopes.resolve(given[0][0])
                        if brace >= 0:
                            add("ts_options_body_var", brace)
        if _is_plain(t, j, "JSON", ("stringify",)) and t.literal(*args[0]) >= 0:
            first, end = t.start[j], t.pair[opened] + 1
            whole = t.at(end) in (",", "}") or end >= len(t)
            in_body = (t.at(first - 1) == ":" and t.at(first - 2) == "body" and t.at(first - 3) in ("{", ",") and whole)
            if not in_body:
                add("ts_stringify", args[0][0])
    return out


def response_facts(t: Tokens, scopes: Scopes, order: list[int]) -> list[tuple[str, str, int]]:
    """(rule, name, line) of objects given to ``.json()`` or ``.send()`` of a response."""
    out: list[tuple[str, str, int]] = []
    for opened in order:
        j = _callee(t, opened)
        if not t.is_word(j) or t.text[j] not in ("json", "send") or t.at(j - 1) not in (".", "?."):
            continue
        owner = j - 2
        if t.at(owner) == ")" and t.pair[owner] >= 0:
            inner = _callee(t, t.pair[owner])
            owner = inner - 2 if t.is_word(inner) and t.at(inner - 1) in (".", "?.") else -1
        if not t.is_word(owner) or t.text[owner] not in RESPONSE_NAMES or t.at(owner - 1) in (".", "?."):
            continue
        args = t.parts(opened)
        if not args:
            continue
        a, b = args[0]
        rule, brace = "ts_res_json", t.literal(a, b)
        if brace < 0 and b - a == 1 and t.is_word(a):
            rule, brace = "ts_res_json_var", scopes.resolve(a)
        if brace >= 0:
            out.extend((rule, name, t.line(k)) for name, k in object_fields(t, brace))
    return out


def _bindings(t: Tokens, bracket: int) -> list[tuple[str, int]]:
    """(key, token) of all elements of a binding pattern, nested ones too."""
    out, todo = [], [bracket]
    while todo:
        at = todo.pop()
        keyed = t.text[at] == "{"
        for a, b in t.parts(at):
            first = a
            if t.at(a) == "...":
                a += 1
            if a >= b:
                continue
            if keyed and t.at(a + 1) == ":" and a + 2 < b:
                out.append((t.text[a], first))
                target = a + 2
            elif keyed and t.at(a) == "[" and t.pair[a] > a and t.at(t.pair[a] + 1) == ":":
                out.append((t.source[t.pos[a]:t.pos[t.pair[a]] + 1], first))
                target = t.pair[a] + 2
            else:
                target = a
                if t.is_word(a):
                    out.append((t.text[a], first))
            if target < b and t.at(target) in ("{", "[") and t.pair[target] > target:
                todo.append(target)
    return out


def read_facts(t: Tokens, scopes: Scopes, lists: dict[int, int]) -> list[tuple[str, str, int]]:
    """(rule, name, line): property accesses by the start of their expression, then binding elements."""
    typed = bytearray(len(t) + 1)
    for a, b in type_ranges(t, lists):
        if b > a and not typed[a]:
            typed[a:b] = b"\1" * (min(b, len(t)) - a)
    found = []
    for i in range(2, len(t)):
        if t.kind[i] == "word" and t.at(i - 1) in (".", "?.") and not typed[i]:
            owner = t.text[i - 2]
            operand = t.kind[i - 2] != "op" or owner in (")", "]", "}", "!")
            if operand and not (owner in ("import", "new") and t.at(i - 3) not in (".", "?.")):
                found.append((t.start[i], i))
    out = [("ts_property", t.text[i], t.line(s)) for s, i in sorted(found)]
    keys = [k for p in scopes.patterns for k in _bindings(t, p)]
    return out + [("ts_destructure", name, t.line(i)) for name, i in sorted(keys, key=lambda x: x[1])]


def dynamic_line(t: Tokens) -> int:
    """Line of the first read with a non-literal bracket key, or 0."""
    for i in range(1, len(t) - 2):
        if t.at(i) == "[" and t.pair[i] == i + 2 and t.is_word(i + 1) and t.ends_operand(i - 1):
            return t.line_at(t.pos[i - 1] + len(t.text[i - 1]) - 1)
    return 0


def scan_file(text: str, is_read) -> list[tuple[str, str, str, str, int]]:
    """(ext, side, rule, name, line) facts of one text, each extractor's first per dedup key.
    ``is_read`` tells whether a name can be a read field."""
    t = Tokens(text)
    lists = parameter_lists(t)
    scopes, order = Scopes(t, lists), calls(t)
    out, seen = [], set()

    def add(ext: str, side: str, facts, by_line: bool) -> None:
        for rule, name, line in facts:
            key = (ext, name, line if by_line else 0)
            if key not in seen:
                seen.add(key)
                out.append((ext, side, rule, name, line))

    add("ts_request_defs", "request", request_facts(t, scopes, order), True)
    add("ts_response_defs", "response", response_facts(t, scopes, order), False)
    add("ts_reads", "response", (f for f in read_facts(t, scopes, lists) if is_read(f[1])), False)
    line = dynamic_line(t)
    if line:
        add("ts_dynamic", "response", [("ts_dynamic", "", line)], False)
    return out
