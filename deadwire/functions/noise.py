"""Names that are never API payload fields, per language and rule kind.

Fixed values: these word lists must equal the analysed tool's lists for the
results to agree. They are stated plainly, in their original order, grouped the
way the tool groups them. Duplicates inside a list are harmless (set semantics).

Predicates are literals of the extraction stage (no join): a hash set in the TypeScript scanner, a
literal array in the column predicates of the other languages.
"""
from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: TypeScript property reads -------------------------------
TS_READ_NOISE_GROUPS = {
    "javascript builtins": (
        "length", "push", "pop", "shift", "unshift", "splice", "slice", "concat", "join", "indexOf",
        "lastIndexOf", "find", "findIndex", "filter", "map", "reduce", "reduceRight", "forEach", "some",
        "every", "flat", "flatMap", "includes", "keys", "values", "entries", "sort", "reverse", "fill",
        "copyWithin", "at", "toString", "toLocaleString", "valueOf", "hasOwnProperty", "isPrototypeOf",
        "propertyIsEnumerable", "constructor", "then", "catch", "finally", "resolve", "reject", "all",
        "allSettled", "race", "any", "call", "apply", "bind", "prototype", "arguments", "caller", "assign",
        "create", "defineProperty", "defineProperties", "freeze", "seal", "getOwnPropertyNames",
        "getOwnPropertyDescriptor", "getPrototypeOf", "keys", "fromEntries", "entries", "is", "isFrozen",
        "isSealed", "setPrototypeOf", "parse", "stringify", "from", "of", "isArray", "isInteger", "isFinite",
        "isNaN", "parseInt", "parseFloat", "trim", "trimStart", "trimEnd", "padStart", "padEnd", "startsWith",
        "endsWith", "replace", "replaceAll", "split", "match", "matchAll", "search", "charAt", "charCodeAt",
        "codePointAt", "normalize", "repeat", "substring", "toLowerCase", "toUpperCase", "toLocaleLowerCase",
        "toLocaleUpperCase",
    ),
    "dom and browser apis": (
        "addEventListener", "removeEventListener", "dispatchEvent", "preventDefault", "stopPropagation",
        "target", "currentTarget", "srcElement", "type", "bubbles", "getElementById", "getElementsByClassName",
        "getElementsByTagName", "querySelector", "querySelectorAll", "createElement", "createTextNode",
        "appendChild", "removeChild", "insertBefore", "replaceChild", "cloneNode", "setAttribute",
        "getAttribute", "removeAttribute", "classList", "style", "innerText", "innerHTML", "textContent",
        "value", "checked", "disabled", "hidden", "focus", "blur", "click", "submit", "reset",
        "scrollIntoView", "getBoundingClientRect", "location", "href", "pathname", "search", "hash", "host",
        "hostname", "origin", "port", "history", "pushState", "replaceState", "back", "forward", "go",
        "localStorage", "sessionStorage", "getItem", "setItem", "removeItem", "clear", "setTimeout",
        "setInterval", "clearTimeout", "clearInterval", "requestAnimationFrame", "fetch", "Request",
        "Response", "Headers", "body", "headers", "method", "credentials", "mode", "cache", "redirect",
        "referrer", "integrity", "signal", "statusText", "json", "text", "blob", "arrayBuffer", "formData",
        "clone",
    ),
    "node and express": (
        "use", "get", "post", "put", "delete", "patch", "route", "listen", "close", "send", "json", "render",
        "redirect", "next", "end", "write", "writeHead", "setHeader", "getHeader", "removeHeader", "pipe",
        "emit", "on", "once", "off", "createServer", "createReadStream", "createWriteStream", "readFile",
        "writeFile", "readdir", "mkdir", "stat", "unlink", "join", "resolve", "dirname", "basename", "env",
        "argv", "exit", "cwd", "chdir", "platform", "arch", "version",
    ),
    "http and fetch internals": (
        "has", "append", "set", "delete", "get", "getAll", "forEach", "entries", "keys", "values",
    ),
    "state management": (
        "dispatch", "getState", "subscribe", "replaceReducer", "observable", "createStore", "combineReducers",
        "applyMiddleware", "compose", "createAction", "createReducer", "createSlice", "createAsyncThunk",
        "createSelector", "createEntityAdapter",
    ),
    "react and jsx": (
        "useState", "useEffect", "useRef", "useCallback", "useMemo", "useContext", "useReducer",
        "useLayoutEffect", "useImperativeHandle", "useDebugValue", "render", "setState", "forceUpdate",
        "componentDidMount", "componentDidUpdate", "componentWillUnmount", "shouldComponentUpdate",
        "getDerivedStateFromProps", "getSnapshotBeforeUpdate", "componentDidCatch", "getDerivedStateFromError",
        "createElement", "createRef", "createContext", "forwardRef", "memo", "Fragment", "cloneElement",
        "isValidElement", "Children", "Component", "PureComponent",
    ),
    "common utilities": (
        "log", "warn", "info", "error", "debug", "trace", "group", "groupEnd", "table", "bind", "connect",
        "disconnect", "open", "close", "send", "receive", "encode", "decode", "serialize", "deserialize",
        "format", "parse", "merge", "clone", "deepEqual", "shallowEqual", "isEqual", "isEmpty", "isNil",
    ),
    "compile time only": (
        "prototype", "constructor", "super", "this", "arguments",
    ),
}

# --- fixed values: other languages ------------------------------------------
PY_DEF_NOISE = (
    "model_config", "model_fields", "model_computed_fields", "schema_extra", "validators", "root_validator",
    "Config", "Meta",
)
PY_READ_NOISE = (
    "json", "form", "args", "data", "files", "headers", "method", "url", "session", "db", "request",
    "response", "result", "error", "self", "cls", "app", "g", "current_app", "abort", "redirect",
    "render_template", "make_response", "send_file", "send_from_directory", "flash", "get_flashed_messages",
    "None", "True", "False", "print", "len", "range", "type", "str", "int", "float", "list", "dict", "set",
    "tuple", "bool", "bytes", "object",
)
JAVA_DEF_NOISE = (
    "equals", "hashCode", "toString", "getClass", "notify", "notifyAll", "wait", "clone", "finalize", "log",
    "logger", "serialVersionUID",
)
JAVA_READ_NOISE = (
    "equals", "hashCode", "toString", "getClass", "notify", "notifyAll", "wait", "clone", "finalize", "log",
    "logger", "this", "super", "class", "new", "return", "null", "true", "false",
)
GO_DEF_NOISE = (
    "err", "ok", "ctx", "w", "r", "c", "db", "id", "tx", "nil", "true", "false", "error", "string", "int",
    "bool", "any",
)
GO_READ_NOISE = (
    "err", "ok", "ctx", "w", "r", "c", "db", "id", "tx", "req", "res", "body", "buf", "msg", "key", "val",
    "tmp", "i", "j", "n", "nil", "true", "false", "error", "string", "int", "bool", "any", "http", "json",
    "fmt", "log", "time", "sync", "context",
)


def words(listed: tuple[str, ...]) -> list[str]:
    return sorted(set(listed))


TS_READ_NOISE = sorted({w for g in TS_READ_NOISE_GROUPS.values() for w in g})


def word_array(ws: list[str]) -> Column:
    """Literal array<string> built by the JVM's SQL parser in one call (the
    lists are used inside higher-order functions, where an ``isin`` of many
    literals would cost one driver round trip per word)."""
    return F.expr("array(" + ",".join("'" + w + "'" for w in ws) + ")")


def ts_read_candidate(name) -> Column:
    """A TypeScript read is kept when not a listed name, not an upper-case
    constant and longer than one character."""
    n = F.col(name) if isinstance(name, str) else name
    return (~F.array_contains(word_array(TS_READ_NOISE), n) & ~n.rlike("^[A-Z][A-Z0-9_]+$")
            & (F.length(n) > 1))


_TS_READ_NOISE_SET = frozenset(TS_READ_NOISE)
_UPPER_CASE = re.compile("[A-Z][A-Z0-9_]+")


def is_ts_read(name: str) -> bool:
    """``ts_read_candidate`` for one name, by a hash set."""
    return len(name) > 1 and name not in _TS_READ_NOISE_SET and _UPPER_CASE.fullmatch(name) is None


def _base_noise(n: Column, lst: tuple[str, ...]) -> Column:
    return (F.array_contains(word_array(words(lst)), n) | n.rlike("^[A-Z_][A-Z0-9_]*$")
            | (F.length(n) <= 1))


def is_noise(name, lang: str, kind: str) -> Column:
    """Noise predicate for ``lang`` in {py, java, go} and ``kind`` in {def, read}."""
    n = F.col(name) if isinstance(name, str) else name
    if lang == "py":
        lst = PY_DEF_NOISE if kind == "def" else PY_READ_NOISE
        return _base_noise(n, lst) | n.startswith("__")
    if lang == "java":
        if kind == "def":
            return _base_noise(n, JAVA_DEF_NOISE) | n.rlike("^[A-Z]")
        return _base_noise(n, JAVA_READ_NOISE)
    if lang == "go":
        return _base_noise(n, GO_DEF_NOISE if kind == "def" else GO_READ_NOISE)
    raise ValueError(lang)


def noise_table(spark):
    """The lists as a table ``noise(lang, kind, name)`` for reporting/joins."""
    rows = [("ts", "read", w) for w in TS_READ_NOISE]
    for lang, kind, lst in [("py", "def", PY_DEF_NOISE), ("py", "read", PY_READ_NOISE),
                            ("java", "def", JAVA_DEF_NOISE), ("java", "read", JAVA_READ_NOISE),
                            ("go", "def", GO_DEF_NOISE), ("go", "read", GO_READ_NOISE)]:
        rows += [(lang, kind, w) for w in words(lst)]
    return spark.createDataFrame(rows, "lang string, kind string, name string")
