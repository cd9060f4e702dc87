"""Chat formatting by schema fingerprints.

A record (JSON) is described by the sorted set of its nested field paths (``messages[].role``);
the hash of that set selects a declarative mapping from its layout to canonical turns. A
mapping is data: which array to walk, where role and text are, or which field is which
role's text. Layouts with optional fields register a fingerprint per variant. A record of
no known layout is returned with the fingerprint and no turns, so it can be counted.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn. Inside roles and texts every ``<|`` gets
a backslash between its characters (one more if there are some already), so a text can
hold control strings and none can be taken for a mark; a role's line ends and
backslashes are escaped too. Both are undone exactly on reading.

The output is one row per turn (its segment and the loss mask as a character span in
it), so a conversation of any length is written and read by many rows; the reader
streams them in order and keeps running digests, not texts.
"""
from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deadwire.llm.common import text_chunks

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
_MARK, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


# -- schema fingerprints -----------------------------------------------------------------

def field_paths(value, at: str = "") -> set[str]:
    """Paths of all leaves; items of arrays share the path ``[]``. Null fields have none."""
    if value is None:
        return set()
    if isinstance(value, dict):
        return set().union(*(field_paths(v, f"{at}.{k}" if at else k) for k, v in value.items()))
    if isinstance(value, list):
        return set().union({f"{at}[]"} if not value else set(), *(field_paths(v, f"{at}[]") for v in value))
    return {at}


def fingerprint(paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Mapping:
    """``items``: the array of turns ('' : the record is one turn) with ``role`` and ``text`` inside;
    or, if ``fields`` is given, (role, field) pairs in turn order. ``first``: (role, field) put before
    ``items``. ``joined``: fields appended to the first user text by a blank line. ``optional``: paths
    that a record may lack. ``also``: paths that may be there and are not used."""
    name: str
    items: str = ""
    role: str = ""
    text: str = ""
    fields: tuple[tuple[str, str], ...] = ()
    first: tuple[tuple[str, str], ...] = ()
    joined: tuple[str, ...] = ()
    optional: tuple[str, ...] = ()
    also: tuple[str, ...] = ()

    def paths(self) -> set[str]:
        base = f"{self.items}[]." if self.items else ""
        own = {base + x for x in (self.role, self.text) if x}
        return own | {f for _, f in (*self.fields, *self.first)} | set(self.joined)

    def fingerprints(self) -> Iterator[str]:
        """Of every variant: without some optional and with some unused paths."""
        full, extra = self.paths(), (*self.optional, *self.also)
        for n in range(len(extra) + 1):
            for flipped in combinations(extra, n):
                yield fingerprint(full ^ set(flipped))


ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}
MAPPINGS: tuple[Mapping, ...] = (
    Mapping("turn row", role="role", text="text", optional=("role", "text")),
    Mapping("messages", items="messages", role="role", text="content",
            optional=("messages[].content",), also=("id",)),
    Mapping("sharegpt", items="conversations", role="from", text="value", first=(("system", "system"),),
            optional=("system", "conversations[].value"), also=("id",)),
    Mapping("instruction", fields=(("system", "system"), ("user", "instruction"), ("assistant", "output")),
            joined=("input",), optional=("system", "input"), also=("id",)),
    Mapping("prompt", fields=(("system", "system"), ("user", "prompt"), ("assistant", "completion")),
            optional=("system",), also=("id",)),
    Mapping("prompt and response", fields=(("user", "prompt"), ("assistant", "response")), also=("id",)),
    Mapping("question", fields=(("user", "question"), ("assistant", "answer")), joined=("context",),
            optional=("context",), also=("id",)),
)


def registry(mappings: tuple[Mapping, ...] = MAPPINGS) -> dict[str, Mapping]:
    return {f: m for m in reversed(mappings) for f in m.fingerprints()}


def _string(value) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def turns_of(record, mapping: Mapping) -> list[tuple[str, str]]:
    """Canonical (role, text) turns of a record, as its mapping says."""
    out = [(role, _string(record[f])) for role, f in mapping.first if record.get(f) is not None]
    if mapping.fields:
        out += [(role, _string(record[f])) for role, f in mapping.fields if record.get(f) is not None]
    else:
        for item in record.get(mapping.items) or [] if mapping.items else [record]:
            role = _string(item.get(mapping.role))
            out.append((ROLES.get(role, role), _string(item.get(mapping.text))))
    more = [_string(record[f]) for f in mapping.joined if record.get(f)]
    if more:
        at = next((i for i, (role, _) in enumerate(out) if role == "user"), None)
        if at is not None:
            out[at] = ("user", "\n\n".join([out[at][1], *more]))
    return out


def canonical_turns(records: DataFrame, record: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """``records`` without ``record`` (a JSON object per row), with ``layout``, ``fingerprint``, ``seq``, ``role`` and
    ``turn_text``: a row per turn. What is no JSON object or of no known layout gives one row
    with null layout and turn."""
    add = ["layout", "fingerprint", "seq", "role", "turn_text"]
    rest = [c for c in records.columns if c not in {record, *add}]
    known = registry(mappings)

    def one(raw: str | None) -> tuple[str | None, str | None, list]:
        try:
            value = json.loads(raw) if raw is not None else None
        except ValueError:
            return None, None, []
        if not isinstance(value, dict):
            return None, None, []
        print_ = fingerprint(field_paths(value))
        mapping = known.get(print_)
        return (mapping.name, print_, turns_of(value, mapping)) if mapping else (None, print_, [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(len(rest))
            for a, b in text_chunks(column):
                owner: list[int] = []
                rows: list[tuple] = []
                for i, raw in enumerate(column.slice(a, b - a).to_pylist()):
                    layout, print_, turns = one(raw)
                    for seq, (role, text) in enumerate(turns or [(None, None)]):
                        owner.append(a + i)
                        rows.append((layout, print_, seq, role, text))
                made = list(zip(*rows))
                kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i).take(pa.array(owner)) for i in range(len(rest))]
                    + [pa.array(x, k) for x, k in zip(made, kinds)], names=[*rest, *add])

    schema = records.select(*rest).schema
    for name, kind in zip(add, ("string", "string", "integer", "string", "string")):
        schema = schema.add(name, kind)
    return records.select(*rest, record).mapInArrow(run, schema)


# -- the template --------------------------------------------------------------------------

def escape(text: str) -> str:
    return _MARK.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def _escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def format_turn(role: str, text: str, learn: bool) -> tuple[str, int, int]:
    """(segment, start, end): the turn under the template and its loss span in characters."""
    head, body = f"{OPEN}{_escape_role(role)}\n", escape(text)
    at = len(head)
    return head + body + CLOSE, at if learn else 0, at + len(body) if learn else 0


def parse_turn(segment: str) -> tuple[str, str]:
    """(role, text) of a segment; an error if it is none."""
    if not segment.startswith(OPEN) or not segment.endswith(CLOSE) or segment.count(OPEN) != 1:
        raise ValueError("not a turn of this template")
    role, text = segment[len(OPEN):-len(CLOSE)].split("\n", 1)
    return _unescape_role(role), unescape(text)


def format_chat(turns: DataFrame, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """turns(..., role, turn_text) -> the other columns with (segment, loss_start, loss_end). Null role or
    text: empty. Only texts of the roles in ``learn`` are under the loss mask."""
    add = ["segment", "loss_start", "loss_end"]
    rest = [c for c in turns.columns if c not in {"role", "turn_text", *add}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in text_chunks(batch.column(len(rest) + 1)):
                roles, texts = (batch.column(len(rest) + k).slice(a, b - a).to_pylist() for k in (0, 1))
                made = list(zip(*(format_turn(r or "", t or "", r in learn) for r, t in zip(roles, texts))))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i).slice(a, b - a) for i in range(len(rest))]
                    + [pa.array(x, k) for x, k in zip(made, (pa.string(), pa.int64(), pa.int64()))],
                    names=[*rest, *add])

    schema = turns.select(*rest).schema.add("segment", "string").add("loss_start", "long").add("loss_end", "long")
    return turns.select(*rest, "role", "turn_text").mapInArrow(run, schema)


def read_digests(segments: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(key, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of written segments.

    Each conversation's rows are streamed in ``order`` through running hashes; a task holds one
    batch, however long a conversation is. Rows with a null key are one conversation; rows that
    tie in ``order`` follow by whatever column stands last in it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None

        def result(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows))
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[0], key_type), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()),
                 pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.string()), pa.array(cols[5], pa.int64())],
                names=[key, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        def finish() -> tuple:
            return now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]

        for batch in batches:
            key_type, done = batch.column(0).type, []
            for name, segment, start, end in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if state is None or name != now:
                    if state is not None:
                        done.append(finish())
                    now, state = name, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = parse_turn(segment)
                learned = unescape(segment[start:end])
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(learned)
                state[3].update(learned.encode())
                state[4] += len(segment)
            if done:
                yield result(done)
        if state is not None:
            yield result([finish()])

    kind = segments.schema[key].dataType.simpleString()
    by = [F.col(key).asc_nulls_first(), *(F.col(c).asc_nulls_first() for c in order)]
    return (segments.repartition(key).sortWithinPartitions(*by)
            .select(key, "segment", "loss_start", "loss_end")
            .mapInArrow(run, f"`{key}` {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
                             "formatted_chars long"))
