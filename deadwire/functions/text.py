"""Text primitives for rule-based extraction, built from Spark SQL functions.

Every helper returns a ``Column`` that is evaluated inside the scan stage, so extraction
stays narrow (no shuffle) and no source text leaves the executor it was read on.

* ``scan``        all matches of a regex with their 1-based line numbers.
* ``bodies``      matches of opening-brace regexes with the balanced body after each
                  (the one helper in Python: pairing braces needs a stack).
* ``nl``          number of newlines in a string.

* ``match_offsets`` 0-based start of every match (P6).

Line numbers: a match's line is 1 + the newlines before its start. ``scan`` inserts a marker before every
match with one ``regexp_replace`` and counts markers per line. This is linear in
the text and yields the same matches in the same order as ``regexp_extract_all``
(both drive ``java.util.regex.Matcher.find`` from left to right). The marker is made of
private-use characters, one more in a row than the text holds anywhere, so no text has to be changed.

Offsets: Spark has no match-offset function. ``split`` gives the gaps between matches and
``regexp_extract_all`` the matches; a match starts where the lengths of what stands before it add up to.
"""
from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters of the marker inserted before matches: a run of the first, closed by the second.
MARK, MARK_END = "\ue000", "\ue001"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, fn) -> Column:
    """Evaluate ``value`` once and pass it to ``fn`` as a lambda variable.
    Arrays referenced inside a higher-order function body are otherwise
    re-evaluated per element."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def nl(s) -> Column:
    """Count of '\\n' in ``s``."""
    s = _c(s)
    return F.length(s) - F.length(F.regexp_replace(s, "\n", ""))


def _pat(p) -> Column:
    return F.lit(p) if isinstance(p, str) else p


def match_lines(text, pattern) -> Column:
    """array<int>: 1-based line of each match start, in match order."""
    text = _c(text)

    def marked(mark: Column) -> Column:
        lines = F.split(F.regexp_replace(text, _pat(pattern), F.concat(mark, F.lit("$0"))), "\n", -1)
        return F.flatten(F.transform(lines, lambda l, i: F.array_repeat(i + 1, F.size(F.split(l, mark, -1)) - 1)))

    return let(_marker(text), marked)


def _marker(text: Column) -> Column:
    """A string that cannot be in ``text``, nor arise from putting it anywhere into it."""
    runs = F.transform(F.regexp_extract_all(text, F.lit(f"{MARK}+"), 0), F.length)
    return F.when(text.contains(MARK), F.concat(F.repeat(F.lit(MARK), F.array_max(runs) + 1), F.lit(MARK_END))) \
        .otherwise(MARK + MARK_END)


def running_totals(values: Column) -> Column:
    """array<int>: sums of ``values`` up to and including each. Totals are made in blocks of about the square root of
    their number, so that no array is copied once per element."""
    def totals(block: Column, start: Column) -> Column:
        zero = F.struct(start.cast("int").alias("sum"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(block, zero, lambda a, x: F.struct(
            (a["sum"] + x).alias("sum"), F.concat(a["out"], F.array(a["sum"] + x)).alias("out")), lambda a: a["out"])

    def blocks(v: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.size(v).cast("double"))), F.lit(1)).cast("int")
        last = F.greatest(F.ceil(F.size(v) / width), F.lit(1)).cast("int") - 1
        return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(v, b * width + 1, width))

    def whole(parts: Column) -> Column:
        sums = F.transform(parts, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x))
        return let(F.arrays_zip(parts.alias("part"), sums.alias("sum"), totals(sums, F.lit(0)).alias("to")),
                   lambda z: F.flatten(F.transform(z, lambda x: totals(x["part"], x["to"] - x["sum"]))))

    return let(values, lambda v: let(blocks(v), whole))


def match_offsets(text, pattern) -> Column:
    """array<struct<start:int, line:int, m:string>> of all matches (P6): 0-based offset in code points and 1-based line
    of each match's start. ``pattern`` must not match the empty string."""
    text, pat = _c(text), _pat(pattern)

    def placed(z: Column) -> Column:
        # what lies between the starts of two matches: the former match and the gap behind it
        before = lambda size: F.transform(z, lambda x, i: size(x["gap"]) + F.when(
            i > 0, size(F.element_at(z, F.greatest(i, F.lit(1)))["m"])).otherwise(0))
        out = F.arrays_zip(running_totals(before(F.length)).alias("start"), running_totals(before(nl)).alias("nl"),
                           F.transform(z, lambda x: x["m"]).alias("m"))
        return F.transform(out, lambda x: F.struct(x["start"].alias("start"), (x["nl"] + 1).alias("line"), x["m"].alias("m")))

    hits = F.regexp_extract_all(text, pat, 0)
    gaps = F.split(text, pat, -1)
    return let(F.slice(F.arrays_zip(gaps.alias("gap"), hits.alias("m")), F.lit(1), F.size(hits)), placed)


def scan(text, pattern, groups: dict[str, int] | None = None, guard: str | None = None) -> Column:
    """array<struct<line:int, m:string, <group names>:string>> of all matches.

    ``groups`` maps output names to regex group numbers; a group that did not
    take part in a match yields ''. ``guard`` is a plain substring that every
    match must contain; files without it skip the regex work entirely.
    """
    text = _c(text)
    groups = groups or {}
    pat = _pat(pattern)
    ln = match_lines(text, pat)
    m0 = F.regexp_extract_all(text, pat, 0)
    gs = [F.regexp_extract_all(text, pat, v).alias(k) for k, v in groups.items()]
    out = F.arrays_zip(ln.alias("line"), m0.alias("m"), *gs)
    if guard is not None:
        return F.when(text.contains(guard), out)
    return out


# --- brace-balanced bodies -------------------------------------------------

def body_ends(text: str) -> dict[int, int]:
    """Position of each '{' -> end of its body: its closing brace, or for a brace that is
    never closed the end of the text minus its last character. One pass with a stack.
    Braces inside strings count, as in the rules being reproduced."""
    ends: dict[int, int] = {}
    held: list[int] = []
    for m in re.finditer("[{}]", text):
        if m[0] == "{":
            held.append(m.start())
        elif held:
            ends[held.pop()] = m.start()
    for at in held:
        ends[at] = max(at + 1, len(text) - 1)
    return ends


def find_bodies(text: str, ends: dict[int, int], rule: str, opener: re.Pattern, test=None) -> list[tuple]:
    """(rule, line, matched text, group 1 or '', body) of the matches of ``opener`` that count by ``test`` (a function of
    the text and the lines of its matches). A body that is never closed stops at the next match that counts: the
    rest is in that one's body, so bodies outside one another add up to the text at most."""
    found, lines, line, at = list(opener.finditer(text)), [], 1, 0
    for m in found:
        line += text.count("\n", at, m.start())
        at = m.start()
        lines.append(line)
    counted = list(zip(found, lines))
    if test is not None and counted:
        counted = [x for x, ok in zip(counted, test(text, lines)) if ok]
    out = []
    for i, (m, line) in enumerate(counted):
        begin, end = m.end(), ends[m.end() - 1]
        if text[end:end + 1] != "}" and i + 1 < len(counted):
            end = min(end, counted[i + 1][0].start())
        out.append((rule, line, m[0], (m[1] or "") if opener.groups else "", text[begin:end]))
    return out


#: rule -> (opener, a substring that every match holds), by language
BodyRules = dict[str, dict[str, tuple[str, str]]]
BODIES = "array<struct<rule:string,line:int,m:string,g:string,body:string>>"


def bodies(lang: Column, content: Column, rules: BodyRules, tests: dict | None = None) -> Column:
    """All matches of each rule's opener (a regex ending in an opening brace) of a file's language with the
    brace-balanced body that follows; ``g`` is the opener's group 1.

    Nested openers are all reported, since matching resumes right after each opening brace. Pairing braces
    needs a stack, so this runs in Arrow batches inside the scan stage; text of other languages is not sent.
    ``tests``: rule -> function of (text, lines of its matches) that says which of them count."""
    tests = tests or {}
    compiled = {lg: [(name, re.compile(opener, re.ASCII), guard) for name, (opener, guard) in of.items()]
                for lg, of in rules.items()}

    @F.pandas_udf(BODIES)
    def find(langs: pd.Series, texts: pd.Series) -> pd.Series:
        out = []
        for lg, text in zip(langs, texts):
            hits = [x for x in compiled.get(lg, ()) if text is not None and x[2] in text]
            ends = body_ends(text) if hits else {}
            rows: list[tuple] = []
            for name, opener, _ in hits:
                rows += find_bodies(text, ends, name, opener, tests.get(name))
            out.append([dict(zip(("rule", "line", "m", "g", "body"), b)) for b in rows])
        return pd.Series(out, dtype=object)

    return find(lang, F.when(lang.isin(*rules), content))


def pick(found: Column, rule: str) -> Column:
    """The bodies of one rule."""
    return F.filter(found, lambda b: b["rule"] == rule)
