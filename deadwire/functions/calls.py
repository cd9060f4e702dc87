"""Calls and routes whose patterns look ahead without a bound (E2, E8, E10), found in linear time.

Each of the three patterns is a head followed by something lazy: a quote or comma after which the rest fits. Written
as one regular expression, every head searches the rest of the line or of the file anew, and a long chain of calls
is one level of recursion per call. Here the places that can end a head are listed once per file, and a head
takes the first of them behind it by binary search.

This runs in Arrow batches inside the scan stage, on the files that hold a head.
"""
from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: pieces of the detector patterns ------------------------------
ROUTE_HEAD = re.compile(r"(?:router|app)\.route\(['\"`]")
SEGMENT = re.compile(r"\.([a-z]+)\([^)]*\)\s*", re.ASCII)
VERB = re.compile(r"\.(get|post|put|delete|patch)\(")
FETCH_HEAD = re.compile(r"fetch\(['\"`]")
DO_FETCH_HEAD = re.compile(r"this\.doFetch(?:WithResponse)?")
ROUTE_END = re.compile(r"['\"`](?=\)\s*)", re.ASCII)
FETCH_END = re.compile(r"['\"`](?=\s*(?:(\))|,\s*(\{)))", re.ASCII)
COMMA_BRACE = re.compile(r",(?=\s*(\{))", re.ASCII)
OPTIONS_END = re.compile(r"\}\s*\)", re.ASCII)
SPACE = re.compile(r"\s*", re.ASCII)
LINE_END = re.compile("[\n\r\u2028\u2029]")
GUARD = r"(?:router|app)\.route\(|fetch\(|this\.doFetch"

FOUND = "array<struct<rule:string,url:string,rest:string>>"


def _after(places: list[int], at: int) -> int | None:
    """The first of ``places`` at ``at`` or behind it."""
    i = bisect_left(places, at)
    return places[i] if i < len(places) else None


class _LastVerbs:
    """Last verb of the chain of calls that starts at a place, with the end of the verb's head."""

    def __init__(self, text: str):
        self.text, self.known = text, {}

    def at(self, place: int) -> tuple[str, int] | None:
        passed = []
        while place not in self.known:
            passed.append(place)
            segment = SEGMENT.match(self.text, place)
            if segment is None:
                verb = VERB.match(self.text, place)  # a call that is never closed ends the chain
                self.known[place] = (verb[1], verb.end()) if verb else None
                passed.pop()
                break
            place = segment.end()
        last = self.known[place]
        for p in reversed(passed):
            if last is None:
                verb = VERB.match(self.text, p)
                last = (verb[1], verb.end()) if verb else None
            self.known[p] = last
        return last


def chained_routes(text: str, breaks: list[int]) -> Iterator[tuple[str, str, str]]:
    """(rule, url, last verb) of ``app.route('url').verb(..).verb(..``"""
    verbs = _LastVerbs(text)
    ends = [(m.start(), v) for m in ROUTE_END.finditer(text)
            if (v := verbs.at(SPACE.match(text, m.end() + 1).end())) is not None]
    places, resume = [e[0] for e in ends], 0
    for head in ROUTE_HEAD.finditer(text):
        at = _after(places, head.end())
        if head.start() < resume or at is None or bisect_left(breaks, head.end()) != bisect_left(breaks, at):
            continue
        verb, resume = ends[bisect_left(places, at)][1]
        yield "chained", text[head.end():at], verb


def fetch_calls(text: str, breaks: list[int], closes: list[int], closed: dict[int, int]) -> Iterator[tuple[str, str, str]]:
    """(rule, url, options or '') of ``fetch('url')`` and ``fetch('url', {options})``"""
    ends = {m.start(): (m.end(1), -1) if m[1] else (-1, m.start(2)) for m in FETCH_END.finditer(text)
            if m[1] or (closes and closes[-1] > m.start(2))}
    places, resume = list(ends), 0
    for head in FETCH_HEAD.finditer(text):
        at = _after(places, head.end())
        if head.start() < resume or at is None or bisect_left(breaks, head.end()) != bisect_left(breaks, at):
            continue
        resume, brace = ends[at]
        options = ""
        if brace >= 0:
            close = closes[bisect_right(closes, brace)]
            options, resume = text[brace:close + 1], closed[close]
        yield "fetch", text[head.end():at], options


def do_fetch_calls(text: str, closes: list[int], closed: dict[int, int]) -> Iterator[tuple[str, str, str]]:
    """(rule, url expression, options) of ``this.doFetch<T>(url, {options})``"""
    commas = {m.start(): m.start(1) for m in COMMA_BRACE.finditer(text) if closes and closes[-1] > m.start(1)}
    places, angles, resume = list(commas), [m.start() for m in re.finditer(">", text)], 0
    for head in DO_FETCH_HEAD.finditer(text):
        at = head.end()
        if text[at:at + 1] == "<":
            angle = _after(angles, at + 2)
            at = len(text) if angle is None or text[at + 1:at + 2] == ">" else angle + 1
        if head.start() < resume or text[at:at + 1] != "(":
            continue
        begin = SPACE.match(text, at + 1).end()
        comma = _after(places, begin)
        if comma is None:
            continue
        close = closes[bisect_right(closes, commas[comma])]
        resume = closed[close]
        yield "do_fetch", text[begin:comma], text[commas[comma]:close + 1]


def calls_of(text: str) -> list[tuple[str, str, str]]:
    breaks = [m.start() for m in LINE_END.finditer(text)]
    closed = {m.start(): m.end() for m in OPTIONS_END.finditer(text)}
    closes = list(closed)
    return [*chained_routes(text, breaks), *fetch_calls(text, breaks, closes, closed), *do_fetch_calls(text, closes, closed)]


def calls(content: Column) -> Column:
    """array<struct<rule, url, rest>> of a file: chained routes with their verb, fetch and doFetch calls with options."""
    @F.pandas_udf(FOUND)
    def find(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else [dict(zip(("rule", "url", "rest"), c)) for c in calls_of(t)] for t in texts],
                         dtype=object)

    return F.coalesce(find(F.when(content.rlike(GUARD), content)), F.array().cast(FOUND))
