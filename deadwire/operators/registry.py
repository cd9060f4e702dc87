"""Rule registry (X1): languages and extractors as rows, looked up when the plan of an extraction is built.

A language is a suffix pattern, a rank (the first backend file of an endpoint is that of the lowest rank) and openers
of brace-balanced bodies. An extractor is a function of a file's columns that returns an array of facts
(``rules_py.fact``). ``RULES`` holds the built-in rows; ``RULES.with_rows(..)`` makes a registry with more, which
``extract`` and ``Analysis.of`` take::

    ruby = Language("ruby", r"\\.rb$", 4)
    defs = Extractor("ruby", "def", "ruby_defs", lambda f: ..., answers_endpoint=True, answers_global=True)
    Analysis.of(spark, files, rules=RULES.with_rows([ruby], [defs]))
"""
from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from deadwire.operators import rules_go, rules_java, rules_py


class FileColumns(NamedTuple):
    """What an extractor may use of a file: its text, the bodies of its language, Go structs and declared types."""
    content: Column
    found: Column
    sts: Column
    types: Column


@dataclass(frozen=True)
class Language:
    """``bodies``: rule -> (opener, substring that every match holds), as ``functions.text.bodies`` takes them.
    ``body_tests``: rule -> which of the matches count."""
    name: str
    suffix: str
    rank: int
    bodies: dict[str, tuple[str, str]] = field(default_factory=dict, hash=False)
    body_tests: dict[str, Callable] = field(default_factory=dict, hash=False)


@dataclass(frozen=True)
class Extractor:
    """``kind``: def, read or flag. ``by_line``: facts are distinct by (name, line), else by name. ``answers_endpoint``: its
    facts are the response fields of the endpoints that its files serve; ``answers_global``: they count in the
    global pass. ``fn`` is None for what the TypeScript scanner finds itself."""
    lang: str
    kind: str
    ext: str
    fn: Callable[[FileColumns], Column] | None
    by_line: bool = True
    answers_endpoint: bool = False
    answers_global: bool = False


@dataclass(frozen=True)
class Rules:
    languages: tuple[Language, ...]
    extractors: tuple[Extractor, ...]

    def with_rows(self, languages: Iterable[Language] = (), extractors: Iterable[Extractor] = ()) -> Rules:
        """A registry with more rows. Names of languages and extractors may not be taken already."""
        out = replace(self, languages=(*self.languages, *languages), extractors=(*self.extractors, *extractors))
        for names in ([lang.name for lang in out.languages], [x.ext for x in out.extractors]):
            if len(set(names)) < len(names):
                raise ValueError("a name of the registry is taken twice")
        unknown = {x.lang for x in out.extractors} - {lang.name for lang in out.languages}
        if unknown:
            raise ValueError(f"extractors of unknown languages: {sorted(unknown)}")
        return out

    def lang_of(self, path: Column) -> Column:
        """Language of a path, null for anything else."""
        out = F.lit(None).cast("string")
        for lang in reversed(self.languages):
            out = F.when(path.rlike(lang.suffix), lang.name).otherwise(out)
        return out

    def rank_of(self, lang: Column) -> Column:
        ranks = F.create_map(*(F.lit(v) for x in self.languages for v in (x.name, x.rank)))
        return F.element_at(ranks, lang)

    def endpoint_defs(self) -> list[tuple[str, str]]:
        """(language, ext) of the extractors whose facts are an endpoint's response fields."""
        return [(x.lang, x.ext) for x in self.extractors if x.answers_endpoint]

    def global_defs(self) -> list[str]:
        return [x.ext for x in self.extractors if x.answers_global]


RULES = Rules(
    (Language("ts", r"\.[jt]sx?$", 0),
     Language("py", r"\.py$", 1, rules_py.BODY_RULES, rules_py.BODY_TESTS),
     Language("java", r"\.java$", 2, rules_java.BODY_RULES),
     Language("go", r"\.go$", 3, rules_go.BODY_RULES)),
    (Extractor("py", "def", "py_defs", lambda f: rules_py.py_defs(f.content, f.found), True, True, True),
     Extractor("py", "read", "py_reads", lambda f: rules_py.py_reads(f.content)),
     Extractor("java", "def", "java_defs", lambda f: rules_java.java_defs(f.content, f.found), answers_global=True),
     Extractor("java", "read", "java_reads", lambda f: rules_java.java_reads(f.content, f.found)),
     Extractor("go", "def", "go_defs", lambda f: rules_go.go_defs(f.content, f.found, f.sts, f.types), True, True, True),
     Extractor("go", "read", "go_reads", lambda f: rules_go.go_reads(f.content, f.sts, f.types)),
     Extractor("ts", "def", "ts_request_defs", None),
     Extractor("ts", "def", "ts_response_defs", None, False, True, True),
     Extractor("ts", "read", "ts_reads", None, False),
     Extractor("ts", "flag", "ts_dynamic", None, False)))
