"""Corpus sources and sinks.

* ``scan_corpus``   S1-S3: whole-file text read of a directory tree (one row per
                    file), extension filter, excluded directories, language tag,
                    optional ``.d.ts`` exclusion, ``repo`` from the first path
                    component under the root (or one fixed name).
* ``write_report``  S4: the nested JSON report, built with ``collect_list`` per
                    repo only at the edge, plus parquet fact tables.
* ``read_expected`` S5: ground truth ``{endpoint, deadFields}`` JSON files.
* ``read_precomputed_fields`` S6: ``{defined, accessed}`` JSON files that stand in
                    for extraction.
"""
from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from deadwire.operators.registry import RULES, Rules

# Included extensions and excluded directory names (the union of
# the editor command's, the command-line scanner's and the package defaults).
EXTENSIONS = ["ts", "tsx", "js", "jsx", "py", "java", "go"]
EXCLUDED_DIRS = ["node_modules", "dist", "build", ".git", "coverage", "target", ".next",
                 "__pycache__", "vendor", ".venv", "venv"]


def lang_of(path: Column, rules: Rules = RULES) -> Column:
    """Language tag from the extension; null for anything else."""
    return rules.lang_of(path)


def scan_corpus(spark: SparkSession, root: str, repo: str | None = None,
                include_dts: bool = True, exclude_dirs: list[str] | None = None, rules: Rules = RULES,
                extensions: list[str] | None = None) -> DataFrame:
    """files(repo, path, lang, content) for every source file under ``root``; ``extensions`` and
    ``rules`` where languages were added.

    Paths are relative to ``root`` (to its part before the first glob character, so ``/x/*`` gives the
    paths and repos of ``/x``). Each file is one row (``wholetext``), so a
    task reads whole files and no file is split across tasks. For trees of
    many small files lower ``spark.sql.files.openCostInBytes`` so a task
    packs more of them; for a whole corpus prefer ``read_corpus_table``."""
    ex = exclude_dirs if exclude_dirs is not None else EXCLUDED_DIRS
    raw = (spark.read.format("text")
           .option("wholetext", True)
           .option("recursiveFileLookup", True)
           .option("pathGlobFilter", "*.{" + ",".join(extensions or EXTENSIONS) + "}")
           .load(root)
           .select(F.col("_metadata.file_path").alias("abs"), F.col("value").alias("content")))
    # the part of the root before any glob character; paths are relative to it
    base = _local_path(re.split(r"[*?\[{]", root)[0].rpartition("/")[0] if re.search(r"[*?\[{]", root) else root)
    plain = F.url_decode(F.replace(F.regexp_replace("abs", _SCHEME, ""), F.lit("+"), F.lit("%2B")))
    rel = F.when(plain.startswith(base + "/"), F.substring(plain, len(base) + 2, 1 << 30)).otherwise(plain)
    df = raw.select(rel.alias("path"), "content")
    if ex:
        df = df.filter(~F.col("path").rlike("(^|/)(" + "|".join(_re_escape(d) for d in ex) + ")/"))
    if not include_dts:
        df = df.filter(~F.col("path").endswith(".d.ts"))
    repo_col = F.lit(repo) if repo else F.split_part(F.col("path"), F.lit("/"), F.lit(1))
    return df.select(repo_col.alias("repo"), "path", lang_of(F.col("path"), rules).alias("lang"), "content") \
             .filter(F.col("lang").isNotNull())


def read_corpus_table(spark: SparkSession, path: str, content_col: str = "content") -> DataFrame:
    """files(repo, path, lang, content) from a corpus stored as a table
    (parquet with repo, path and the file text). At corpus scale this is the
    input to use: billions of loose files make listing and per-file open
    costs, not analysis, the bottleneck; a table is split by row groups."""
    t = spark.read.parquet(path)
    return t.select("repo", "path", lang_of(F.col("path")).alias("lang"),
                    F.col(content_col).alias("content")) \
            .filter(F.col("lang").isNotNull())


_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"


def _local_path(root: str) -> str:
    """The root as it stands in file URIs: without scheme and authority, absolute, no slash at the end."""
    bare = re.sub(_SCHEME, "", root)
    return (bare if bare != root or root.startswith("/") else os.path.abspath(root)).rstrip("/")


def _re_escape(s: str) -> str:
    return re.escape(s)


def _documents(spark: SparkSession, path: str, name: str) -> DataFrame:
    """docs(repo, path, content): whole files ``<repo>/<name>``."""
    raw = spark.read.format("text").option("wholetext", True).load(path)
    file = F.col("_metadata.file_path")
    return raw.select(F.regexp_extract(file, rf"([^/]+)/{re.escape(name)}$", 1).alias("repo"), file.alias("path"),
                      F.col("value").alias("content"))


def _parsed(docs: DataFrame, schema: str, needed: list[str]) -> DataFrame:
    """``docs`` with the struct ``doc`` and ``bad``: a document that is no JSON, has a field of another type than it should,
    or lacks a needed one (D16: bad documents yield nothing and are counted)."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    doc = F.from_json(F.col("content"), f"{schema}, _corrupt string", options)
    lacks = F.coalesce(*(F.when(F.col(f"doc.{c}").isNull(), True) for c in needed), F.lit(False))
    return docs.select("repo", "path", doc.alias("doc")).withColumn(
        "bad", F.col("doc").isNull() | F.col("doc._corrupt").isNotNull() | lacks)


def parse_expected(docs: DataFrame) -> DataFrame:
    """docs(repo, path, content) -> (repo, path, bad, endpoint, dead_fields), a row per document."""
    made = _parsed(docs, "endpoint string, deadFields array<string>", ["endpoint", "deadFields"])
    good = lambda c: F.when(~F.col("bad"), F.col(c))
    return made.select("repo", "path", "bad", good("doc.endpoint").alias("endpoint"), good("doc.deadFields").alias("dead_fields"))


_FIELD = "struct<name:string, side:string, definedAt:string, wasteScore:double>"


def parse_precomputed(docs: DataFrame) -> DataFrame:
    """docs(repo, path, content) -> (repo, path, bad, facts: array<struct<kind, name, side, path, line>>), a row per
    document (S6); ``definedAt`` is split at its last ':'. A list may be missing, not both."""
    made = _parsed(docs, f"defined array<{_FIELD}>, accessed array<{_FIELD}>", []).withColumn(
        "bad", F.col("bad") | (F.col("doc.defined").isNull() & F.col("doc.accessed").isNull()))
    place = r"^(.*):([0-9]+)$"

    def facts(column: str, kind: str) -> Column:
        listed = F.coalesce(F.col(f"doc.{column}"), F.array().cast(f"array<{_FIELD}>"))
        return F.transform(listed, lambda f: F.struct(
            F.lit(kind).alias("kind"), f["name"].alias("name"), f["side"].alias("side"),
            F.nullif(F.regexp_extract(f["definedAt"], place, 1), F.lit("")).alias("path"),
            F.nullif(F.regexp_extract(f["definedAt"], place, 2), F.lit("")).cast("int").alias("line")))

    none = F.array().cast("array<struct<kind:string,name:string,side:string,path:string,line:int>>")
    return made.select("repo", "path", "bad", F.when(F.col("bad"), none).otherwise(
        F.concat(facts("defined", "def"), facts("accessed", "read"))).alias("facts"))


def accounting(parsed: DataFrame, observation: Observation | None = None) -> DataFrame:
    """(repo, n_parsed, n_bad): documents of each repo that could and could not be used (D16). ``observation`` gets both
    totals of the run that reads ``parsed``, without a pass of its own."""
    good, bad = F.count_if(~F.col("bad")).alias("n_parsed"), F.count_if("bad").alias("n_bad")
    if observation is not None:
        parsed = parsed.observe(observation, good, bad)
    return parsed.groupBy("repo").agg(good, bad)


def read_expected(spark: SparkSession, path: str) -> DataFrame:
    """expected(repo, endpoint, dead_fields) from ``<repo>/expected.json`` files; bad files are left out (see
    ``parse_expected`` and ``accounting`` for their number)."""
    return parse_expected(_documents(spark, path, "expected.json")).where("not bad").select("repo", "endpoint", "dead_fields")


def read_precomputed_fields(spark: SparkSession, path: str) -> DataFrame:
    """facts(repo, kind, name, side, path, line) from ``<repo>/fields.json`` files with
    ``{defined: [Field], accessed: [Field]}``; bad files yield none."""
    made = parse_precomputed(_documents(spark, path, "fields.json"))
    return made.select("repo", F.inline("facts"))


def write_report(analysis, out_dir: str) -> None:
    """Fact tables as parquet (partitioned by language where it has one) and the report as
    line-delimited JSON: ``endpoints`` (a line per endpoint with the sizes of its lists, in
    locale-aware pattern order) and a child document per list: ``frontendFiles``, ``definedFields``,
    ``accessedFields``, ``deadFields`` and, for the global fallback, ``global``. A list that grows with the
    corpus (all callers of one hot endpoint, say) is rows of a child document, never one row."""
    a = analysis
    a.facts.write.mode("overwrite").partitionBy("lang").parquet(f"{out_dir}/facts")
    a.endpoints().write.mode("overwrite").parquet(f"{out_dir}/endpoints")
    a.dead_fields().write.mode("overwrite").parquet(f"{out_dir}/dead_fields")
    a.global_dead().write.mode("overwrite").partitionBy("lang").parquet(f"{out_dir}/global_dead")
    at = F.concat_ws(":", "path", F.col("line").cast("string")).alias("definedAt")
    waste = F.col("waste_score").alias("wasteScore")
    defined, accessed = a.field_sets()
    lists = {
        "frontendFiles": a.callers().select("repo", "pattern", "path"),
        "definedFields": defined.select("repo", "pattern", "name", "side", at),
        "accessedFields": accessed.select("repo", "pattern", "name"),
        "deadFields": a.dead_fields().select("repo", "pattern", "name", "side", at, waste),
        "global": a.global_dead().select("repo", "lang", "name", "side", at, waste),
    }
    for name, rows in lists.items():
        rows.write.mode("overwrite").json(f"{out_dir}/report/{name}")
    (a.report_endpoints().orderBy(F.collate(F.col("pattern"), "UNICODE"), "repo")
     .select("repo", "pattern", "method", F.coalesce("backend_file", F.lit("")).alias("backendFile"),
             F.col("n_frontend").alias("frontendFiles"), F.col("n_defined").alias("definedFields"),
             F.col("n_accessed").alias("accessedFields"), F.col("n_dead").alias("deadFields"), waste)
     .write.mode("overwrite").json(f"{out_dir}/report/endpoints"))
