"""Accuracy evaluation (G8, G9, J10) of the diff against known dead fields.

Per project (= repo): defined and accessed facts chosen by backend language
(python / go / ts backends: backend response definitions vs frontend reads;
java: frontend request bodies vs backend reads), the diff, then true/false
positives and false negatives against the expected names. Precision and
recall of 0/0 count as 1.0; the micro ratio also maps 0 to 1.0, as the
original evaluation does.

``protect_dynamic`` (off by default, D1): a project whose frontend reads a
response with a non-literal bracket key (``data[key]``) reports nothing.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deadwire.operators.diff import compute_diff

DYNAMIC_ACCESS = r"[\w$\])]\s*\[\s*[A-Za-z_$][\w$]*\s*\]"


def project_facts(facts: DataFrame, files: DataFrame):
    """(defined, accessed) per repo from the fact table."""
    be_lang = (files.filter(F.col("path").contains("backend/"))
               .groupBy("repo").agg(F.min("lang").alias("be_lang")))
    # one row per name before the join on the repo, which is all that a score needs
    f = facts.select("repo", "ext", "name").distinct().join(be_lang, "repo")
    is_java = F.col("be_lang") == "java"
    defined = f.filter((~is_java & F.col("ext").isin("py_defs", "go_defs", "ts_response_defs"))
                       | (is_java & (F.col("ext") == "ts_request_defs")))
    accessed = f.filter((~is_java & (F.col("ext") == "ts_reads")) | (is_java & (F.col("ext") == "java_reads")))
    return defined, accessed


def evaluate(facts: DataFrame, files: DataFrame, expected: DataFrame,
             protect_dynamic: bool = False, with_names: bool = False) -> DataFrame:
    """project_eval(repo, tp, fp, fn, precision, recall) and, with
    ``with_names``, the sorted expected and detected name lists (only for
    small projects: a list holds every finding of a repo)."""
    defined, accessed = project_facts(facts, files)
    return evaluate_sets(defined, accessed, expected, files if protect_dynamic else None, with_names)


def evaluate_precomputed(precomputed: DataFrame, expected: DataFrame) -> DataFrame:
    """The same scoring over precomputed ``{defined, accessed}`` facts (S6),
    for projects evaluated without running extraction."""
    d = precomputed.filter(F.col("kind") == "def")
    a = precomputed.filter(F.col("kind") == "read")
    return evaluate_sets(d, a, expected)


def evaluate_sets(defined: DataFrame, accessed: DataFrame, expected: DataFrame,
                  files: DataFrame | None = None, with_names: bool = False) -> DataFrame:
    """Score per repo; ``files`` given turns on the dynamic-access guard."""
    protect_dynamic = files is not None
    dead = compute_diff(defined, accessed, ["repo"]).select("repo", "name").distinct()
    if protect_dynamic:
        dyn = (files.filter(F.col("path").contains("frontend/") & F.col("content").rlike(DYNAMIC_ACCESS))
               .select("repo").distinct())
        dead = dead.join(dyn, "repo", "left_anti")
    truth = expected.select("repo", F.explode("dead_fields").alias("name")).distinct()
    both = dead.withColumn("d", F.lit(True)).join(truth.withColumn("e", F.lit(True)), ["repo", "name"], "full")
    aggs = [F.count_if(F.col("d") & F.col("e")).alias("tp"),
            F.count_if(F.col("d") & F.col("e").isNull()).alias("fp"),
            F.count_if(F.col("d").isNull() & F.col("e")).alias("fn")]
    if with_names:
        aggs += [F.sort_array(F.collect_list(F.when(F.col("e"), F.col("name")))).alias("expected"),
                 F.sort_array(F.collect_list(F.when(F.col("d"), F.col("name")))).alias("detected")]
    per = both.groupBy("repo").agg(*aggs)
    projects = expected.select("repo").distinct()
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    out = projects.join(per, "repo", "left")
    names = ([F.coalesce("expected", F.array().cast("array<string>")).alias("expected"),
              F.coalesce("detected", F.array().cast("array<string>")).alias("detected")]
             if with_names else [])
    return out.select(
        "repo", *names,
        z("tp").alias("tp"), z("fp").alias("fp"), z("fn").alias("fn"),
        F.coalesce(F.try_divide(z("tp"), z("tp") + z("fp")), F.lit(1.0)).alias("precision"),
        F.coalesce(F.try_divide(z("tp"), z("tp") + z("fn")), F.lit(1.0)).alias("recall"))


def in_project_order(project_eval: DataFrame) -> DataFrame:
    """One row per project in the order of their names (O-2)."""
    return project_eval.orderBy("repo")


def overall(project_eval: DataFrame) -> DataFrame:
    """Macro averages and micro ratios over projects."""
    micro = lambda num, den: F.coalesce(
        F.nullif(F.try_divide(F.sum(num), F.sum(den)), F.lit(0.0)), F.lit(1.0))
    return project_eval.agg(
        F.count("*").alias("projects"),
        F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"),
        F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"),
        micro(F.col("tp"), F.col("tp") + F.col("fp")).alias("micro_precision"),
        micro(F.col("tp"), F.col("tp") + F.col("fn")).alias("micro_recall"))
