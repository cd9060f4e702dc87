"""The analysis as Spark plans: registry (J2/G1), field-set assembly (J3),
dead-field diff (J1), global fallback (J4) and rollups (G2-G7).

Shuffle keys: the registry aggregates on (repo, pattern); field sets join
endpoints to facts on (repo, path); the diff anti-joins on
(repo, pattern, name) and the global pass on (repo, name). Read-name sides are
de-duplicated before each anti-join so a hot name costs one row per key, and
AQE splits any skewed partition that is left.
"""
from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deadwire.functions import scalars as S
from deadwire.operators.diff import compute_diff
from deadwire.operators.extract import extract, facts_from_flat, flat_facts, routes_from_flat
from deadwire.operators.order import global_rank
from deadwire.operators.registry import RULES, Rules
from deadwire.session import ensure_checkpoint_dir


def materialize(spark: SparkSession, df: DataFrame, name: str, sort_by: list[str] | None = None,
                written: list[str] | None = None) -> DataFrame:
    """Write ``df`` as parquet under the session's checkpoint folder and read
    it back: cuts lineage so a lost executor does not redo the extraction,
    and lets every downstream query reuse it. ``written`` collects the path."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/deadwire-{name}-{uuid.uuid4().hex[:12]}"
    if sort_by:
        # local sort only (no shuffle): parquet min/max statistics per row
        # group then let filters on the leading column skip row groups
        df = df.sortWithinPartitions(*sort_by)
    df.write.mode("overwrite").parquet(path)
    if written is not None:
        written.append(path)
    return spark.read.parquet(path)


class Analysis:
    """Fact tables of one corpus and the plans built on them.

    With ``persist`` the extraction output and the pipeline's intermediate
    tables (endpoints, callers, dead fields, global dead fields) are written
    once, on first use, under the session's checkpoint folder; every report
    reads them instead of recomputing their lineage."""

    def __init__(self, spark: SparkSession, files: DataFrame, routes: DataFrame, facts: DataFrame,
                 persist: bool = True, protect_dynamic: bool = False, rules: Rules = RULES):
        self.rules = rules
        self.spark, self.files, self.routes, self.facts, self.persist = spark, files, routes, facts, persist
        self.protect_dynamic = protect_dynamic
        self.written: list[str] = []

    @classmethod
    def of(cls, spark: SparkSession, files: DataFrame, persist: bool = True,
           protect_dynamic: bool = False, rules: Rules = RULES) -> "Analysis":
        """``protect_dynamic`` (D1): an endpoint any of whose frontend files
        reads with a non-literal bracket key reports no dead fields."""
        flat = flat_facts(extract(files, rules=rules))
        written: list[str] = []
        if persist:
            # one file per task (no per-extractor directories, which would
            # multiply files by 14 at scale); sorted by ext inside each file
            flat = materialize(spark, flat, "facts", sort_by=["ext", "repo", "path"], written=written)
        # the file rows written with the facts, so that counting files reads no source again
        listed = flat.filter(F.col("ext") == "file").select("repo", "path", "lang")
        out = cls(spark, listed, routes_from_flat(flat, rules), facts_from_flat(flat), persist, protect_dynamic, rules)
        out.written = written
        return out

    def _keep(self, df: DataFrame, name: str) -> DataFrame:
        return materialize(self.spark, df, name, written=self.written) if self.persist else df

    # --- registry --------------------------------------------------------------
    def pattern_routes(self) -> DataFrame:
        return self.routes.select("repo", "path", "lang", "lang_rank", "role",
                                  S.pattern_key(F.col("method"), F.col("url")).alias("pattern"),
                                  "method")

    def endpoints(self) -> DataFrame:
        return self._endpoints

    @cached_property
    def _endpoints(self) -> DataFrame:
        return self._keep(self._endpoints_plan(), "endpoints")

    def _endpoints_plan(self) -> DataFrame:
        """endpoints(repo, pattern, method, backend_file, backend_lang,
        n_frontend, first_frontend). First backend file in (language rank,
        path) order; frontend files counted, not collected."""
        r = self.pattern_routes()
        be = F.when(F.col("role") == "backend", F.struct("lang_rank", "path", "lang"))
        fe = F.when(F.col("role") == "frontend", F.struct("lang_rank", "path"))
        return (r.groupBy("repo", "pattern")
                .agg(F.min(be).alias("be"), F.min(fe).alias("fe"),
                     F.count_distinct(F.when(F.col("role") == "frontend", F.col("path"))).alias("n_frontend"))
                .select("repo", "pattern", S.pattern_method(F.col("pattern")).alias("method"),
                        F.col("be.path").alias("backend_file"), F.col("be.lang").alias("backend_lang"),
                        "n_frontend", F.col("fe.path").alias("first_frontend")))

    def endpoints_sorted(self) -> DataFrame:
        """Endpoints in locale-aware pattern order (O-1), for reports."""
        return self.endpoints().orderBy(F.collate(F.col("pattern"), "UNICODE"), "repo")

    def endpoints_ranked(self) -> DataFrame:
        """Endpoints with their ``rank`` in that order, over range partitions (O-1)."""
        return global_rank(self.endpoints(), [F.collate(F.col("pattern"), "UNICODE"), F.col("repo")],
                           lambda df, name: materialize(self.spark, df, name, written=self.written))

    def callers(self) -> DataFrame:
        return self._callers

    @cached_property
    def _callers(self) -> DataFrame:
        """callers(repo, pattern, path): frontend files per endpoint."""
        return self._keep(self.pattern_routes().filter(F.col("role") == "frontend")
                .select("repo", "pattern", "path").distinct(), "callers")

    # --- field sets and diff ------------------------------------------------------
    def _facts(self, *exts: str) -> DataFrame:
        return self.facts.filter(F.col("ext").isin(list(exts)))

    def field_sets(self):
        """(defined, accessed) for every endpoint with a backend and >= 1
        frontend. py/go/ts: backend response definitions vs the frontends'
        reads; java: the frontends' request bodies vs the backend's reads."""
        eps = (self.endpoints().filter(F.col("backend_file").isNotNull() & (F.col("n_frontend") > 0))
               .select("repo", "pattern", "backend_file", "backend_lang"))
        callers = self.callers()
        resp_defs = self._facts(*(ext for _, ext in self.rules.endpoint_defs()))
        d_resp = (eps.filter(F.col("backend_lang") != "java")
                  .join(resp_defs.withColumnRenamed("path", "backend_file"), ["repo", "backend_file"])
                  .withColumn("path", F.col("backend_file")))
        # only names that an endpoint defines can matter: pairs are made from its definitions, not from
        # all reads of a caller times all its endpoints
        reads = self._facts("ts_reads").select("repo", "path", "name").distinct()
        a_resp = (d_resp.select("repo", "pattern", "name").distinct().join(callers, ["repo", "pattern"])
                  .join(reads, ["repo", "path", "name"], "left_semi").select("repo", "pattern", "name"))
        java_eps = eps.filter(F.col("backend_lang") == "java")
        d_req = (java_eps.join(callers, ["repo", "pattern"])
                 .join(self._facts("ts_request_defs").drop("lang"), ["repo", "path"])
                 .withColumn("lang", F.lit("ts")))
        a_req = (java_eps.join(self._facts("java_reads").withColumnRenamed("path", "backend_file"),
                               ["repo", "backend_file"]).select("repo", "pattern", "name"))
        cols = ["repo", "pattern", "backend_file", "backend_lang", "path", "lang", "ext", "side",
                "rule", "name", "line", "pos"]
        defined = d_resp.select(*cols).unionByName(d_req.select(*cols))
        accessed = a_resp.unionByName(a_req).distinct()
        return defined, accessed

    def dead_fields(self) -> DataFrame:
        return self._dead

    @cached_property
    def _dead(self) -> DataFrame:
        return self._keep(self._dead_plan(), "dead")

    def _dead_plan(self) -> DataFrame:
        """Per-endpoint dead fields with daily waste (J1 + P16)."""
        defined, accessed = self.field_sets()
        dead = compute_diff(defined, accessed, ["repo", "pattern"])
        if self.protect_dynamic:
            dyn = self._facts("ts_dynamic").select("repo", "path").distinct()
            guarded = self.callers().join(dyn, ["repo", "path"], "left_semi").select("repo", "pattern").distinct()
            dead = dead.join(guarded, ["repo", "pattern"], "left_anti")
        return dead.select("repo", "pattern", S.pattern_method(F.col("pattern")).alias("method"),
                           "backend_file", "path", "lang", "side", "rule", "name", "line", "pos",
                           S.score_waste(F.col("name"), F.col("pattern")).alias("waste_score"))

    def global_defs(self) -> DataFrame:
        return self._facts(*self.rules.global_defs()).filter(F.col("side") == "response")

    def global_dead(self) -> DataFrame:
        return self._global_dead

    @cached_property
    def _global_dead(self) -> DataFrame:
        return self._keep(self._global_dead_plan(), "global_dead")

    def _global_dead_plan(self) -> DataFrame:
        """Response definitions of every file whose name no TypeScript file of
        the same repo reads (J4), default request tier."""
        dead = compute_diff(self.global_defs(), self._facts("ts_reads"), ["repo"])
        return dead.select("repo", "path", "lang", "side", "rule", "name", "line", "pos",
                           S.score_waste(F.col("name")).alias("waste_score"))

    # --- rollups -----------------------------------------------------------------------
    def ledger(self) -> DataFrame:
        """Every finding (endpoint and global) with its message and units."""
        ep = self.dead_fields().select(F.lit("endpoint").alias("source"), "repo", "pattern", "path",
                                       "lang", "side", "name", "line", "pos", "waste_score")
        gl = self.global_dead().select(F.lit("global").alias("source"), "repo",
                                       F.lit(None).cast("string").alias("pattern"), "path", "lang",
                                       "side", "name", "line", "pos", "waste_score")
        both = ep.unionByName(gl)
        return both.select(
            "*", S.defined_at(F.col("path"), F.col("line")).alias("defined_at"),
            S.base_name(F.col("path")).alias("file_name"),
            S.finding_message(F.col("name"), F.col("side"), F.col("waste_score")).alias("message"),
            S.to_kb(F.col("waste_score")).alias("waste_kb"),
            S.carbon_grams(F.col("waste_score")).alias("carbon_g"))

    def summary(self) -> DataFrame:
        """Per-repo totals (G4); endpoint and global findings are both counted,
        as the tool does, and reported separately too."""
        eps = self.endpoints().groupBy("repo").agg(F.count("*").alias("n_endpoints"))
        defined, _ = self.field_sets()
        ndef = defined.groupBy("repo").agg(F.count("*").alias("endpoint_fields"))
        ep = self.dead_fields().groupBy("repo").agg(F.count("*").alias("endpoint_dead"),
                                                    F.sum("waste_score").alias("endpoint_waste"))
        gdefs = self.global_defs().groupBy("repo").agg(F.count("*").alias("global_fields"))
        gl = self.global_dead().groupBy("repo").agg(F.count("*").alias("global_dead"),
                                                    F.sum("waste_score").alias("global_waste"))
        z = lambda c: F.coalesce(F.col(c), F.lit(0))
        t = (eps.join(ndef, "repo", "full").join(ep, "repo", "full").join(gdefs, "repo", "full")
             .join(gl, "repo", "full"))
        total_dead = z("endpoint_dead") + z("global_dead")
        fields = z("endpoint_fields") + z("global_fields")
        waste = (z("endpoint_waste") + z("global_waste")).cast("bigint")
        return t.select(
            "repo", z("n_endpoints").alias("n_endpoints"), z("endpoint_dead").alias("endpoint_dead"),
            z("global_dead").alias("global_dead"), total_dead.alias("total_dead"),
            fields.alias("response_fields"), waste.alias("waste_bytes"),
            S.to_kb(waste).alias("waste_kb"), F.round(S.estimate_wh(waste), 6).alias("energy_wh"),
            F.when(fields > 0, F.round(total_dead.cast("double") / fields.cast("double") * 100.0))
            .otherwise(F.lit(0.0)).alias("dead_pct"),
            S.number_to_words(waste).alias("waste_words"))

    def findings_by_file(self) -> DataFrame:
        """Findings grouped by defining file (G6), counted and summed."""
        return (self.ledger().groupBy("repo", "path")
                .agg(F.count("*").alias("n_findings"), F.sum("waste_score").alias("waste_score"),
                     F.min("line").alias("first_line")))

    def global_lang_totals(self) -> DataFrame:
        """Per (repo, language): response fields scanned and dead."""
        tot = self.global_defs().groupBy("repo", "lang").agg(F.count("*").alias("scanned"))
        dead = self.global_dead().groupBy("repo", "lang").agg(F.count("*").alias("dead"),
                                                              F.sum("waste_score").alias("waste_score"))
        return (tot.join(dead, ["repo", "lang"], "left")
                .select("repo", "lang", "scanned", F.coalesce("dead", F.lit(0)).alias("dead"),
                        F.coalesce("waste_score", F.lit(0)).cast("bigint").alias("waste_score")))

    def lang_file_counts(self) -> DataFrame:
        """Files per language, empty languages absent."""
        return self.files.groupBy("lang").agg(F.count("*").alias("n_files"))

    def position_lookup(self, positions: DataFrame) -> DataFrame:
        """For each (repo, path, line) position, the first dead finding on
        that line, in the order in which the file's fields were extracted."""
        dead = self.ledger().select("repo", "path", "line", "pos", "name", "waste_score")
        first = (dead.groupBy("repo", "path", "line")
                 .agg(F.min(F.struct("pos", "name", "waste_score")).alias("f")))
        return (positions.join(first, ["repo", "path", "line"])
                .select("repo", "path", "line", F.col("f.name").alias("name"),
                        F.col("f.waste_score").alias("waste_score")))

    def report_endpoints(self) -> DataFrame:
        """One row per endpoint with the sizes of its lists (S4): callers, defined, accessed and dead fields."""
        defined, accessed = self.field_sets()
        key = ["repo", "pattern"]
        counts = [defined.groupBy(*key).agg(F.count("*").alias("n_defined")),
                  accessed.groupBy(*key).agg(F.count("*").alias("n_accessed")),
                  self.dead_fields().groupBy(*key).agg(F.count("*").alias("n_dead"),
                                                       F.sum("waste_score").alias("waste_score"))]
        out = self.endpoints().select("repo", "pattern", "method", "backend_file", "n_frontend")
        for c in counts:
            out = out.join(c, key, "left")
        return out.na.fill(0, ["n_defined", "n_accessed", "n_dead", "waste_score"])

    def close(self) -> None:
        """Remove the tables that this analysis has written under the checkpoint folder."""
        for path in self.written:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
        self.written.clear()
