"""Named queries over the driver tables, each paired with an oracle SQL
(``deadwire.plans.oracle``).

Corpus queries run the whole analysis over the corpus rendered from ``part``
and ``lineitem`` (``deadwire.sources.derived``); scalar queries run the scoring
and URL functions over ``pages`` and ``documents``. All read whole tables.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deadwire.functions import scalars as S
from deadwire.functions.noise import noise_table
from deadwire.plans.pipeline import Analysis, materialize
from deadwire.sources.derived import derived_files, parts_with_truth, read_table
from deadwire.sources.forms import form_files

_CACHE: dict = {}


def _stamp(spark: SparkSession, sf_dir: str) -> tuple:
    """Names, sizes and times of the tables' files, so that rewritten tables are analysed anew."""
    out = []
    for name in ("part", "lineitem"):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        out += [(f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(path)]
    return tuple(sorted(out))


def analysis(spark: SparkSession, sf_dir: str, corpus=derived_files) -> Analysis:
    """Extraction runs once per (session, tables, corpus) and is persisted; every
    corpus query reuses its fact tables."""
    key = (id(spark), spark.sparkContext.applicationId, corpus.__name__, sf_dir, _stamp(spark, sf_dir))
    if key not in _CACHE:
        _CACHE[key] = Analysis.of(spark, corpus(spark, sf_dir))
    return _CACHE[key]


FACT_COLS = ["repo", "path", "lang", "side", "rule", "name", "line"]


def _facts(spark, sf_dir, ext):
    a = analysis(spark, sf_dir)
    return a.facts.filter(F.col("ext") == ext).select(*FACT_COLS)


def q_scan_lang_counts(spark, sf_dir):
    return analysis(spark, sf_dir).lang_file_counts()


def q_route_registry(spark, sf_dir):
    return analysis(spark, sf_dir).endpoints()


def q_defs_py(spark, sf_dir):
    return _facts(spark, sf_dir, "py_defs")


def q_defs_go(spark, sf_dir):
    return _facts(spark, sf_dir, "go_defs")


def q_defs_ts_response(spark, sf_dir):
    return _facts(spark, sf_dir, "ts_response_defs")


def q_defs_ts_request(spark, sf_dir):
    return _facts(spark, sf_dir, "ts_request_defs")


def q_reads_ts(spark, sf_dir):
    return _facts(spark, sf_dir, "ts_reads")


def q_reads_java(spark, sf_dir):
    return _facts(spark, sf_dir, "java_reads")


def q_defs_java(spark, sf_dir):
    return _facts(spark, sf_dir, "java_defs")


def q_reads_py(spark, sf_dir):
    return _facts(spark, sf_dir, "py_reads")


def q_reads_go(spark, sf_dir):
    return _facts(spark, sf_dir, "go_reads")


def q_dead_fields(spark, sf_dir):
    return analysis(spark, sf_dir).dead_fields().drop("pos")


def q_global_dead(spark, sf_dir):
    return analysis(spark, sf_dir).global_dead().drop("pos")


def q_global_lang_totals(spark, sf_dir):
    return analysis(spark, sf_dir).global_lang_totals()


def q_summary(spark, sf_dir):
    return analysis(spark, sf_dir).summary()


def q_ledger(spark, sf_dir):
    return analysis(spark, sf_dir).ledger().select(
        "source", "repo", "pattern", "path", "side", "name", "line", "waste_score", "defined_at",
        "file_name", "message", "waste_kb", "carbon_g")


def q_findings_by_file(spark, sf_dir):
    return analysis(spark, sf_dir).findings_by_file()


def q_position_lookup(spark, sf_dir):
    a = analysis(spark, sf_dir)
    positions = a.facts.select("repo", "path", "line").distinct()
    return a.position_lookup(positions)


def q_accuracy(spark, sf_dir):
    """Precision and recall of the endpoint diff per repo (G8; 0/0 counts as 1.0). The truth differs from the
    sources on purpose: parts of size 1 are read by a client outside the corpus (false
    positives), reads of parts of size 2 are leftovers that count as dead (misses)."""
    from deadwire.plans.evaluation import evaluate_sets, in_project_order
    defined, accessed = analysis(spark, sf_dir).field_sets()
    parts = parts_with_truth(spark, sf_dir).filter("has_fe")
    dead = F.when(F.col("is_read"), F.col("p_size") == 2).otherwise(F.col("p_size") != 1)
    expected = parts.select("repo", F.array_compact(F.array(F.when(dead, F.col("name")))).alias("dead_fields"))
    return in_project_order(evaluate_sets(defined, accessed, expected))


def q_report_endpoints(spark, sf_dir):
    """The report's endpoint rows."""
    return analysis(spark, sf_dir).report_endpoints()


HREF = r'href="([^"]*)"'


def q_url_normalize(spark, sf_dir):
    """Normalised href paths of every page with their request tier."""
    pages = read_table(spark, sf_dir, "pages").select("url", "html")
    hrefs = pages.select(F.explode(F.regexp_extract_all("html", F.lit(HREF), 1)).alias("href"))
    urls = pages.select(F.col("url").alias("href")).unionByName(hrefs)
    norm = S.normalize_url(F.col("href"))
    return (urls.select(norm.alias("path"))
            .groupBy("path").agg(F.count("*").alias("n"))
            .select("path", "n", S.estimate_daily_requests(F.concat(F.lit("GET "), F.col("path")))
                    .alias("get_requests"),
                    S.estimate_daily_requests(F.concat(F.lit("POST "), F.col("path"))).alias("post_requests")))


#: A whole word in any script that starts like an identifier.
WORD = r"[\p{L}_][\p{L}\p{M}\p{N}_]*"


def q_field_bytes_tiers(spark, sf_dir):
    """Byte tier of every identifier-like word of every document."""
    docs = read_table(spark, sf_dir, "documents").select("text")
    words = docs.select(F.explode(F.regexp_extract_all("text", F.lit(WORD), 0)).alias("word"))
    # tier once per distinct word: duplicates are merged map-side first
    per_word = words.groupBy("word").agg(F.count("*").alias("n"))
    tiers = per_word.select("word", "n", S.field_bytes_tier(F.col("word")).alias("tier"))
    return (tiers.groupBy("tier")
            .agg(F.sum("n").alias("n_words"), F.count("*").alias("n_distinct"))
            .select("tier", S.tier_bytes(F.col("tier")).alias("bytes"), "n_words", "n_distinct"))


def q_noise_filter(spark, sf_dir):
    """Noise-list hits among document words, per (lang, kind) list."""
    docs = read_table(spark, sf_dir, "documents").select("text")
    words = docs.select(F.explode(F.regexp_extract_all("text", F.lit(WORD), 0)).alias("name"))
    nt = noise_table(spark)  # fixed ~400 rows: broadcast is size-bounded
    # word counts first (map-side combined), then the small lookup join
    per_word = words.groupBy("name").agg(F.count("*").alias("n"))
    return (per_word.join(F.broadcast(nt), "name")
            .groupBy("lang", "kind").agg(F.sum("n").alias("hits"),
                                         F.count("*").alias("distinct_names")))


QUERIES = {
    "scan_lang_counts": q_scan_lang_counts,
    "route_registry": q_route_registry,
    "defs_py": q_defs_py,
    "defs_go": q_defs_go,
    "defs_ts_response": q_defs_ts_response,
    "defs_ts_request": q_defs_ts_request,
    "reads_ts": q_reads_ts,
    "reads_java": q_reads_java,
    "defs_java": q_defs_java,
    "reads_py": q_reads_py,
    "reads_go": q_reads_go,
    "dead_fields": q_dead_fields,
    "global_dead": q_global_dead,
    "global_lang_totals": q_global_lang_totals,
    "summary": q_summary,
    "ledger": q_ledger,
    "findings_by_file": q_findings_by_file,
    "position_lookup": q_position_lookup,
    "accuracy": q_accuracy,
    "report_endpoints": q_report_endpoints,
    "url_normalize": q_url_normalize,
    "field_bytes_tiers": q_field_bytes_tiers,
    "noise_filter": q_noise_filter,
}


def _rendered(spark, sf_dir):
    """The derived files, rendered once for all drops. Not dealt out: every landing file costs a share of a batch."""
    return materialize(spark, derived_files(spark, sf_dir, deal=False), "rendered")


def q_incremental_rescan(spark, sf_dir):
    """The corpus lands as a change feed of versioned saves (first every file with stale
    frontends that read nothing, then the real frontends); a file-source
    stream re-analyses each save; the latest version of every file wins. The
    final state's dead fields equal the batch answer."""
    import uuid

    from deadwire.session import ensure_checkpoint_dir
    from deadwire.streaming.rescan import current_state, run_rescan, write_drop

    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/rescan-{uuid.uuid4().hex[:12]}"
    files = _rendered(spark, sf_dir)
    is_fe = F.col("path").contains("/frontend/")
    stale = F.regexp_replace("content", r"\n  (out\.push|const \{)[^\n]*", "")
    write_drop(files.withColumn("content", F.when(is_fe, stale).otherwise(F.col("content"))),
               f"{base}/landing", 1)
    # a file that is gone in the end, saved and then deleted; its late older save changes nothing
    gone = files.filter(is_fe).withColumn("path", F.concat(F.lit("gone/"), F.col("path")))
    write_drop(gone, f"{base}/landing", 1)
    write_drop(gone, f"{base}/landing", 3, deleted=True)
    write_drop(files.filter(is_fe), f"{base}/landing", 2)
    write_drop(files.filter(is_fe), f"{base}/landing", 2)  # delivered twice
    write_drop(gone, f"{base}/landing", 2)
    run_rescan(spark, f"{base}/landing", f"{base}/state", f"{base}/checkpoint",
               max_files_per_trigger=8)
    return current_state(spark, f"{base}/state").dead_fields().drop("pos")


QUERIES["incremental_rescan"] = q_incremental_rescan


def q_accuracy_overall(spark, sf_dir):
    """Macro and micro precision/recall over all repos."""
    from deadwire.plans.evaluation import overall
    return overall(q_accuracy(spark, sf_dir))


QUERIES["accuracy_overall"] = q_accuracy_overall


def q_rule_forms(spark, sf_dir):
    """Every extraction rule (E12-E26, J5-J8) over one file per part."""
    return analysis(spark, sf_dir, form_files).facts.drop("pos")


def q_route_forms(spark, sf_dir):
    """Every route and call form (E1-E10, J6) over one file per part."""
    return analysis(spark, sf_dir, form_files).routes.drop("lang_rank")


def q_registry_forms(spark, sf_dir):
    """The registry where endpoints have many backends and callers."""
    return analysis(spark, sf_dir, form_files).endpoints()


def q_dead_forms(spark, sf_dir):
    """Dead fields of endpoints with many backends and callers."""
    return analysis(spark, sf_dir, form_files).dead_fields().select(
        "repo", "pattern", "backend_file", "side", "rule", "name", "line")


def q_position_forms(spark, sf_dir):
    """The first finding of every line, where lines hold several."""
    a = analysis(spark, sf_dir, form_files)
    return a.position_lookup(a.facts.select("repo", "path", "line").distinct()).drop("waste_score")


def _scratch(spark, name):
    import uuid

    from deadwire.session import ensure_checkpoint_dir
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def q_rescan_touched(spark, sf_dir):
    """Findings kept up to date save by save. The corpus lands with stale frontends, then the real frontends of
    the repos with an even number, then those of the others together with everything that had landed before. Returns
    the final findings and, per batch, the repos it has rewritten."""
    from deadwire.streaming.maintain import rewritten, run_maintained, view
    from deadwire.streaming.rescan import write_drop

    base = _scratch(spark, "maintained")
    landing, state = f"{base}/landing", f"{base}/state"
    files = _rendered(spark, sf_dir)
    is_fe = F.col("path").contains("/frontend/")
    stale = files.withColumn("content", F.when(is_fe, F.regexp_replace("content", r"\n  (out\.push|const \{)[^\n]*", ""))
                             .otherwise(F.col("content")))
    even = F.regexp_extract("repo", "[0-9]+", 0).cast("int") % 2 == 0
    fronts = files.filter(is_fe)
    for drops in ([(stale, 1)], [(fronts.filter(even), 2)], [(fronts.filter(even), 2), (stale, 1), (fronts.filter(~even), 2)]):
        for rows, version in drops:
            write_drop(rows, landing, version)
        run_maintained(spark, landing, state, f"{base}/checkpoint")
    null = F.lit(None)
    found = view(spark, state, "findings").select(
        F.lit("finding").alias("kind"), null.cast("long").alias("batch"), "repo", "source", "pattern", "path", "side", "name",
        "line", "waste_score")
    rows = rewritten(spark, state).select(
        F.lit("rewrite").alias("kind"), "batch", "repo", *(null.cast("string").alias(c) for c in (
            "source", "pattern", "path", "side", "name")), null.cast("int").alias("line"), null.cast("long").alias("waste_score"))
    return found.unionByName(rows)


def q_edit_withdrawn(spark, sf_dir):
    """Findings of files that were edited or deleted after their scan are withdrawn. All files are scanned;
    backends of two thirds of the repos are edited, half of those saved again, some deleted; the edits are delivered
    once more after the saves."""
    from deadwire.streaming.validity import file_states, run_validity, visible

    base = _scratch(spark, "validity")
    a = analysis(spark, sf_dir)
    number = F.regexp_extract("repo", "[0-9]+", 0).cast("int")
    backs = a.files.filter(F.col("path").contains("/backend/"))

    def land(files, kind, seq):
        (files.select("repo", "path", F.lit(kind).alias("kind"), F.lit(seq).cast("long").alias("seq"))
         .write.mode("append").parquet(f"{base}/events"))

    edited = backs.filter(number % 3 != 0)
    for events in ([(a.files, "scan", 1)], [(edited, "edit", 2)],
                   [(backs.filter(number % 3 == 1), "save", 3), (backs.filter(number % 5 == 4), "delete", 4)], [(edited, "edit", 2)]):
        for files, kind, seq in events:
            land(files, kind, seq)
        run_validity(spark, f"{base}/events", f"{base}/log", f"{base}/checkpoint")
    return visible(a.ledger(), file_states(spark, f"{base}/log")).select(
        "source", "repo", "pattern", "path", "side", "name", "line", "waste_score")


# Patterns of the offset query, by table; the oracle states the same.
OFFSET_RULES = (("pages", "page_id", "html", {"href": r'href="[^"]*"', "open_tag": r"<[a-z][a-z0-9]*"}),
                ("documents", "doc_id", "text", {"long_word": r"[A-Za-z]{8,}", "line_end": r"\n"}))


def q_match_offsets(spark, sf_dir):
    """Offset and line of every match of some patterns in whole pages and documents."""
    from deadwire.functions.text import match_offsets

    def placed(rule, found):
        return F.transform(F.coalesce(found, F.array().cast("array<struct<start:int,line:int,m:string>>")), lambda m: F.struct(
            F.lit(rule).alias("rule"), m["start"].alias("start"), m["line"].alias("line")))

    out = None
    for name, key, text, rules in OFFSET_RULES:
        rows = read_table(spark, sf_dir, name).select(
            F.concat(F.lit(f"{name}/"), F.col(key).cast("string")).alias("path"),
            F.explode(F.concat(*(placed(rule, match_offsets(text, p)) for rule, p in rules.items()))).alias("x")).select("path", "x.*")
        out = rows if out is None else out.unionByName(rows)
    return out


def q_range_containment(spark, sf_dir):
    """The links of every page that lie in ranges of one to three tags, which begin at every third tag and overlap
    or nest where a longer one begins before."""
    from deadwire.functions.text import match_offsets
    from deadwire.operators.ranges import contained

    pages = read_table(spark, sf_dir, "pages").where("html is not null")
    tags = F.transform(match_offsets("html", OFFSET_RULES[0][3]["open_tag"]), lambda m: m["start"])
    tags = pages.select("page_id", tags.alias("tags"))
    ranges = tags.select("page_id", F.posexplode("tags").alias("i", "start"), "tags").where("i % 3 = 0 or i % 7 = 0").select(
        "page_id", "start", F.coalesce(F.get("tags", F.col("i") + 1 + F.col("i") % 3), F.col("start")).alias("end"))
    links = pages.select("page_id", F.explode(match_offsets("html", OFFSET_RULES[0][3]["href"])).alias("m"))
    return contained(links.select("page_id", F.col("m.start").alias("at")), ranges, ["page_id"])


def q_endpoint_order(spark, sf_dir):
    """O-1: rank of every endpoint in the order of the UNICODE collation."""
    return analysis(spark, sf_dir, form_files).endpoints_ranked().select("repo", "pattern", "rank")


def q_truth_accounting(spark, sf_dir):
    """A truth document and a document of precomputed facts per endpoint, some cut off, some with a field of
    the wrong type, empty or without what they need: what each repo's documents hold, and how many are bad."""
    from deadwire.sources.derived import groups_of
    from deadwire.sources.files import accounting, parse_expected, parse_precomputed

    groups = groups_of(parts_with_truth(spark, sf_dir)).withColumn("path", F.concat("repo", F.lit("/b"), F.col("bucket").cast("string")))
    named = lambda fs: F.transform(fs, lambda f: f["name"])
    truth = F.to_json(F.struct(F.col("path").alias("endpoint"), named(F.filter("fs", lambda f: ~f["is_read"])).alias("deadFields")))
    kind = F.col("bucket") % 5
    truth = (F.when(kind == 1, F.substring(truth, F.lit(1), F.length(truth) - 2)).when(kind == 2, F.lit('{"endpoint": "x", "deadFields": 7}'))
             .when(kind == 3, F.lit('{"endpoint": "x"}')).otherwise(truth))
    field = lambda f: F.struct(f["name"].alias("name"), F.lit("response").alias("side"), F.lit("a.ts:1").alias("definedAt"))
    facts = F.to_json(F.struct(F.transform("fs", field).alias("defined"),
                               F.transform(F.filter("fs", lambda f: f["is_read"]), field).alias("accessed")))
    facts = F.when(F.col("bucket") % 3 == 1, F.lit("")).when(F.col("bucket") % 3 == 2, F.lit("{}")).otherwise(facts)
    expected = parse_expected(groups.select("repo", "path", truth.alias("content")))
    computed = parse_precomputed(groups.select("repo", "path", facts.alias("content")))
    held = expected.groupBy("repo").agg(F.sum(F.coalesce(F.size("dead_fields"), F.lit(0))).alias("n_dead_fields"))
    listed = computed.groupBy("repo").agg(F.sum(F.size("facts")).alias("n_facts"))
    both = accounting(computed).select("repo", F.col("n_parsed").alias("n_facts_parsed"), F.col("n_bad").alias("n_facts_bad"))
    return accounting(expected).join(held, "repo").join(both, "repo").join(listed, "repo")


def q_report_documents(spark, sf_dir):
    """The report of every repo, written in chunks of 50 items and read back."""
    from deadwire.sources.report import read_documents, write_documents
    out = _scratch(spark, "report")
    write_documents(analysis(spark, sf_dir), out, chunk=50)
    return read_documents(spark, out).withColumnRenamed("wasteScore", "waste_score")


QUERIES |= {"report_documents": q_report_documents}
QUERIES |= {"match_offsets": q_match_offsets, "range_containment": q_range_containment, "endpoint_order": q_endpoint_order,
            "truth_accounting": q_truth_accounting}
QUERIES |= {"rescan_touched": q_rescan_touched, "edit_withdrawn": q_edit_withdrawn}
QUERIES |= {"rule_forms": q_rule_forms, "route_forms": q_route_forms, "registry_forms": q_registry_forms,
            "dead_forms": q_dead_forms, "position_forms": q_position_forms}
