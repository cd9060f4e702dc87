"""A source-code corpus rendered from the TPC-H-style tables.

The test tables hold no source code, so this Spark job renders one whose right
answer is relational (SURVEY 7.3). Every ``part`` row becomes one API field:

* repo      = ``brand<N>`` from ``p_brand``;
* file      = (repo, bucket = p_partkey div 200): bounded size, count grows
              with the data;
* name      = a prefix chosen by ``p_size % 12`` (one per byte tier) + partkey;
* language  = (bucket + N) % 4 -> py, go, ts, java; a style number varies the
              rule that applies (jsonify / return dict / JSONResponse, gin.H /
              struct tags, res.json / res.send);
* read      = the part has a lineitem with l_returnflag 'R' and l_linenumber 1;
              the frontend reads those fields (py/go/ts backends) or the Java
              backend reads them by getter (the frontend sends all fields);
* groups with (bucket + N) % 10 = 9 have no frontend file at all.

Files are rendered with built-in array functions over each group's sorted
parts; a group holds at most 200 rows by construction.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET = 200
LANGS = ["py", "go", "ts", "java"]
EXT = {"py": "py", "go": "go", "ts": "ts", "java": "java"}
# name prefix and suffix per p_size % 12, one per byte tier (bool .. default)
NAME_PARTS = [("isActive", ""), ("ref", "Id"), ("count", ""), ("created", ""), ("email", ""),
              ("avatarUrl", ""), ("authToken", ""), ("displayName", ""), ("message", ""),
              ("metaData", ""), ("tagList", ""), ("field", "")]
TIER_BYTES = [5, 38, 6, 26, 27, 52, 66, 22, 80, 64, 40, 22]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: part rows per task: a task renders and extracts that many in some seconds and holds some 50 MB of facts
ROWS_PER_TASK, LEAST_ROWS = 20_000, 500


def dealt(rows: DataFrame, n_parts: int, *by: str) -> DataFrame:
    """``rows`` made from ``n_parts`` rows of ``part``, dealt by ``by`` to tasks of about ROWS_PER_TASK of these; fewer
    if cores are free. Input splits and adaptive execution count bytes, of which a part row has few, but each
    becomes a text that is rendered and extracted: a table of some MB would be one task."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    tasks = max(math.ceil(n_parts / ROWS_PER_TASK), min(cores, math.ceil(n_parts / LEAST_ROWS)), 1)
    return rows.repartition(tasks, *by)


def field_name(partkey: Column, size: Column) -> Column:
    t = F.pmod(size, F.lit(12))
    out = None
    for i, (pre, suf) in enumerate(NAME_PARTS):
        v = F.concat(F.lit(pre), partkey.cast("string"), F.lit(suf))
        out = F.when(t == i, v) if out is None else out.when(t == i, v)
    return out


def parts_with_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per part: repo, bucket, name, is_read, lang, style, has_fe."""
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    read_keys = (read_table(spark, sf_dir, "lineitem")
                 .filter((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 1))
                 .select(F.col("l_partkey").alias("rk")).distinct())
    bn = F.regexp_replace("p_brand", "[^0-9]", "").cast("int")
    p = (part.join(read_keys, F.col("p_partkey") == F.col("rk"), "left")
         .select(
             F.concat(F.lit("brand"), bn.cast("string")).alias("repo"),
             bn.alias("bn"),
             F.expr(f"p_partkey div {BUCKET}").alias("bucket"),
             "p_partkey", "p_size",
             field_name(F.col("p_partkey"), F.col("p_size")).alias("name"),
             F.col("rk").isNotNull().alias("is_read")))
    li = F.pmod(F.col("bucket") + F.col("bn"), F.lit(4))
    lang = F.element_at(F.array(*[F.lit(x) for x in LANGS]), (li + 1).cast("int"))
    return p.select("*", lang.alias("lang"),
                    F.pmod(F.col("bucket") + 3 * F.col("bn"), F.lit(3)).alias("style"),
                    (F.pmod(F.col("bucket") + F.col("bn"), F.lit(10)) != 9).alias("has_fe"))


class _Many:
    """Marks an array<string> of lines inside ``_lines``."""
    def __init__(self, col: Column):
        self.col = col


def _lines(*parts) -> Column:
    return F.array_join(F.concat(*[p.col if isinstance(p, _Many) else F.array(p) for p in parts]), "\n")


def _arr(c: Column) -> _Many:
    return _Many(c)


def _lit(s: str) -> Column:
    return F.lit(s)


def render(groups: DataFrame) -> DataFrame:
    """groups(repo, bucket, lang, style, has_fe, fs: array<struct<k,name,is_read>>)
    -> files(repo, path, lang, content)."""
    g = groups
    b = F.col("bucket").cast("string")
    repo = F.col("repo")
    fs = F.col("fs")
    reads = F.filter(fs, lambda f: f["is_read"])
    url_tail = F.concat(F.lit("/api/"), repo, F.lit("/b"), b, F.lit("/"))

    def each(arr, fmt):
        return _arr(F.transform(arr, fmt))

    # python
    py_head0 = [_lit("from flask import Flask, jsonify, request"), _lit("app = Flask(__name__)"), _lit(""),
                F.concat(F.lit("@app.route('"), url_tail, F.lit("<int:item_id>')")),
                F.concat(F.lit("def get_b"), b, F.lit("(item_id):")),
                F.concat(F.lit("    order = request.args.get('sort"), b, F.lit("')"))]
    py_key = each(fs, lambda f: F.concat(F.lit('        "'), f["name"], F.lit('": item_id,')))
    py0 = _lines(*py_head0, _lit("    return jsonify({"), py_key, _lit("    })"))
    py1 = _lines(*py_head0, _lit("    return {"), py_key, _lit("    }"))
    py2 = _lines(_lit("from fastapi import FastAPI"), _lit("from fastapi.responses import JSONResponse"),
                 _lit("app = FastAPI()"), _lit(""),
                 F.concat(F.lit("@app.get('"), url_tail, F.lit("{item_id}')")),
                 F.concat(F.lit("def get_b"), b, F.lit("(item_id: int):")),
                 _lit("    return JSONResponse(content={"), py_key, _lit("    })"))
    # go
    go_head = [F.concat(F.lit("package "), repo), _lit(""), _lit('import "github.com/gin-gonic/gin"'), _lit("")]
    go_route = F.concat(F.lit('\tr.GET("'), url_tail, F.lit(':id", func(c *gin.Context) {'))
    go_query = F.concat(F.lit('\t\t_ = c.Query("page'), b, F.lit('")'))
    go0 = _lines(*go_head, F.concat(F.lit("func RegisterB"), b, F.lit("(r *gin.Engine) {")), go_route, go_query,
                 _lit("\t\tc.JSON(200, gin.H{"),
                 each(fs, lambda f: F.concat(F.lit('\t\t\t"'), f["name"], F.lit('": c.Param("id"),'))),
                 _lit("\t\t})"), _lit("\t})"), _lit("}"))
    go1 = _lines(*go_head, F.concat(F.lit("type RespB"), b, F.lit(" struct {")),
                 each(fs, lambda f, i: F.concat(F.lit("\tF"), (i + 1).cast("string"),
                                                F.lit(' string `json:"'), f["name"], F.lit('"`'))),
                 _lit("}"), _lit(""), F.concat(F.lit("func RegisterB"), b, F.lit("(r *gin.Engine) {")),
                 go_route, go_query, F.concat(F.lit("\t\tc.JSON(200, RespB"), b, F.lit("{})")), _lit("\t})"),
                 _lit("}"))
    # typescript backend
    ts_head = [_lit("import express from 'express';"), _lit("const app = express();"), _lit(""),
               F.concat(F.lit("app.get('"), url_tail, F.lit(":id', (req, res) => {"))]
    ts_key = each(fs, lambda f: F.concat(F.lit("    "), f["name"], F.lit(": 1,")))
    ts0 = _lines(*ts_head, _lit("  res.status(codeOf(req, pick(1))).json({"), ts_key, _lit("  });"), _lit("});"))
    ts2 = _lines(*ts_head, _lit("  const out = {"), ts_key, _lit("  };"), _lit("  res.json(out);"), _lit("});"),
                 _lit("export function other() { const out = { shadowed: 1 }; return out; }"))
    ts1 = _lines(*ts_head, _lit("  res.send({"), ts_key, _lit("  });"), _lit("});"))
    # java backend reads the fields by getter
    cap = lambda n: F.concat(F.upper(F.substring(n, 1, 1)), F.substring(n, 2, 1 << 20))
    java = _lines(F.concat(F.lit("package com."), repo, F.lit(";")), _lit(""),
                  _lit("import org.springframework.web.bind.annotation.*;"), _lit(""),
                  _lit("@RestController"),
                  F.concat(F.lit("public class B"), b, F.lit("Controller {")),
                  F.concat(F.lit('    @PostMapping("'), url_tail, F.lit('{id}")')),
                  F.concat(F.lit("    public void update(@PathVariable long id, @RequestBody B"), b,
                           F.lit("Request req) {")),
                  each(reads, lambda f: F.concat(F.lit("        use(req.get"), cap(f["name"]), F.lit("());"))),
                  _lit("    }"), _lit("}"), _lit(""),
                  F.concat(F.lit("class B"), b, F.lit("Summary {")),
                  each(reads, lambda f: F.concat(F.lit("    private String "), f["name"], F.lit(";"))),
                  _lit("}"))
    backend = (F.when(F.col("lang") == "py", F.when(F.col("style") == 0, py0)
                      .when(F.col("style") == 1, py1).otherwise(py2))
               .when(F.col("lang") == "go", F.when(F.pmod(F.col("style"), F.lit(2)) == 0, go0).otherwise(go1))
               .when(F.col("lang") == "ts", F.when(F.col("style") == 0, ts0)
                      .when(F.col("style") == 1, ts1).otherwise(ts2))
               .otherwise(java))
    # frontends
    fe_head = [F.concat(F.lit("// client for "), repo, F.lit(" b"), b)]

    def access(f):
        n = f["name"]
        st = F.pmod(f["k"], F.lit(4))
        return (F.when(st == 0, F.concat(F.lit("  out.push(body."), n, F.lit(");")))
                .when(st == 1, F.concat(F.lit("  out.push(body?."), n, F.lit(");")))
                .when(st == 2, F.concat(F.lit("  out.push(`${body."), n, F.lit("}`);")))
                .when(F.pmod(f["k"], F.lit(8)) == 3, F.concat(
                    F.lit("  const { "), n, F.lit(" = pick(dflt, [/['\"]/]) }: api.Body = body; out.push("), n, F.lit(");")))
                .otherwise(F.concat(F.lit("  const { "), n, F.lit(" } = body; out.push("), n, F.lit(");"))))

    fe_read = _lines(*fe_head, F.concat(F.lit("export async function loadB"), b, F.lit("(id: number) {")),
                     F.concat(F.lit("  const res = await fetch(`"), url_tail, F.lit("${id}`);")),
                     _lit("  const body = await res.json();"), _lit("  const out: unknown[] = [];"),
                     each(reads, access), _lit("  return out;"), _lit("}"))
    sent = each(fs, lambda f, i: F.concat(F.lit("      "), f["name"], F.lit(": "), (i + 1).cast("string"), F.lit(",")))
    save = F.concat(F.lit("export async function saveB"), b, F.lit("(id: number) {"))
    post = F.concat(F.lit("  await fetch(`"), url_tail, F.lit("${id}`, {"))
    fe_inline = _lines(*fe_head, save, post, _lit("    method: 'POST',"), _lit("    body: JSON.stringify({"), sent,
                       _lit("    }, null, 2),"), _lit("  });"), _lit("}"))
    fe_var = _lines(*fe_head, save, _lit("  const other = () => { const payload = { shadowed: 1 }; return payload; };"),
                    _lit("  other();"), _lit("  const payload: api.Payload = {"), sent, _lit("  };"), post,
                    _lit("    method: 'POST',"), _lit("    body: JSON.stringify(payload),"), _lit("  });"), _lit("}"))
    fe_axios = _lines(*fe_head, save, _lit("  // typed client"), _lit("  start();"),
                      F.concat(F.lit("  await axios.post(`"), url_tail, F.lit("${id}`, {")), sent, _lit("  });"), _lit("}"))
    fe_send = F.when(F.col("style") == 0, fe_inline).when(F.col("style") == 1, fe_var).otherwise(fe_axios)
    frontend = F.when(F.col("lang") == "java", fe_send).otherwise(fe_read)
    ext = F.element_at(F.create_map(*[x for k, v in EXT.items() for x in (F.lit(k), F.lit(v))]), F.col("lang"))
    # both files of a group from one pass over the groups (no union of two
    # plans that would each recompute the grouping)
    be = F.struct(F.concat(repo, F.lit("/backend/b"), b, F.lit("."), ext).alias("path"),
                  F.col("lang").alias("lang"), backend.alias("content"))
    fe = F.struct(F.concat(repo, F.lit("/frontend/b"), b, F.lit(".ts")).alias("path"),
                  F.lit("ts").alias("lang"), frontend.alias("content"))
    both = F.filter(F.array(be, F.when(F.col("has_fe"), fe)), lambda x: x.isNotNull())
    return g.select("repo", F.inline(both))


GROUP = ["repo", "bucket", "lang", "style", "has_fe"]


def groups_of(parts: DataFrame) -> DataFrame:
    """One row per (repo, bucket) with its parts sorted by key (<= BUCKET rows)."""
    return (parts.groupBy(*GROUP)
            .agg(F.array_sort(F.collect_list(F.struct(F.col("p_partkey").alias("k"), "name", "is_read")))
                 .alias("fs")))


def derived_files(spark: SparkSession, sf_dir: str, deal: bool = True) -> DataFrame:
    """files(repo, path, lang, content) rendered from part and lineitem; ``deal``: in tasks that suit extraction."""
    parts = parts_with_truth(spark, sf_dir)
    if deal:
        parts = dealt(parts, read_table(spark, sf_dir, "part").count(), *GROUP)
    return render(groups_of(parts))
