"""Synthetic accuracy projects (S7): one spec row -> a backend file, a
frontend file and the expected dead fields, rendered with built-in array and
string functions (no per-row Python).

Spec columns: id, backend_lang ('ts' | 'python' | 'java' | 'go'), endpoint
('GET /api/users/:id'), frontend_ext ('ts' | 'tsx'), all_fields,
accessed_fields, dead_fields (arrays), ts_pattern ('direct', 'destructuring',
'optional-chain', 'jsx', 'template', 'dynamic', 'dynamic-mixed'),
python_pattern ('pydantic' | 'jsonresponse'), model_class, param_name,
java_access ('getter' | 'direct').
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deadwire.functions.scalars import express_to_python_url
from deadwire.sources.derived import _lines, _Many

SPEC_SCHEMA = ("id string, backend_lang string, endpoint string, frontend_ext string, "
               "all_fields array<string>, accessed_fields array<string>, dead_fields array<string>, "
               "ts_pattern string, python_pattern string, model_class string, param_name string, "
               "java_access string")


def _join(lines: list) -> Column:
    return _lines(*lines)


def _many(c: Column) -> _Many:
    return _Many(c)


def _cap(n: Column) -> Column:
    return F.concat(F.upper(F.substring(n, 1, 1)), F.substring(n, 2, 1 << 20))


def dummy_value(name: Column) -> Column:
    """A literal that fits the field name (generator scalar)."""
    n = F.lower(name)
    return (F.when(n.rlike("^(is|has)"), F.lit("true"))
            .when(n.rlike("(id|count|total|price|age)$"), F.lit("1"))
            .otherwise(F.concat(F.lit("'"), name, F.lit("'"))))


def generate(specs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """specs -> (files(repo, path, lang, content), expected(repo, endpoint, dead_fields))."""
    s = specs.withColumn("repo", F.concat(F.lit("project-"), F.col("id")))
    method = F.split_part(F.col("endpoint"), F.lit(" "), F.lit(1))
    url = F.split_part(F.col("endpoint"), F.lit(" "), F.lit(2))
    fetch_url = F.regexp_replace(url, r":([A-Za-z_][A-Za-z0-9_]*)", "\\${id}")
    allf, acc = F.col("all_fields"), F.col("accessed_fields")
    lit = F.lit

    # --- backends ---------------------------------------------------------------
    ts_back = _join([lit("import express from 'express';"), lit("const router = express.Router();"), lit(""),
                     F.concat(lit("router."), F.lower(method), lit("('"), url, lit("', (req, res) => {")),
                     lit("  res.json({"),
                     _many(F.transform(allf, lambda f: F.concat(lit("    "), f, lit(": "), dummy_value(f), lit(",")))),
                     lit("  });"), lit("});")])
    py_json = _join([lit("from fastapi import FastAPI"), lit("from fastapi.responses import JSONResponse"),
                     lit("app = FastAPI()"), lit(""),
                     F.concat(lit("@app."), F.lower(method), lit("('"), express_to_python_url(url), lit("')")),
                     lit("def handler(id: int):"), lit("    return JSONResponse(content={"),
                     _many(F.transform(allf, lambda f: F.concat(lit('        "'), f, lit('": '),
                                                                F.regexp_replace(dummy_value(f), "'", '"'),
                                                                lit(",")))),
                     lit("    })")])
    py_model = _join([lit("from fastapi import FastAPI"), lit("from pydantic import BaseModel"),
                      lit("app = FastAPI()"), lit(""),
                      F.concat(lit("class "), F.col("model_class"), lit("(BaseModel):")),
                      _many(F.transform(allf, lambda f: F.concat(lit("    "), f, lit(": str")))), lit(""),
                      F.concat(lit("@app."), F.lower(method), lit("('"), express_to_python_url(url),
                               lit("', response_model="), F.col("model_class"), lit(")")),
                      lit("def handler(id: int):"), lit("    return load(id)")])
    param = F.col("param_name")
    java_reads = F.when(F.col("java_access") == "getter",
                        F.transform(acc, lambda f: F.concat(lit("        use("), param, lit(".get"), _cap(f),
                                                            lit("());"))))\
        .otherwise(F.transform(acc, lambda f: F.concat(lit("        use("), param, lit("."), f, lit(");"))))
    java = _join([lit("import org.springframework.web.bind.annotation.*;"), lit(""), lit("@RestController"),
                  F.concat(lit("public class "), F.col("model_class"), lit("Controller {")),
                  F.concat(lit("    @"), _cap(F.lower(method)), lit('Mapping("'),
                           express_to_python_url(url), lit('")')),
                  F.concat(lit("    public void handle(@RequestBody "), F.col("model_class"), lit(" "), param,
                           lit(") {")),
                  _many(java_reads), lit("    }"), lit("}")])
    go = _join([lit("package main"), lit(""), lit('import "github.com/gin-gonic/gin"'), lit(""),
                lit("func Register(r *gin.Engine) {"),
                F.concat(lit("\tr."), F.upper(method), lit('("'), url, lit('", func(c *gin.Context) {')),
                lit("\t\tc.JSON(200, gin.H{"),
                _many(F.transform(allf, lambda f: F.concat(lit('\t\t\t"'), f, lit('": '),
                                                           F.regexp_replace(dummy_value(f), "'", '"'), lit(",")))),
                lit("\t\t})"), lit("\t})"), lit("}")])
    backend = (F.when(F.col("backend_lang") == "ts", ts_back)
               .when((F.col("backend_lang") == "python") & (F.col("python_pattern") == "pydantic"), py_model)
               .when(F.col("backend_lang") == "python", py_json)
               .when(F.col("backend_lang") == "java", java).when(F.col("backend_lang") == "go", go)
               .otherwise(F.raise_error(F.concat(lit("unknown backend language "),
                                                 F.coalesce("backend_lang", lit("null"))))))
    be_ext = F.when(F.col("backend_lang") == "ts", lit("ts")).when(F.col("backend_lang") == "python", lit("py")) \
        .otherwise(F.col("backend_lang"))

    # --- frontends ------------------------------------------------------------------
    head = [lit("export async function load(id: number) {"),
            F.concat(lit("  const res = await fetch(`"), fetch_url, lit("`);")),
            lit("  const data = await res.json();")]
    pat = F.col("ts_pattern")
    reads = (F.when(pat == "direct", F.transform(acc, lambda f: F.concat(lit("  show(data."), f, lit(");"))))
             .when(pat == "optional-chain", F.transform(acc, lambda f: F.concat(lit("  show(data?."), f, lit(");"))))
             .when(pat == "template", F.transform(acc, lambda f: F.concat(lit("  show(`${data."), f, lit("}`);"))))
             .when(pat == "destructuring", F.array(F.concat(lit("  const { "), F.array_join(acc, ", "),
                                                            lit(" } = data;"))))
             .when(pat == "jsx", F.transform(acc, lambda f: F.concat(lit("  out.push(<span>{data."), f,
                                                                     lit("}</span>);"))))
             .when(pat == "dynamic", F.array(F.concat(
                 lit("  for (const key of ['"), F.array_join(acc, "', '"), lit("']) show(data[key]);"))))
             .when(pat == "dynamic-mixed", F.concat(
                 F.transform(F.slice(acc, 1, 1), lambda f: F.concat(lit("  show(data."), f, lit(");"))),
                 F.array(F.concat(lit("  for (const key of ['"), F.array_join(F.slice(acc, 2, 1 << 20), "', '"),
                                  lit("']) show(data[key]);")))))
             .otherwise(F.transform(acc, lambda f: F.concat(lit("  show(data."), f, lit(");")))))
    fe_read = _join(head + [_many(reads), lit("}")])
    fe_send = _join([lit("export async function send(form: any) {"),
                     F.concat(lit("  return fetch(`"), fetch_url, lit("`, {")),
                     F.concat(lit("    method: '"), method, lit("',")),
                     lit("    body: JSON.stringify({"),
                     _many(F.transform(allf, lambda f: F.concat(lit("      "), f, lit(": form."), f, lit(",")))),
                     lit("    }),"), lit("  });"), lit("}")])
    frontend = F.when(F.col("backend_lang") == "java", fe_send).otherwise(fe_read)
    fe_ext = F.coalesce(F.col("frontend_ext"), lit("ts"))
    be = s.select("repo", F.concat(lit("backend/server."), be_ext).alias("path"),
                  F.when(be_ext == "py", "py").otherwise(be_ext).alias("lang"), backend.alias("content"))
    fe = s.select("repo", F.concat(lit("frontend/client."), fe_ext).alias("path"), lit("ts").alias("lang"),
                  frontend.alias("content"))
    expected = s.select("repo", "endpoint", "dead_fields")
    return be.unionByName(fe), expected
