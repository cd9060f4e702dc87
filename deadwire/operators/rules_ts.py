"""TypeScript/JavaScript rules: request-body definitions (E11-E14), response
definitions of Node handlers (E15), response reads (E16, E17) and the dynamic-read flag.

They need brackets paired at any depth, scopes and type positions, which regular
expressions over whole files cannot give in linear time. ``functions.ts_scan`` reads a
file once; here it runs over Arrow batches inside the scan stage (no shuffle), for
TypeScript rows only: the text of other rows is not sent to Python.
"""
from __future__ import annotations

from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from deadwire.functions.noise import is_ts_read
from deadwire.functions.ts_scan import scan_file

FACTS = "array<struct<ext:string,side:string,rule:string,name:string,line:int>>"


@cache
def _scanner():
    @F.pandas_udf(FACTS)
    def scan(texts: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else [dict(zip(("ext", "side", "rule", "name", "line"), f))
                                                  for f in scan_file(x, is_ts_read)] for x in texts], dtype=object)

    return scan


def ts_facts(lang: Column, content: Column) -> Column:
    """All facts of a TypeScript file, first one per dedup key; null for other files."""
    return _scanner()(F.when(lang == "ts", content))
