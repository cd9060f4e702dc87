import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

FIXTURES = os.path.join(os.path.dirname(os.path.abspath(__file__)), "fixtures")
SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    from deadwire.session import ensure_checkpoint_dir
    s = (SparkSession.builder.master("local[*]")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false")
         .config("spark.driver.memory", "8g")
         .config("spark.sql.session.timeZone", "UTC")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(s)
    yield s


@pytest.fixture(scope="session")
def fixture_files(spark):
    from deadwire.sources.files import scan_corpus
    return scan_corpus(spark, FIXTURES, repo="fx").cache()


@pytest.fixture(scope="session")
def fixture_analysis(spark, fixture_files):
    from deadwire.plans.pipeline import Analysis
    return Analysis.of(spark, fixture_files, persist=False)


@pytest.fixture(scope="session")
def facts(fixture_analysis):
    """{(file name, ext): {(name, line), ...}} of the fixture corpus."""
    out = {}
    for r in fixture_analysis.facts.collect():
        out.setdefault((r.path.split("/")[-1], r.ext), set()).add((r.name, r.line))
    return out


@pytest.fixture(scope="session")
def fact_rows(fixture_analysis):
    return fixture_analysis.facts.collect()


@pytest.fixture(scope="session")
def routes(fixture_analysis):
    return {(r.path.split("/")[-1], r.role, r.method, r.url) for r in fixture_analysis.routes.collect()}
