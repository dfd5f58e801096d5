"""Column expressions against plain readings of the same rules; results do not depend on partitions."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docweave.functions import text as tx
from docweave.layout import structure as ls

from .test_operators import sample


def test_expressions_against_plain_python(spark):
    cases: set[str] = set()

    @given(st.text("aB1 .-|é•()/>\t#ß,", max_size=14))
    @settings(max_examples=300, deadline=None)
    def gather(x):
        cases.add(x)

    gather()
    df = spark.createDataFrame([(x,) for x in sorted(cases)], "x string")
    got = df.select("x", tx.looks_tabular(F.col("x")).alias("tab"), tx.is_quote(F.col("x")).alias("quote"), tx.repetition_key(F.col("x")).alias("key"), tx.yaml_unquoted(tx.yaml_quoted(F.col("x"))).alias("yaml"), tx.is_page_number(F.col("x")).alias("number")).collect()
    for r in got:
        s = r.x.strip()
        assert r.tab == (s.count("|") >= 2 or len(re.findall(r"\S {2,}\S", s)) >= 2)
        assert r.quote == s.startswith(("> ", "» "))
        assert r.key == re.sub(r"[\W_]+", "", r.x.lower())  # 14 characters never make a long key
        assert r.yaml == " ".join(r.x.split())
        assert r.number == bool(s and re.fullmatch(r"[\-–—|\s]*\d{1,4}[\-–—|\s]*|\d{1,4}\s*/\s*\d{1,4}", s))


def test_partitions_make_no_difference(spark):
    s = sample(spark)
    want = None
    for n in (1, 7, 16):
        x = ls.lines(s.repartition(n))
        got = sorted(map(tuple, ls.headings(x, ls.body_sizes(s.repartition(n))).collect()))
        want = want or got
        assert got == want
