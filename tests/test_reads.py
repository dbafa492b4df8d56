"""Texts that are read once: phrases of purchases, names of suppliers."""


import random
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from tallyforge.functions import packs, text
from tallyforge.operators import matching
from tallyforge.plans import catalog
from tests.compare import assert_same
from tests.conftest import SMALL


def test_lines_of_documents_equal_the_sql(spark, tmp_path):
    """A digit before a measure's letters, though no measure, takes a line out of the query, as it does in the SQL."""
    lines = ["5 gatos", "lot 7\n12 Lines\nrow 9", "3 x", "", None, "a 4\t\nkg", "8 Kg"]
    spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SMALL}/part.parquet").limit(60).write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    for name in ("documents", "part"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    wanted = con.execute(catalog.ORACLE_SQL["purchase_structure_parse"]).fetchdf()
    assert_same(catalog.QUERIES["purchase_structure_parse"](spark, str(tmp_path)).toPandas(), wanted)
    assert len(wanted) == 64


def test_read_once_equals_reading_every_row(spark):
    texts = ["4 cases x 24 x 330ml", "agua 6 x 1L", "arroz", None, ""]
    rows = spark.createDataFrame([(k, texts[k % 5]) for k in range(50)], "id int, phrase string").coalesce(1)
    read = packs.read_once(rows, "phrase")
    assert read.columns == ["id", "phrase", "s"]
    plain = rows.select("id", packs.structure(F.col("phrase")).alias("s"))
    assert sorted(map(str, read.select("id", "s").collect())) == sorted(map(str, plain.collect()))
    plan = read._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and "RepartitionByExpression" in plan


def test_names_are_read_outside_pairs(spark):
    """Pairs are counted with repeats, and the forms of names are compared where they meet, not read there."""
    rng = random.Random(3)
    words = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 8))) for _ in range(120)] + ["aaaa", "abab", "xyz"]
    pairs = spark.createDataFrame([(a, rng.choice(words)) for a in words], "a string, b string")
    cut = lambda w: Counter(w[i : i + 2] for i in range(len(w) - 1))
    for r in pairs.select("a", "b", text.dice(F.col("a"), F.col("b")).alias("d")).collect():
        x, y = cut(r.a), cut(r.b)
        assert r.d == (1.0 if r.a == r.b else 2 * (x & y).total() / (x + y).total() if x and y else 0.0), r
    names = spark.createDataFrame([("queijo ralado", 1)], "key string, ingredient_id int")
    plan = matching.similar_entries(names, names)._jdf.queryExecution().optimizedPlan().toString()
    assert "their_form" in plan
