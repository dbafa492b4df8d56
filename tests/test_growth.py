"""What grows with the tables goes neither through the driver nor through one task."""

from pyspark.sql import functions as F

from tallyforge.functions import identity, text
from tallyforge.operators import audits, containment, matching, reviews
from tallyforge.plans import contract_queries, cost_queries, upkeep_queries
from tallyforge.sources import texts, views
from tallyforge.streaming import chain_store
from tests.conftest import SMALL


def plan(frame):
    """The plan as it was run."""
    frame.collect()
    return frame._jdf.queryExecution().executedPlan().toString()


def test_entries_are_not_broadcast(spark):
    rows = [(k, f"palha doce {k % 50}" if k % 3 else f"palha {k % 50}", k % 3) for k in range(300)]
    found = containment.hidden_orphans(spark.createDataFrame(rows, "ingredient_id int, name string, n_uses int"))
    assert "BroadcastHashJoin" not in plan(found)
    assert found.count() == 100


def test_ranked_rows_are_not_broadcast(spark):
    ranked = views.indexed(spark.range(200_000).select((F.col("id") * 3).alias("k")), "k", "ix")
    assert "BuildLeft" not in plan(ranked.where("ix < 5"))
    assert ranked.where("k <> 3 * ix").isEmpty()
    assert plan(views.recipe_edges(spark, SMALL)).count("BroadcastHashJoin [_bucket") == plan(views.recipe_edges(spark, SMALL)).count("BroadcastHashJoin")


def test_texts_of_a_part_are_spelt_once(spark):
    """However many suppliers sell a part, it is spelt eight times at most, and no text is lost."""
    every = texts.written_names(spark, SMALL).select("text").distinct()
    once = texts.written_texts(spark, SMALL)
    assert once.count() == every.count() == once.join(every, "text", "left_semi").count()


def test_names_of_one_word_and_equal_words(spark):
    names = ["palha", "palha doce", "doce palha", "doce", "x", "", None, "palhada docemente", "palha palha"]
    got = {tuple(r) for r in containment.contained(spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    known = [n for n in names if n]
    assert got == {(a, b) for a in known for b in known if a != b and all(w in b for w in a.split())}


def test_names_are_compared_once_a_pair(spark):
    """Texts are read, and pairs compared, in a fixed number of tasks; entries without a name are kept."""
    rows = [(k, "bat palha" if k % 2 else "molho", k % 3, None if k % 5 == 0 else "Batata palha") for k in range(600)] + [(700, " ", 1, "x"), (701, "molho", None, None)]
    found = audits.alias_findings(spark.createDataFrame(rows, "alias_id int, alias_name string, ingredient_id int, name string"))
    assert found.count() == 601
    assert found.select("confidence", "reasons").distinct().count() <= 8
    read = identity.read_once(spark.createDataFrame([("molho",)] * 9, "name string"), "name", said="words")
    assert "REPARTITION_BY_NUM" in plan(read)


def test_shelf_names_compile(spark):
    """Every form is written as before, in code that the virtual machine compiles."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    rows = texts.shelf_lines(spark, SMALL)
    rows._jdf.queryExecution().executedPlan()
    spark.conf.unset("spark.sql.adaptive.enabled")
    stats = spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(rows._jdf.queryExecution().debug().codegenToSeq())
    assert max(s._3().maxMethodCodeSize() for s in stats) <= 8000
    names = spark.range(-1, 17).select(F.col("id").alias("shelf"), F.when(F.col("id") != 16, F.lit("x")).alias("p_name")).select("shelf", F.expr(texts.SHELF_SQL).alias("name")).collect()
    assert {r.shelf: r.name for r in names} == {k: form[0].replace("{n}", "x") for k, form in enumerate(texts.SHELF_FORMS[:16])} | {-1: None, 16: None}


def test_extremes_move_rows_once(spark):
    rows = [(1, 2.0, 3, "b"), (1, 2.0, 1, "c"), (1, 5.0, 9, "d"), (1, 5.0, 4, "e"), (1, -1.0, 0, "x"), (2, 7.0, 1, "f"), (3, None, 1, "g")]
    found = reviews.price_extremes(spark.createDataFrame(rows, "ingredient_id int, unit_price double, chrono int, supplier_name string"), ["chrono"])
    assert sorted(tuple(r) for r in found.collect()) == [(1, 2.0, "c", 5.0, "e"), (2, 7.0, "f", 7.0, "f")]
    final = plan(found).split("Initial Plan")[0]
    assert "Join" not in final and final.count("Exchange hashpartitioning") == 1


def test_phrases_of_parts_read_no_documents(spark):
    told = cost_queries._priced(spark, SMALL)
    assert not any("documents" in f for f in told.inputFiles())
    assert "REPARTITION_BY_NUM" in plan(told)


def test_log_and_store_grow_in_number(spark, tmp_path, monkeypatch):
    """A batch of a long log has several files, and the chains more buckets."""
    seen = {}
    monkeypatch.setattr(chain_store, "run_available", lambda events, store: seen.update(events=events, store=store) or spark.createDataFrame([], chain_store.CHAIN))
    rows = spark.range(400_000).select(F.col("id").alias("event_id"), F.timestamp_seconds("id").alias("ts"), (F.col("id") % 99).alias("user_id"), F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit("").alias("props"))
    rows.write.parquet(f"{tmp_path}/events.parquet")
    upkeep_queries.streaming_upkeep(spark, str(tmp_path))
    assert seen["store"].buckets == 12
    log = spark.read.schema(chain_store.EVENT).parquet(seen["store"].folder.rsplit("/", 1)[0] + "/arrivals-*/log")
    assert len([f for f in log.inputFiles()]) >= 2 * texts.ARRIVALS


def test_described_purchases_move_by_order_and_ingredient(spark):
    """Names are read beside the purchases, which move by neither their text nor a second time by ingredient; no order goes through the driver."""
    final = plan(contract_queries.guarded_reasons(spark, SMALL)).split("Initial Plan")[0]
    assert "hashpartitioning(ingredient_id" not in final and "hashpartitioning(printed" not in final
    assert final.count("Exchange hashpartitioning(l_partkey") == 2 and final.count("Exchange hashpartitioning(l_orderkey") == 2
    parts = spark.createDataFrame([("Salsa",), ("Salsa",), (None,)], "name string")
    (told,) = contract_queries.told_names(parts).collect()
    assert [(s.family, s.preservation, s.grams) for s in told.said] == [form[2:4] + (form[5],) for form in texts.LINE_FORMS]


def test_cascade_moves_lines_twice(spark):
    """Lines go to what is told of their supplier and first word and to the answers of their key; no stage moves them for itself."""
    lines = spark.createDataFrame([(1, "s", "queijo serra"), (2, "s", "molho"), (3, "t", None)], "line_id int, supplier_name string, key string")
    catalog = spark.createDataFrame([(7, "queijo serra")], "ingredient_id int, key string")
    told = spark.createDataFrame([("s", "molho", 7)], "supplier_name string, key string, ingredient_id int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = matching.cascade(lines, catalog, told.withColumnRenamed("key", "normalized_alias"), told.limit(0), told.limit(0))
        assert sorted(tuple(r) for r in found.collect()) == [(1, 7, "exact", 1.0), (2, 7, "alias", 1.0), (3, None, "unmatched", 0.0)]
        assert found._jdf.queryExecution().sparkPlan().toString().count("Scan ExistingRDD") == 1
        assert plan(found).split("Initial Plan")[-1].count("Exchange hashpartitioning") == 4
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_keyed_names_equal_written_names(spark):
    read = texts.written_names(spark, SMALL).withColumn("key", text.canonical_key(F.col("text"))).drop("text", "line_id")
    keyed = texts.keyed_names(spark, SMALL).select(*read.columns)
    assert keyed.count() == read.count() and keyed.exceptAll(read).isEmpty()
    assert plan(keyed).split("Initial Plan")[-1].count("Exchange hashpartitioning(l_partkey") <= 1
