"""What keeps plans short and joins small on large tables."""

import pytest
from pyspark.sql import functions as F

from coderill import queries
from coderill.functions import sql
from coderill.operators import calibration, codes, ingest, similarity
from coderill.operators.similarity import similarity_of

SF = "/root/testdata/sf0.001"


def optimized(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_plans_begin_at_written_tables(spark):
    """the plans of codes and of contracts are in none that is made of them."""
    store = queries.store_of(spark, SF)
    for frame in (store.codes, store.stored, store.effective, store.seeds, store.index.keyed, store.index.classes, store.alerts(), queries.QUERIES["w8_events"](spark, SF)):
        plan = frame._jdf.queryExecution().analyzed().toString()
        assert "regexp_extract_all" not in plan and "md5" not in plan


def test_instructions_are_made_once(spark):
    """each code of a pair, or of a row, is taken apart once."""
    rows = spark.createDataFrame([("6300000001146000", "6300000001146001")], "a string, b string")
    assert optimized(rows.select(similarity_of(F.col("a"), F.col("b")).alias("s"))).count("regexp_extract_all") == 2
    sql.register(spark)
    rows.createOrReplaceTempView("two")
    assert optimized(spark.sql("SELECT f.* FROM (SELECT evm_fingerprint(a) AS f FROM two)")).count("regexp_extract_all") == 1


def test_delegations_alike(spark):
    hx = "ef0100" + "cd" * 20
    rows = spark.createDataFrame([(hx, hx, 1.0), (hx, "ef0100" + "ce" * 20, 0.0), (hx, "00", 0.0)], "a string, b string, want double")
    assert [r[0] for r in rows.select(similarity_of(F.col("a"), F.col("b")) == F.col("want")).collect()] == [True] * 3


@pytest.fixture(scope="module")
def copies(spark):
    """Sixty codes with two sets of selectors and two of opcode runs, and two addresses of each."""
    hx = F.concat(F.lit("8063000000011480630000000214806300000003148063000000041460"), F.when(F.col("id") % 2 == 0, "00ff54f400f4").otherwise("00"), F.lit("73"), F.substring(F.sha1(F.col("id").cast("string")), 1, 40))
    rows = spark.range(120).withColumn("id", F.col("id") % 60).select(hx.alias("hx"), F.monotonically_increasing_id().alias("n"))
    return rows.select("hx", F.format_string("0x%040x", "n").alias("address"), F.lit(1).cast("long").alias("block"), F.lit("seen").alias("origin"), F.lit(None).cast("string").alias("implementation")).localCheckpoint()


def test_pairs_are_scored_by_class(spark, copies):
    """F2, F6, F11, F12: rows of scores follow the sets that differ, not the codes."""
    held, stored = codes.fingerprints(copies), codes.addresses(copies)
    seeds = stored.select("address", "code_id", F.lit("s").alias("label"), F.lit(True).alias("strict")).limit(5)
    index = similarity.Index(held)
    assert held.count() == 60 and index.classes.count() == 2
    classes = index.classes.withColumn("strict", F.lit(True))
    assert similarity.class_pairs(classes, held, 0.5, index).count() == 4
    alerts = similarity.alerts(stored, held, seeds, stored.select("address", "code_id"), code_min=0.0)
    assert alerts.count() == 5 * 119
    x, y = (held.select(F.col("code_id").alias(c), F.col("runs").alias(f"{c}_runs"), F.col("selectors").alias(f"{c}_selectors")) for c in "ab")
    want = x.crossJoin(y).select("a", "b", similarity.jaccard(F.col("a_selectors"), F.col("b_selectors")).alias("score"), similarity.code_similarity(F.col("a_runs"), F.col("b_runs")).alias("code_score")).filter("score >= 0.5")
    assert sorted(similarity.code_pairs(held, 0.5, index).collect()) == sorted(want.collect())
    assert similarity.score_pairs(held, held, 0.0).count() == 3600


def test_events_are_numbered_by_kind(spark):
    """F1, F7, F8: ids of upgrades need counts of alerts and no row of them; counts need no ids."""
    alerts = spark.createDataFrame([(2, "0xa", "0xs", "l", 1.0, "seen"), (1, "0xb", "0xs", "l", 0.8, "seen"), (2, "0xa", "0xs", "l", 0.9, "seen")], "block long, address string, seed_address string, label string, score double, origin string")
    changes = spark.createDataFrame([(2, "0xc", "0x1", "0x2"), (1, "0x0", "0x1", "0x2")], "block long, address string, old_impl string, new_impl string")
    found = ingest.events(alerts, changes, 10).select("id", "kind", "address", "score").collect()
    assert sorted(found) == [(11, "ALERT", "0xb", 0.8), (12, "UPGRADE", "0x0", None), (13, "ALERT", "0xa", 1.0), (14, "ALERT", "0xa", 0.9), (15, "UPGRADE", "0xc", None)]
    unread = alerts.withColumn("label", F.raise_error(F.concat(F.lit("read "), F.col("address"))).cast("string"))
    assert sorted(r["id"] for r in ingest.of_kind(ingest.events(unread, changes, 10), "UPGRADE").collect()) == [12, 15]
    assert "Window" not in optimized(queries.QUERIES["a7_event_counts"](spark, SF)) and "Window" not in optimized(queries.QUERIES["a7_seed_counts"](spark, SF))


@pytest.fixture(scope="module")
def classes(spark):
    """Members of three classes, what seeds found for two of them (one seed under two labels), and changes."""
    members = spark.createDataFrame([(f"0x{k:02d}", f"s{k % 3}", "r", "seen" if k % 2 else "created", k % 4) for k in range(24)], "address string, set_key string, runs_key string, origin string, block long")
    found = spark.createDataFrame([(f"s{c}", "r", f"0x{k:02d}", label, 1.0 - (k % 2) / 10) for c in (0, 1) for k in (0, 3, 4, 5, 9) for label in ("a", "b")[: 1 + (k == 3)]], "set_key string, runs_key string, seed_address string, label string, score double")
    changes = spark.createDataFrame([("0x01", "0x1", "0x2", 1), ("0x05", "0x1", "0x2", 1), ("0x07", "0x1", "0x3", 9)], "address string, old_impl string, new_impl string, block long")
    return members, found, changes


def test_events_follow_from_classes(spark, classes):
    """the ids of alerts are those of all alerts in order, and no window holds or sorts alerts."""
    members, found, changes = classes
    order = lambda rows: sorted(rows.drop("label").collect(), key=repr)  # noqa: E731 - labels of one seed tie
    want = ingest.events(similarity.to_members(members, found), changes, 7)
    got = ingest.events_of_classes(members, found, changes, start=7)
    assert got.columns == want.columns and order(got) == order(want) and got.select("id", "label").distinct().count() == want.count() > 60
    for name in ("w8_events", "w9_event_lines", "w10_lines_of_created"):
        windows = [x for x in optimized(queries.QUERIES[name](spark, SF)).splitlines() if "Window [" in x]
        assert windows and not [x for x in windows if "seed_address" in x]
    upgrades = [x for x in optimized(queries.QUERIES["f9_upgrades_only"](spark, SF)).splitlines() if "Relation" in x or "Join" in x]
    assert len(upgrades) <= 3 and not [x for x in upgrades if "seed_address" in x]


def test_alerts_are_counted_by_class(spark, classes):
    """F7, F8: counts need no row of an alert."""
    members, found, changes = classes
    alerts = similarity.to_members(members, found)
    want = ingest.seed_counts(alerts.withColumn("kind", F.lit("ALERT"))).collect()
    counts = similarity.alert_counts(members, found)
    assert ingest.by_count(counts).collect() == want
    assert {r["kind"]: r["n"] for r in ingest.event_counts_of(counts, changes).collect()} == {"ALERT": alerts.count(), "UPGRADE": 3}
    assert {r["kind"]: r["n"] for r in ingest.event_counts_of(counts.filter("n < 0"), changes.filter("block < 0")).collect()} == {"ALERT": 0, "UPGRADE": 0}
    for name in ("a7_event_counts", "a7_seed_counts"):
        assert "NOT (address" not in optimized(queries.QUERIES[name](spark, SF))


def test_plans_of_joins_are_short(spark):
    """what is read more than once is written, so no table of the tables, and no join that multiplies rows, is in a plan twice."""
    for name, most in (("a18_calibrate", 12), ("st8_implementation_alerts", 8), ("s2_code_similarity", 4)):
        plan = optimized(queries.QUERIES[name](spark, SF))
        assert plan.count("Join ") <= most and "p_partkey" not in plan


def test_benign_codes_are_counted_whole(spark, copies):
    """with all codes of the addresses, those that no index has included."""
    held, stored = codes.fingerprints(copies), codes.addresses(copies)
    one, two = (r["address"] for r in stored.orderBy("address").limit(2).collect())
    pairs = spark.createDataFrame([(0, "positives", one, two)], "k long, kind string, a string, b string")
    strict = spark.createDataFrame([], "address string")
    index = similarity.Index(held.filter("code_id > '8'").unionByName(held.join(stored.filter(F.col("address").isin(one, two)).select("code_id"), "code_id", "left_semi")).dropDuplicates(["code_id"]))
    assert index.keyed.count() < 60
    assert {r["benign_total"] for r in calibration.evaluate(pairs, strict, stored, held, index=index).collect()} == {58}


def test_all_pairs_use_the_store_index(spark):
    """F2: scores of sets are written once, and the plan has only the two joins that bring the codes to them."""
    assert optimized(queries.QUERIES["s1_score_pairs"](spark, SF)).count("Join ") == 2


def shares_of(frame):
    """The most tasks that pairs with one code come from."""
    frame = frame if "task" in frame.columns else frame.withColumn("task", F.spark_partition_id())
    return frame.groupBy("b").agg(F.countDistinct("task").alias("n")).agg(F.max("n")).first()[0]


@pytest.fixture
def shuffled(spark):
    """Joins as on tables that are not small."""
    names = [f"spark.sql.{x}autoBroadcastJoinThreshold" for x in ("", "adaptive.")]
    for name in names:
        spark.conf.set(name, "-1")
    yield
    for name in names:
        spark.conf.unset(name)


def test_pairs_with_a_set_are_dealt_to_many_tasks(spark, copies, shuffled, monkeypatch):
    """F1: codes of one set are no task's alone, each pair is there once, and nothing is made that scores of selectors do not need."""
    held = codes.fingerprints(copies).select(*similarity.FIELDS).localCheckpoint()
    want = [(a[0], b[0], 1.0) for a in held.select("code_id").collect() for b in held.select("code_id").collect()]
    for most in (1, 7, 60):
        monkeypatch.setattr(similarity, "SHARE", most)
        pairs = similarity.score_pairs(held, held, 0.75, similarity.Index(held), whole=True)
        assert sorted(map(tuple, pairs.collect())) == sorted(want)
        assert (shares_of(pairs) > 1) == (most < 60)
    store = queries.Store(spark, SF)
    rows, index = store.scored
    similarity.score_pairs(rows, rows, 0.75, index, whole=True)
    assert not {"codes", "index"} & set(store.__dict__) and not {"runs", "classes"} & set(index.__dict__)
    assert sorted(rows.collect()) == sorted(store.codes.select(rows.columns).collect())


def test_pairs_by_text_are_dealt_to_many_tasks(spark, shuffled, monkeypatch):
    """codes of one set are no task's alone in the SQL text either, and each pair is there once."""
    run = queries.QUERIES["s1_score_pairs_sql"]
    found = []
    for most in (10**6, 2):
        monkeypatch.setattr(similarity, "SHARE", most)
        pairs = run(spark, SF).withColumn("task", F.spark_partition_id()).localCheckpoint()
        found.append(sorted(map(tuple, pairs.drop("task").collect())))
        assert (shares_of(pairs) > 1) == (most == 2)
    assert found[0] == found[1] and len(found[0]) == len(set(found[0])) > 100
