"""Names claimed in order of arrival, against going through all rows one by one."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tiffin.functions.text import name_key, plain_name_key
from tiffin.operators import clashes

SCHEMA = "at long, username string, email string"


def expected(rows):
    names, mails, out = set(), set(), []
    for at, name, mail in sorted(rows):
        a, b = name and name.strip().lower(), mail and mail.strip().lower()
        if (a is None or a not in names) and (b is None or b not in mails):
            names.add(a)
            mails.add(b)
            out.append(at)
    return out


def found(spark, rows):
    made = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted(r.at for r in clashes.first_come(made, ["username", "email"], ["at"]).collect())


@pytest.fixture(params=[0, 200_000], ids=["components", "one task"])
def bound(request, monkeypatch):
    monkeypatch.setattr(clashes, "ONE_TASK_ROWS", request.param)


def text(prefix, most):
    return st.one_of(st.none(), st.integers(0, most).map(lambda n: f"{prefix}{n}"))


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(text("n", 12), text("m", 12)), max_size=40))
def test_any_clashes_in_one_task(spark, pairs):
    rows = [(n, *pair) for n, pair in enumerate(pairs)]
    assert found(spark, rows) == expected(rows)


@settings(max_examples=3, deadline=None)
@given(st.lists(st.tuples(text("n", 12), text("m", 12)), min_size=10, max_size=40))
def test_any_clashes_by_components(spark, pairs):
    rows, before = [(n, *pair) for n, pair in enumerate(pairs)], clashes.ONE_TASK_ROWS
    clashes.ONE_TASK_ROWS = 0
    try:
        assert found(spark, rows) == expected(rows)
    finally:
        clashes.ONE_TASK_ROWS = before


def chain(length):
    """Each row shares its name with the row before and its address with the one after."""
    return [(n, f"n{n // 2}", f"m{(n + 1) // 2}") for n in range(length)]


def test_a_long_chain_takes_few_jobs(spark):
    rows = chain(1_000)
    made = spark.createDataFrame(rows, SCHEMA)
    spark.sparkContext.setJobGroup("clashes", "a chain")
    accepted = clashes.first_come(made, ["username", "email"], ["at"])
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("clashes"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(r.at for r in accepted.collect()) == expected(rows)
    assert jobs <= 12


def test_a_chain_and_a_crowd(spark, bound):
    rows = chain(150) + [(1_000 + n, "Crowd ", f"c{n}") for n in range(300)] + [(2_000 + n, None, None) for n in range(5)]
    assert found(spark, rows) == expected(rows)


def test_plain_keys_part_texts_as_the_collation_does(spark):
    signs = [chr(n) for n in range(32, 127)]
    texts = ["", *signs, *(a + b for a in signs for b in signs)]
    made = spark.createDataFrame([(t,) for t in texts], "t string").select(plain_name_key(F.col("t")).alias("k"), name_key(F.col("t")).alias("n"))
    assert made.filter("k IS NULL").count() == 0
    assert made.groupBy("n").agg(F.count_distinct("k").alias("many")).filter("many > 1").count() == 0
    assert made.select("n").distinct().count() == len({t.rstrip(" ").lower() for t in texts})
    assert made.select("k").distinct().count() == len({t.rstrip(" ").lower() for t in texts})


def test_other_texts_take_the_key_of_their_equal(spark):
    texts = ["jose", "José ", "JOSÉ", "Zoë", "zoé", "a\u0001b", "AB", "\uff41b", "tab\t", "tab", "straße", "STRASSE", "ÿ", "日本", "\u0001", ""]
    made = spark.createDataFrame([(c, t) for c in (0, 1) for t in texts if c == 0 or t != "jose"], "_column int, _text string")
    keyed = clashes.keyed(made).withColumn("_name", name_key(F.col("_text")))
    assert keyed.filter("_key IS NULL").count() == 0 and keyed.count() == made.count()
    assert keyed.groupBy("_column", "_name").agg(F.count_distinct("_key").alias("many")).filter("many > 1").count() == 0
    assert keyed.select("_column", "_key").distinct().count() == keyed.select("_column", "_name").distinct().count()


def test_plain_names_need_no_collation(spark, monkeypatch):
    rows = chain(40)
    made = spark.createDataFrame(rows, SCHEMA)
    stored = spark.createDataFrame([(None, "N3 ", "x"), (None, None, "M9")], SCHEMA)
    # The names in other spelling are compared by the collation, plain ones are not.
    monkeypatch.setattr(clashes, "name_key", None)
    taken = [r for r in rows if r[1] != "n3" and r[2] != "m9"]
    found = clashes.first_come(made, ["username", "email"], ["at"], stored)
    assert sorted(r.at for r in found.collect()) == expected(taken)


@pytest.mark.parametrize("small_rows", [0, 100_000])
def test_stored_texts_refuse_rows_that_then_claim_nothing(spark, bound, monkeypatch, small_rows):
    monkeypatch.setattr(clashes, "SMALL_ROWS", small_rows)
    rows = [(n, f"n{n // 2}", f"m{(n + 1) // 2}") for n in range(60)] + [(90, "Rene", "r@x"), (91, "rené", "s@x"), (92, "André ", "r@x"), (93, "free", "s@x")]
    stored = spark.createDataFrame([(None, "N3 ", "x"), (None, None, "M9"), (None, "RÉNE", None), (None, "andre", None)], SCHEMA)
    made = spark.createDataFrame(rows, SCHEMA).repartition(3)
    taken = [r for r in rows if r[1] != "n3" and r[2] != "m9" and r[0] not in (90, 91, 92)]
    found = clashes.first_come(made, ["username", "email"], ["at"], stored)
    assert sorted(r.at for r in found.collect()) == expected(taken)


def test_rounds_go_on_while_they_settle_most(spark, monkeypatch):
    monkeypatch.setattr(clashes, "ONE_TASK_ROWS", 60)
    monkeypatch.setattr(clashes, "components", None)
    draw = random.Random(5)
    rows = [(n, f"n{draw.randrange(2_000)}", f"m{draw.randrange(2_000)}") for n in range(4_000)]
    assert found(spark, rows) == expected(rows)
