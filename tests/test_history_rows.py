"""Replaced insights and lock reasons."""

from pyspark.sql import functions as F

from promolens.operators import history


def test_newest_of_repeated_fresh_rows_stays(spark):
    schema = "id long, event_id long, source string, generated_at long, benefit_level string"
    stored = spark.createDataFrame([(1, 7, "rules", 1, "Low"), (2, 8, "rules", 1, "Mid")], schema)
    fresh = spark.createDataFrame([(3, 7, "rules", 5, "Mid"), (4, 7, "rules", 9, "High"), (5, 7, "model", 2, "Low")], schema)
    got = {(r.event_id, r.source, r.benefit_level) for r in history.replace_insights(stored, fresh).collect()}
    assert got == {(8, "rules", "Mid"), (7, "rules", "High"), (7, "model", "Low")}


def test_lock_reason_is_kept_while_locked(spark):
    schema = "event_id long, is_locked boolean, locked_by string, locked_at long, lock_reason string, seq long"
    commands = spark.createDataFrame([(1, True, "a", 1, "checked", 1), (2, True, "b", 1, "x", 1), (2, False, "b", 2, "y", 2)], schema)
    got = {r.event_id: (r.is_locked, r.lock_reason) for r in history.lock_state(commands).collect()}
    assert got == {1: (True, "checked"), 2: (False, None)}


def test_edits_are_compared_with_the_edit_before(spark):
    events = spark.createDataFrame([(1, "A"), (2, "A")], "id long, title string")
    for f in history.EDITABLE[1:]:
        events = events.withColumn(f, F.lit(None).cast("string"))
    long = "x" * 5000
    schema = "event_id long, field_name string, new_value string, editor string, reason string, edited_at long"
    edits = spark.createDataFrame([
        (1, "title", "B", "e", "", 1), (1, "title", None, "e", "", 2), (1, "title", "A", "e", "", 3), (1, "title", "A", "e", "", 4),
        (1, "url", "z", "e", "", 1), (2, "title", long, "e", "", 1)], schema)
    audit = history.manual_edits(events, edits)
    got = sorted((r.edited_at, r.old_value, r.new_value) for r in audit.where("event_id = 1").collect())
    assert got == [(1, "A", "B"), (2, "B", None), (3, "B", "A")]
    assert {r.id: r.title for r in history.edit_updates(audit).collect()} == {1: "A", 2: long}


def test_a_null_edit_does_not_hide_the_last_value(spark):
    audit = spark.createDataFrame([(1, "title", "B", 1), (1, "title", None, 2)], "event_id long, field_name string, new_value string, edited_at long")
    assert history.edit_updates(audit).first().title == "B"


def test_all_sections_become_rows(spark):
    df = spark.createDataFrame([(1, {"money": ["5"], "b": ["x", "", "y" * 3000], "rate": ["10%"]})], "event_id long, m map<string,array<string>>")
    got = [(r.section_type, len(r.content), r.sort_order) for r in history.section_rows(df, F.col("m"), ("a", "b")).orderBy("sort_order").collect()]
    assert got == [("b", 1, 0), ("b", 3000, 1), ("money", 1, 2), ("rate", 3, 3)]
