from pyspark.sql import functions as F

from plinth.operators import records as R


def test_users_are_unique(spark):
    users = spark.createDataFrame([(1, "a", "a@x"), (7, "b", "b@x")], "id long, name string, email string")
    asked = spark.createDataFrame([(1, "c", "c@x"), (2, "d", "c@x"), (3, "e", "b@x"), (4, "f", "f@x"), (5, "g", None)], users.schema)
    table, refused = R.added(users, asked, "email")
    assert {(r.id, r.name) for r in table.collect()} == {(1, "a"), (7, "b"), (8, "c"), (9, "f")}
    assert {r.name for r in refused.collect()} == {"d", "e", "g"}


def test_settings_and_codes(spark):
    t = spark.createDataFrame([(1, {"a": "1", "sub_tags": '{"x":"1","y":"2"}'}), (2, None), (3, {"a": "3"})], "id long, settings map<string,string>")
    patch = spark.createDataFrame([(1, {"a": "9", "sub_tags": '{"y":"7"}'}), (2, {"b": "2"})], t.schema)
    got = {r.id: r.settings for r in R.updated_settings(t, patch).collect()}
    assert got == {1: {"a": "9", "sub_tags": '{"x":"1","y":"7"}'}, 2: {"b": "2"}, 3: {"a": "3"}}
    row = spark.range(1).select(R.project_code("P", F.lit("2024-05-06").cast("date"), F.lit(1)).alias("c"), R.form_json(F.lit(" null "), "a int").alias("n"), R.form_json(F.lit('{"a": 1}'), "a int").alias("j")).first()
    assert row.c.startswith("P-20240506-") and len(row.c) == 17 and row.n is None and row.j.a == 1


def test_sessions(spark):
    schema = "id long, project_id long, commit_id long, editor_user_id long, started_at string, ended_at string, notes string"
    sessions = spark.createDataFrame([(1, 1, 10, 5, "t1", None, "n"), (2, 1, 10, 5, "t2", "t3", None)], schema)
    commits = spark.createDataFrame([(10, 1), (20, 2)], "id long, project_id long")
    asked = spark.createDataFrame([(3, 1, 10, 6, "t4", None, None), (4, 1, 20, 6, "t5", None, None)], schema)
    got = R.sessions_started(sessions, commits, asked)
    assert [r.id for r in R.listed_sessions(got, 1).collect()] == [3, 2, 1]
    ended = R.sessions_ended(got, spark.createDataFrame([(1, "t9", "bye"), (2, "t9", "no")], "id long, ended_at string, notes string"))
    assert {r.id: (r.ended_at, r.notes) for r in ended.collect()} == {1: ("t9", "n\nbye"), 2: ("t3", None), 3: (None, None)}
    assert [r.id for r in R.listed_sessions(ended, 1, True).collect()] == [3]


def test_removal(spark):
    tables = {
        "projects": spark.createDataFrame([(1,), (2,)], "id long"),
        "commits": spark.createDataFrame([(10, 1, None, 5), (20, 2, 10, 5), (21, 2, 20, 6)], "id long, project_id long, parent_commit_id long, created_by long"),
        "entities": spark.createDataFrame([(10,), (20,)], "commit_id long"),
        "edit_sessions": spark.createDataFrame([(1, 1, 5), (2, 2, 5)], "id long, project_id long, editor_user_id long"),
        "users": spark.createDataFrame([(5,), (6,)], "id long"),
    }
    out = R.project_removed(tables, spark.createDataFrame([(1,)], "project_id long"))
    assert {(r.id, r.parent_commit_id) for r in out["commits"].collect()} == {(20, None), (21, 20)}
    assert [r.commit_id for r in out["entities"].collect()] == [20] and out["projects"].count() == out["edit_sessions"].count() == 1
    out = R.user_removed(tables, spark.createDataFrame([(5,)], "id long"), {"commits": "created_by"})
    assert {(r.id, r.created_by) for r in out["commits"].collect()} == {(10, None), (20, None), (21, 6)}
    assert out["users"].count() == 1 and out["edit_sessions"].count() == 0


def test_extract_requests(spark):
    commits = spark.createDataFrame([(1, "READY"), (2, "PENDING")], "id long, status string")
    asked = spark.createDataFrame([(1, "beam"), (1, "roof"), (2, "beam"), (3, "beam")], "commit_id long, category string")
    assert [r.refused for r in R.extractable(commits, asked).orderBy("commit_id", "category").collect()] == [None, "unknown category", "not ready", "unknown commit"]
