"""Projects, users, versions and edit sessions as tables: what may be added, changed and removed, and listings.

Each operation takes tables and returns tables; a caller writes them where it keeps them. Requests are tables, too, so one
call serves one request or a million.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from plinth.operators.numbering import numbered
from plinth.operators.relational import merged_settings, orphaned, without
from plinth.session import spare

CATEGORIES = ["beam", "column", "wall", "slab"]
#: Categories that use a selection box.
BOXED = ["beam", "column"]


def added(table: DataFrame, requests: DataFrame, unique: str) -> tuple[DataFrame, DataFrame]:
    """(the table with the requests that are new by ``unique``, the refused ones). Among requests with one value
    the first by ``id`` counts; ids of new rows follow the table's greatest."""
    place, known, ok = (spare([*table.columns, *requests.columns], n) for n in ("place", "known", "accepted"))
    rank = F.row_number().over(Window.partitionBy(unique).orderBy("id"))
    fresh = requests.withColumn(place, rank)
    taken = fresh.join(table.select(F.col(unique).alias(known)).distinct(), fresh[unique] == F.col(known), "left")
    taken = taken.withColumn(ok, F.col(known).isNull() & (F.col(place) == 1) & F.col(unique).isNotNull())
    start = table.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    new = numbered(taken.filter(ok).drop(place, known, ok), ["id"], place, start)
    new = new.drop("id").withColumnRenamed(place, "id").select(*table.columns)
    return table.unionByName(new), taken.filter(~F.col(ok)).select(*requests.columns)


def project_code(prefix: str, at: Column, seed: Column) -> Column:
    """H9: prefix, date and six hex digits of a seed's hash."""
    return F.concat(F.lit(f"{prefix}-"), F.date_format(at, "yyyyMMdd"), F.lit("-"), F.upper(F.substring(F.sha2(seed.cast("string"), 256), 1, 6)))


def updated_settings(table: DataFrame, patches: DataFrame) -> DataFrame:
    """Settings (map<string,string>) merged with the patch of the same id; rows without one stay."""
    both = table.join(patches.select("id", F.col("settings").alias("_patch")), "id", "left")
    return both.withColumn("settings", F.when(F.col("_patch").isNull(), F.col("settings")).otherwise(merged_settings(F.coalesce("settings", F.create_map().cast("map<string,string>")), F.col("_patch")))).drop("_patch").select(*table.columns)


def form_json(text: Column, schema: str) -> Column:
    """Blank, ``null`` and invalid JSON are null."""
    return F.when(~F.coalesce(F.trim(text), F.lit("")).isin("", "null"), F.from_json(text, schema))


def sessions_started(sessions: DataFrame, commits: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (project_id, commit_id, ...) whose commit is the project's."""
    own = commits.select(F.col("id").alias("commit_id"), "project_id")
    return sessions.unionByName(requests.join(own, ["commit_id", "project_id"], "left_semi").select(*sessions.columns))


def sessions_ended(sessions: DataFrame, ends: DataFrame) -> DataFrame:
    """T4: open sessions end at the time of the request with their id, whose notes follow theirs on a line of its own; one
    that has ended stays."""
    both = sessions.join(ends.select("id", F.col("ended_at").alias("_at"), F.col("notes").alias("_notes")), "id", "left")
    now = F.col("ended_at").isNull() & F.col("_at").isNotNull()
    notes = F.when(now & F.col("_notes").isNotNull(), F.concat_ws("\n", "notes", "_notes")).otherwise(F.col("notes"))
    return both.withColumn("notes", notes).withColumn("ended_at", F.when(now, F.col("_at")).otherwise(F.col("ended_at"))).select(*sessions.columns)


def listed_sessions(sessions: DataFrame, project_id: int, active_only: bool = False) -> DataFrame:
    """A project's sessions, the latest first."""
    own = sessions.filter(F.col("project_id") == project_id)
    return (own.filter(F.col("ended_at").isNull()) if active_only else own).orderBy(F.col("started_at").desc_nulls_first(), F.col("id").desc())


def project_removed(tables: dict[str, DataFrame], project_ids: DataFrame) -> dict[str, DataFrame]:
    """All rows of projects and of their versions go; versions of other projects lose their link to one that went."""
    gone = tables["commits"].join(project_ids.select(F.col("project_id").alias("_p")), F.col("project_id") == F.col("_p"), "left_semi").select(F.col("id").alias("commit_id"))
    keys = {"projects": "id", "files": "project_id", "commits": "project_id", "edit_sessions": "project_id"}
    out = without(tables, project_ids, {k: v for k, v in keys.items() if k in tables})
    out = without(out, gone, {k: "commit_id" for k in ("entities", "block_defs", "block_inserts", "schedule_runs") if k in tables})
    return out | {"commits": orphaned(out["commits"], gone)}


def user_removed(tables: dict[str, DataFrame], user_ids: DataFrame, references: dict[str, str]) -> dict[str, DataFrame]:
    """Users and their sessions go; ``references`` (table -> column) are nulled."""
    out = without(tables, user_ids, {k: v for k, v in {"users": "id", "edit_sessions": "editor_user_id"}.items() if k in tables})
    return out | {name: orphaned(out[name], user_ids, column) for name, column in references.items()}


def extractable(commits: DataFrame, requests: DataFrame) -> DataFrame:
    """E5: requests (commit_id, category) with why each is refused: unknown commit, not READY, unknown category; else null."""
    own = commits.select(F.col("id").alias("commit_id"), "status")
    both = requests.join(own, "commit_id", "left")
    why = F.when(F.col("status").isNull(), "unknown commit").when(F.col("status") != "READY", "not ready").when(~F.col("category").isin(CATEGORIES), "unknown category")
    return both.withColumn("refused", why).drop("status")
