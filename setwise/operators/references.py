"""References to records that do not exist (problem 6).

References are grouped by their null mask; every mask is matched on its non-null
columns only, under the declared match semantics (SQL's MATCH SIMPLE, PARTIAL or
FULL). A target may have a life time; then a match before its start or after its
end is an orphan too.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scale import key_text, skew_join


def find_orphans(refs: DataFrame, targets: DataFrame, keys: list[str], match: str = "simple", at: str | None = None) -> DataFrame:
    """The rows of refs whose key names no target, with the column kind: 'missing', 'late' or 'deleted' ('mixed' under FULL).

    refs and targets both have the columns `keys` (at most 6). With `at`, a time
    column of refs, targets has created_at and removed_at: 'late' if the target's
    earliest created_at is after the time (or it has none), 'deleted' if its
    earliest removed_at is not after it, late first. A null time is checked for
    'missing' only.

    match, for keys that are partly null: 'simple' - never an orphan; 'partial' -
    some target must agree in the non-null columns; 'full' - always an orphan
    ('mixed'). Wholly null keys are no orphans. Null keys in targets match nothing
    but a mask that leaves them out. Targets are reduced to one row a key before
    they are joined, and hot keys of refs are split off (scale.skew_join).
    """
    if match not in ("simple", "partial", "full"):
        raise ValueError(f"unknown match semantics: {match}")
    if len(keys) > 6:
        raise ValueError("at most 6 key columns")
    life = [F.min("created_at").alias("_created"), F.min("removed_at").alias("_removed")] if at else []
    # The rest of a row travels in one struct, so that no name of it can clash; a column kind is replaced.
    keep = [c for c in refs.columns if c != "kind"]
    refs = refs.select(*keys, *([F.col(at).alias("_at")] if at else []), F.struct(*keep).alias("_row"))
    out = None
    for mask in product((True, False), repeat=len(keys)):
        if not any(mask) or (not all(mask) and match == "simple"):
            continue
        cond = F.lit(True)
        for k, there in zip(keys, mask):
            cond = cond & (F.col(k).isNotNull() if there else F.col(k).isNull())
        part = refs.where(cond)
        on = [k for k, there in zip(keys, mask) if there]
        if not all(mask) and match == "full":
            found = part.withColumn("kind", F.lit("mixed"))
        else:
            alive = targets.dropna(subset=on).groupBy(*on).agg(F.lit(True).alias("_there"), *life)
            kind = F.when(F.col("_there").isNull(), "missing")
            if at:
                kind = kind.when(F.col("_at").isNotNull() & (F.col("_created").isNull() | (F.col("_created") > F.col("_at"))), "late").when(F.col("_removed") <= F.col("_at"), "deleted")
            found = skew_join(part, alive, on, "left").withColumn("kind", kind).where("kind is not null")
        found = found.select("_row", "kind")
        out = found if out is None else out.unionByName(found)
    return out.select("_row.*", "kind")


def declared_references(api_keys: DataFrame, job_messages: DataFrame, job_statuses: DataFrame, scheduled_tasks: DataFrame) -> DataFrame:
    """(ref_table, row_id, target, target_key, at) of every non-null reference; target is the kind of record it names."""

    def refs(df: DataFrame, name: str, target: str, row_id: str, key, at: str) -> DataFrame:
        return df.select(F.lit(name).alias("ref_table"), F.col(row_id).cast("string").alias("row_id"), F.lit(target).alias("target"), key_text(key).alias("target_key"), F.col(at).alias("at"))

    return (
        refs(api_keys.withColumn("_g", F.explode("grants")), "api_keys", "grant", "api_key", F.col("_g"), "created_at")
        .unionByName(refs(job_messages, "job_messages", "job", "message_id", F.col("job_id"), "sent_at"))
        .unionByName(refs(job_statuses, "job_statuses", "job", "status_id", F.col("job_id"), "reported_at"))
        .unionByName(refs(scheduled_tasks, "scheduled_tasks", "key", "task_id", F.col("api_key"), "scheduled_at"))
        .where("target_key is not null")
    )


def declared_targets(grants: DataFrame, jobs: DataFrame, api_keys: DataFrame) -> DataFrame:
    """(target, target_key, created_at, removed_at) of all grants, jobs and API keys, a removal in a further row included."""
    one = lambda df, name, key: df.select(F.lit(name).alias("target"), key_text(F.col(key)).alias("target_key"), "created_at", "removed_at")
    return one(grants, "grant", "grant_id").unionByName(one(jobs, "job", "job_id")).unionByName(one(api_keys, "key", "api_key"))


def orphan_references(api_keys: DataFrame, job_messages: DataFrame, job_statuses: DataFrame, scheduled_tasks: DataFrame, grants: DataFrame, jobs: DataFrame) -> DataFrame:
    """(ref_table, row_id, target_key, kind, period), distinct: the references whose target does not exist at their time."""
    refs = declared_references(api_keys, job_messages, job_statuses, scheduled_tasks)
    found = find_orphans(refs, declared_targets(grants, jobs, api_keys), ["target", "target_key"], "simple", "at")
    return found.select("ref_table", "row_id", "target_key", "kind", F.date_format("at", "yyyy-MM").alias("period")).distinct()


def orphan_report(found: DataFrame) -> DataFrame:
    """(ref_table, period, kind, orphans): counts per table and month."""
    return found.groupBy("ref_table", "period", "kind").agg(F.count("*").alias("orphans"))
