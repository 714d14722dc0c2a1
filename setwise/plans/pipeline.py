"""Queries of the training-data problems 1 to 6, and the SQL that states the same results."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dedup, hierarchy, incremental, nested, references, rejects
from ..scale import shared_dir
from ..session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    trees = table(spark, d, "segment_trees")
    nodes = nested.tree_nodes(trees, "tree_id", "ctree")
    return nodes.unionByName(nested.tree_columns(trees, "tree_id", "slice_columns")).distinct()


def p1_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The chunks two arrays below a tree, linked to their column by its position."""
    trees = table(spark, d, "segment_trees")
    return nested.shred(trees, ["tree_id"], "slice_columns", ["chunks"]).distinct()


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return incremental.pending_messages(table(spark, d, "relay_events"), table(spark, d, "relay_checkpoints"))


def p2_runs(spark: SparkSession, d: str) -> DataFrame:
    """What two runs with a commit between them take in, and the intervals that they leave."""
    return incremental.relay_runs(table(spark, d, "relay_events"), f"{shared_dir(spark)}/ledgers/{uuid.uuid4().hex}")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.hierarchy_rows(table(spark, d, "api_keys"), table(spark, d, "accounts"))


def p3_paths(spark: SparkSession, d: str) -> DataFrame:
    """Full path (record ids from the root down) and number of descendants of every record in a tree."""
    return hierarchy.path_rows(table(spark, d, "api_keys"), table(spark, d, "accounts"))


def p3_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Every descendant of every record in a tree."""
    return hierarchy.descendant_rows(table(spark, d, "api_keys"), table(spark, d, "accounts"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return rejects.failed_lines(table(spark, d, "ingest_lines"), table(spark, d, "ingest_batches"))


def p4_results(spark: SparkSession, d: str) -> DataFrame:
    return rejects.batch_results(table(spark, d, "ingest_lines"), table(spark, d, "ingest_batches"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return dedup.surplus_deliveries(spark, f"{d}/relay_events.parquet")


def p5_messages(spark: SparkSession, d: str) -> DataFrame:
    """The one delivery kept of every message, with its payload."""
    kept = dedup.deduplicated_messages(spark, f"{d}/relay_events.parquet")
    return kept.select("delivery_id", "agent_id", "producer_id", "sequence_id", "event_kind", "api_key", "event_path", "event", "delivered_at")


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return references.orphan_references(*[table(spark, d, t) for t in ("api_keys", "job_messages", "job_statuses", "scheduled_tasks", "grants", "jobs")])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d)


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return references.orphan_report(_orphans(spark, d))


def p6_parents(spark: SparkSession, d: str) -> DataFrame:
    """Posts whose parent isn't there: the key (thread_id, parent_doc_id), partly null, under each match semantics."""
    docs = table(spark, d, "documents")
    refs = docs.select("doc_id", "thread_id", F.col("parent_doc_id").alias("post"))
    posts = docs.select("thread_id", F.col("doc_id").alias("post"))
    found = [references.find_orphans(refs, posts, ["thread_id", "post"], m).select(F.lit(m).alias("match"), "doc_id", "kind") for m in ("simple", "partial", "full")]
    return found[0].unionByName(found[1]).unionByName(found[2])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_chunks, p2_found, p2_runs, p3_found, p3_paths, p3_descendants, p4_found, p4_results, p5_found, p5_messages, p6_found, p6_report, p6_parents)
}

_OFFSETS = "(select *, coalesce(msg_offset, try_cast(event->>'$.offset' as bigint)) as off from relay_events)"

_FOREST = """
links as (
  select 'api_key' as entity, lower(trim(api_key, E' \\t\\r\\n')) as node, min(api_key) as node_id,
    min(nullif(nullif(lower(trim(issuer_key, E' \\t\\r\\n')), ''), '(undefined)')) as parent
  from api_keys group by 1, 2
  union all
  select 'account', cast(cast(trim(account_id, E' \\t\\r\\n') as bigint) as varchar), min(account_id),
    min(cast(try_cast(nullif(trim(parent_id, E' \\t\\r\\n'), '') as bigint) as varchar))
  from accounts group by 1, 2),
tree as (
  select l.entity, l.node, l.node_id, case when p.node <> l.node then p.node end as parent
  from links l left join links p on p.entity = l.entity and p.node = l.parent),
down as (
  select entity, node, node_id as root_id, 0 as depth, node_id as path from tree where parent is null
  union all
  select t.entity, t.node, d.root_id, d.depth + 1, d.path || '/' || t.node_id
  from tree t join down d on t.entity = d.entity and t.parent = d.node)"""

# Each step of the recursion takes one field off a line: a quoted one by its dialect's pattern, any other up to the delimiter.
_LINES = r"""
dialect as (
  select ingest_no, delimiter as d, quote_char as q, column_types as types, len(column_names) as width,
    '^' || q || '((?:[^' || q || e || ']|' || q || q || case when escape_char = quote_char then '' else '|' || e || '[' || q || e || ']|' || e || '[^' || q || e || ']' end || ')*)' || q as quoted
  from (select *, regexp_escape(quote_char) as q, regexp_escape(escape_char) as e from (select distinct ingest_no, delimiter, quote_char, escape_char, column_names, column_types from ingest_batches))),
cut as (
  select distinct l.ingest_no, l.line_no, regexp_replace(coalesce(raw_line, ''), '\r$', '') as line, d.* exclude (ingest_no) from ingest_lines l join dialect d on l.ingest_no = d.ingest_no),
step as (
  select ingest_no, line_no, line as rest, d, q, quoted, types, width, cast([] as varchar[]) as vals, false as done, false as bad from cut
  union all
  select ingest_no, line_no, case when closes then substr(tail, length(d) + 1) else '' end, d, q, quoted, types, width, list_append(vals, val), not closes, tail <> '' and not closes
  from (
    select *, starts_with(tail, d) as closes from (
      select *, case when whole then regexp_extract(rest, quoted, 1) when starts_with(rest, q) then '' when contains(rest, d) then split_part(rest, d, 1) else rest end as val,
        case when whole then substr(rest, length(regexp_extract(rest, quoted, 0)) + 1) when starts_with(rest, q) then 'unclosed' when contains(rest, d) then substr(rest, length(split_part(rest, d, 1)) + 1) else '' end as tail
      from (select *, starts_with(rest, q) and regexp_matches(rest, quoted, 's') as whole from step where not done)))),
split as (select * from step where done),
judged as (
  select distinct ingest_no, line_no, case when bad then 'quoting' when len(vals) <> width then 'columns'
    when len(list_filter(list_zip(list_transform(vals, lambda v: regexp_replace(regexp_replace(v, '^\s+', ''), '\s+$', '')), types), lambda p: p[1] <> '' and not case p[2]
      when 'long' then regexp_full_match(p[1], '-?[0-9]+') and try_cast(p[1] as bigint) is not null
      when 'double' then regexp_full_match(p[1], '-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?')
      when 'boolean' then lower(p[1]) in ('true', 'false')
      when 'timestamp' then regexp_full_match(p[1], '[0-9]{4}-[0-9]{2}-[0-9]{2}T([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]Z?') and try_cast(p[1][1:10] as date) is not null
      else true end)) > 0 then 'value' end as reason
  from split)"""

_ORPHANS = """
refs as (
  select 'api_keys' as ref_table, api_key as row_id, 'g' as t, unnest(grants) as k, created_at as cur from api_keys
  union all select 'job_messages', cast(message_id as varchar), 'j', job_id, sent_at from job_messages
  union all select 'job_statuses', cast(status_id as varchar), 'j', job_id, reported_at from job_statuses
  union all select 'scheduled_tasks', task_id, 'k', api_key, scheduled_at from scheduled_tasks),
named as (select * exclude (k), lower(trim(k, E' \\t\\r\\n')) as target_key from refs where k is not null),
targets as (
  select t, k, min(created_at) as created, min(removed_at) as removed from (
    select 'g' as t, lower(trim(grant_id, E' \\t\\r\\n')) as k, created_at, removed_at from grants
    union all select 'j', lower(trim(job_id, E' \\t\\r\\n')), created_at, removed_at from jobs
    union all select 'k', lower(trim(api_key, E' \\t\\r\\n')), created_at, removed_at from api_keys) group by 1, 2),
found as (
  select distinct ref_table, row_id, target_key,
    case when t.k is null then 'missing' when created > cur then 'late' else 'deleted' end as kind,
    strftime(cur, '%Y-%m') as period
  from named n left join targets t on n.t = t.t and n.target_key = t.k
  where t.k is null or created > cur or removed <= cur)"""

ORACLE: dict[str, str] = {
    "p1_found": r"""
with recursive src as (
  select distinct tree_id, ltrim(ctree, chr(65279) || E' \t\r\n') as t from segment_trees where ctree is not null),
decoded as (select tree_id, case when t[1] = '"' then ltrim(json_extract_string(t, '$'), chr(65279) || E' \t\r\n') else t end as t from src),
n as (
  select tree_id, 'root' as kind, '' as node_path, '' as parent_path, cast(t as json) as j from decoded where t[1] = '{'
  union all
  select n.tree_id, case when p.part = 'indices' then 'index' else 'field' end,
    n.node_path || case when p.part = 'indices' then '[' || e.key || ']' when json_type(n.j, '$.fields') = 'ARRAY' then '.' || json_extract_string(e.value, '$.name') else '.' || e.key end,
    n.node_path,
    case when p.part = 'fields' and json_type(n.j, '$.fields') = 'ARRAY' then json_extract(e.value, '$.tree') else e.value end
  from n, (values ('fields'), ('indices')) p(part), json_each(n.j, '$.' || p.part) e
  where (p.part = 'fields' and json_type(n.j, '$.fields') in ('OBJECT', 'ARRAY')) or (p.part = 'indices' and json_type(n.j, '$.indices') = 'ARRAY' and json_type(e.value) <> 'NULL'))
select distinct tree_id, kind, node_path, parent_path from n where kind <> 'root'
union
select tree_id, 'column', s.selector || ':' || coalesce(s.ctype, ''), s.selector from (select tree_id, unnest(slice_columns) as s from segment_trees) where s.selector is not null""",
    "p1_chunks": """
select distinct tree_id, cast(slice_columns_pos - 1 as int) as slice_columns_pos, cast(chunks_pos - 1 as int) as chunks_pos,
  chunks[chunks_pos].chunk_no as chunk_no, chunks[chunks_pos].defined_rows as defined_rows
from (
  select tree_id, slice_columns_pos, chunks, unnest(range(1, len(chunks) + 1)) as chunks_pos
  from (
    select tree_id, slice_columns_pos, slice_columns[slice_columns_pos].chunks as chunks
    from (select tree_id, slice_columns, unnest(range(1, len(slice_columns) + 1)) as slice_columns_pos from segment_trees)))
where chunks[chunks_pos] is not null""",
    "p2_found": f"""
with good as (
  select agent_id, max_by(struct_pack(done_to := msg_offset, started := started_at, clock := message_clock), run_no) as r
  from relay_checkpoints where lower(trim(outcome)) = 'ok' and saved_at is not null group by 1),
clock as (
  select agent_id, u.producer_id as producer_id, max(u.sequence_id) as hi
  from (select agent_id, unnest(r.clock) as u from good) group by 1, 2)
select e.agent_id, e.off as msg_offset
from {_OFFSETS} e left join good g on g.agent_id = e.agent_id
left join clock c on c.agent_id = e.agent_id and c.producer_id = e.producer_id
where e.agent_id is not null and e.off is not null
group by 1, 2
having not bool_or(coalesce(e.off <= g.r.done_to and e.sequence_id <= c.hi, false))
  or bool_or(coalesce(e.changed_at > g.r.started, false))""",
    "p2_runs": f"""
with d as (select agent_id, off, delivered_at from {_OFFSETS} where agent_id is not null and off is not null),
half as (select (floor(epoch_us(min(delivered_at)) / 1e6) + floor(epoch_us(max(delivered_at)) / 1e6)) / 2 as h from d),
m as (select agent_id, off, case when bool_or(epoch_us(delivered_at) <= h * 1e6) then 1 else 2 end as run from d, half group by 1, 2),
g as (select agent_id, off, off - row_number() over (partition by agent_id order by off) as island from m)
select run, agent_id, count(*) as messages, min(off) as lowest, max(off) as highest from m group by 1, 2
union all
select 0, agent_id, count(distinct island), min(off), max(off) from g group by agent_id""",
    "p3_found": f"""
with recursive {_FOREST},
lost as (select * from tree t where not exists (select 1 from down d where d.entity = t.entity and d.node = t.node)),
walk as (
  select entity, node as origin, parent as cur, 1 as steps from lost
  union
  select w.entity, w.origin, l.parent, w.steps + 1 from walk w join lost l on l.entity = w.entity and l.node = w.cur
  where w.cur <> w.origin and w.steps < 200),
rings as (select distinct entity, origin from walk where cur = origin)
select d.entity, t.node_id, d.root_id, cast(d.depth as int) as depth from down d join tree t on t.entity = d.entity and t.node = d.node
union all
select l.entity, l.node_id, '', cast(case when r.origin is null then -2 else -1 end as int)
from lost l left join rings r on r.entity = l.entity and r.origin = l.node""",
    "p3_paths": f"""
with recursive {_FOREST},
up as (
  select entity, node as origin, parent as cur from tree
  union all
  select u.entity, u.origin, t.parent from up u join tree t on t.entity = u.entity and t.node = u.cur
  where exists (select 1 from down d where d.entity = u.entity and d.node = u.origin)),
n as (select entity, cur as node, count(*) as descendants from up where cur is not null group by 1, 2)
select d.entity, t.node_id, d.path, coalesce(n.descendants, 0) as descendants
from down d join tree t on t.entity = d.entity and t.node = d.node
left join n on n.entity = d.entity and n.node = d.node""",
    "p3_descendants": f"""
with recursive {_FOREST},
up as (
  select entity, node as origin, parent as cur from tree
  union all
  select u.entity, u.origin, t.parent from up u join tree t on t.entity = u.entity and t.node = u.cur
  where exists (select 1 from down d where d.entity = u.entity and d.node = u.origin))
select u.entity, a.node_id, b.node_id as descendant_id
from up u join tree a on a.entity = u.entity and a.node = u.cur join tree b on b.entity = u.entity and b.node = u.origin
where exists (select 1 from down d where d.entity = u.entity and d.node = u.origin)""",
    "p4_found": f"with recursive {_LINES} select * from judged where reason is not null",
    "p4_results": f"""
with recursive {_LINES}
select b.ingest_no, count(j.line_no) as total, count(case when j.line_no is not null and reason is null then 1 end) as ingested,
  count(case when reason = 'quoting' then 1 end) as quoting, count(case when reason = 'columns' then 1 end) as columns, count(case when reason = 'value' then 1 end) as value
from (select distinct ingest_no from ingest_batches) b left join judged j on j.ingest_no = b.ingest_no group by 1""",
    "p5_found": f"""
select delivery_id from (
  select delivery_id, row_number() over (partition by agent_id, off order by delivered_at, delivery_id) as rn
  from {_OFFSETS} where agent_id is not null and off is not null) where rn > 1""",
    "p5_messages": f"""
select delivery_id, agent_id, producer_id, sequence_id, event_kind, api_key, event_path, event, delivered_at from (
  select *, row_number() over (partition by agent_id, off order by delivered_at, delivery_id) as rn
  from {_OFFSETS}) where rn = 1 or agent_id is null or off is null""",
    "p6_found": f"with {_ORPHANS} select * from found",
    "p6_parents": """
with r as (
  select doc_id, thread_id as t, parent_doc_id as p,
    exists (select 1 from documents o where o.thread_id = d.thread_id and o.doc_id = d.parent_doc_id) as whole,
    exists (select 1 from documents o where (d.thread_id is null or o.thread_id = d.thread_id) and (d.parent_doc_id is null or o.doc_id = d.parent_doc_id)) as partly
  from documents d)
select 'simple' as match, doc_id, 'missing' as kind from r where t is not null and p is not null and not whole
union all
select 'partial', doc_id, 'missing' from r where (t is not null or p is not null) and not partly
union all
select 'full', doc_id, case when t is not null and p is not null then 'missing' else 'mixed' end from r
where (t is not null and p is not null and not whole) or ((t is null) <> (p is null))""",
    "p6_report": f"with {_ORPHANS} select ref_table, period, kind, count(*) as orphans from found group by 1, 2, 3",
}
