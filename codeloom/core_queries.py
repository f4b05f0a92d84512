"""Queries of the general training-data problems (p4, p5) over the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from codeloom.operators import hierarchy
from codeloom.operators.changefeed import ChangeFeed, pending
from codeloom.session import cut, read_table, remove_path, scratch_path

#: In a contains row the source is the parent, in an extends row the target.
CHILD_IS_TARGET = {"contains": True, "extends": False}


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.links_of(read_table(spark, sf_dir, "edges"), CHILD_IS_TARGET)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kind, node_id, standing) of the nodes on or below a loop."""
    return hierarchy.loop_standing(_links(spark, sf_dir))


def p4_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path, depth, root and number of descendants of every node of both hierarchies."""
    return hierarchy.tree_summary(_links(spark, sf_dir))


def p4_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (ancestor, descendant) pair off loops with its distance."""
    return hierarchy.descendants(_links(spark, sf_dir)).withColumn("distance", F.col("distance").cast("long"))


def _scan_feed(spark: SparkSession, sf_dir: str, fail_first: bool) -> DataFrame:
    files, runs = read_table(spark, sf_dir, "files"), read_table(spark, sf_dir, "index_runs")
    feed = ChangeFeed(spark, f"{sf_dir}/file_scans.parquet", scratch_path(spark, "scan-feed"))
    process = lambda scans: pending(scans, files, runs)
    if fail_first:
        try:
            feed.run(process, fail_before="commit")
        except RuntimeError:
            pass
    feed.run(process)
    rows = cut(feed.delivered())
    feed.drop()
    return rows


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(project_id, path) of the scanned paths that a run has to process."""
    return _scan_feed(spark, sf_dir, False).select("project_id", "path")


def p5_replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(project_id, path, reason) as delivered when the first run dies before its commit and the next one replays it."""
    return _scan_feed(spark, sf_dir, True).select("project_id", "path", "reason")


def _in_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scans with the batch, 0 to 2, in which they arrive: late ones and ones at equal times among them."""
    return read_table(spark, sf_dir, "file_scans").withColumn("arrival", F.coalesce(F.second("scanned_at") % 3, F.lit(0)))


def p5_three_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(batch, project_id, path, reason) as three runs deliver the scans in three parts, the second dying before its commit at first."""
    root = scratch_path(spark, "three-runs")
    files, runs, scans = read_table(spark, sf_dir, "files"), read_table(spark, sf_dir, "index_runs"), _in_three(spark, sf_dir)
    feed = ChangeFeed(spark, f"{root}/log", f"{root}/state")
    process = lambda rows: pending(rows, files, runs)
    for batch in range(3):
        scans.where(F.col("arrival") == batch).drop("arrival").write.mode("append").parquet(f"{root}/log")
        if batch == 1:
            try:
                feed.run(process, fail_before="commit")
            except RuntimeError:
                pass
        feed.run(process)
    out = cut(feed.committed().select(F.col("batch").cast("long").alias("batch"), "project_id", "path", "reason"))
    remove_path(spark, root)
    return out


QUERIES = {"p4_found": p4_found, "p4_hierarchy": p4_hierarchy, "p4_descendants": p4_descendants, "p5_found": p5_found, "p5_replayed": p5_replayed, "p5_three_runs": p5_three_runs}

_LINKS = """
links as (
  select distinct kind,
         case when kind = 'contains' then source_id else target_id end as parent,
         case when kind = 'contains' then target_id else source_id end as child
  from edges where kind in ('contains', 'extends') and source_id is not null and target_id is not null),
reach(kind, up, down) as (
  select kind, parent, child from links
  union select r.kind, r.up, l.child from reach r join links l on l.kind = r.kind and l.parent = r.down),
looped as (select kind, up as node_id from reach where up = down),
standing as (
  select kind, node_id, 'on_cycle' as standing from looped
  union
  select r.kind, r.down, 'below_cycle' from reach r join looped c on c.kind = r.kind and c.node_id = r.up
  where not exists (select 1 from looped x where x.kind = r.kind and x.node_id = r.down))
"""

def _pending_sql(scans: str, name: str = "judged") -> str:
    """A CTE ``name`` (project_id, path, scanned_at, h, reason) over the latest scans of each path in ``scans``."""
    return f"""
scan_{name} as (
  select project_id, path, scanned_at, lower(content_hash) as h from {scans} where project_id is not null and path is not null
  qualify row_number() over (partition by project_id, path order by scanned_at desc nulls last, lower(content_hash) desc nulls last) = 1),
{name} as (
  select s.project_id, s.path, s.scanned_at, s.h,
    case when k.path is null then 'new'
         when s.h is distinct from k.h then 'changed'
         when k.error is not null then 'error'
         when w.path is not null and coalesce(u.status, '') not in ('completed', 'completed_with_errors') then 'unfinished_run' end as reason
  from scan_{name} s left join kept k using (project_id, path) left join wrote w using (project_id, path)
  left join (select project_id, started_at, arg_max(status, id) as status from index_runs group by all) u
    on u.project_id = w.project_id and u.started_at = w.started_at)"""


_STORED = """
kept as (
  select project_id, path, lower(content_hash) as h, error, indexed_at from files where project_id is not null and path is not null
  qualify row_number() over (partition by project_id, path
    order by indexed_at desc nulls last, lower(content_hash) desc nulls last, error desc nulls last) = 1),
wrote as (
  select k.project_id, k.path, max(r.started_at) as started_at
  from kept k join index_runs r on r.project_id = k.project_id and r.started_at <= k.indexed_at group by all)"""
_PENDING = f"{_STORED}, {_pending_sql('file_scans')}"


def _unseen_sql(batch: int) -> str:
    """What the sink takes of a batch: nothing older than, or equal to, what the earlier ones delivered."""
    earlier = " union all ".join(f"select {b} as b, * from d{b}" for b in range(batch)) or "select 0 as b, * from j0 where false"
    return f"""
d{batch} as (
  select j.* from j{batch} j left join (
    select project_id, path, max(scanned_at) as seen_at, arg_max(h, (scanned_at, b)) as seen_h from ({earlier}) group by all) e using (project_id, path)
  where j.reason is not null and not coalesce(j.scanned_at < e.seen_at or (j.scanned_at = e.seen_at and j.h is not distinct from e.seen_h), false))"""


_THREE = ", ".join(
    [_STORED]
    + [f"f{b} as (select * from file_scans where coalesce(cast(extract(second from scanned_at) as int) % 3, 0) = {b}), {_pending_sql(f'f{b}', f'j{b}')}" for b in range(3)]
    + [_unseen_sql(b) for b in range(3)]
)

ORACLE = {
    "p4_found": f"with recursive {_LINKS} select kind, node_id, standing from standing",
    "p4_descendants": f"""with recursive {_LINKS},
      free as (select l.* from links l where not exists (select 1 from standing s where s.kind = l.kind and s.node_id = l.child)),
      walk(kind, up, down, distance) as (
        select kind, parent, child, 1 from free
        union select w.kind, w.up, f.child, w.distance + 1 from walk w join free f on f.kind = w.kind and f.parent = w.down)
      select kind, up as ancestor_id, down as descendant_id, cast(min(distance) as bigint) as distance from walk group by all""",
    "p4_hierarchy": f"""with recursive {_LINKS},
      nodes as (select kind, parent as node_id from links union select kind, child from links),
      free as (select l.* from links l where not exists (select 1 from standing s where s.kind = l.kind and s.node_id = l.child)),
      first_parent as (select kind, child, min(parent) as parent from free group by all),
      tree(kind, node_id, root_id, depth, path) as (
        select n.kind, n.node_id, n.node_id, cast(0 as bigint), n.node_id from nodes n
        where not exists (select 1 from links l where l.kind = n.kind and l.child = n.node_id)
        union all
        select f.kind, f.child, t.root_id, t.depth + 1, t.path || '/' || f.child
        from tree t join first_parent f on f.kind = t.kind and f.parent = t.node_id),
      below as (select r.kind, r.up as node_id, count(*) as n from (select distinct kind, up, down from reach) r
        where not exists (select 1 from standing s where s.kind = r.kind and s.node_id = r.down) group by all)
      select n.kind, n.node_id, t.root_id, t.depth, t.path,
        case when s.standing is null then coalesce(b.n, 0) end as descendants, coalesce(s.standing, 'tree') as standing
      from nodes n left join tree t using (kind, node_id) left join below b using (kind, node_id) left join standing s using (kind, node_id)""",
    "p5_found": f"with {_PENDING} select project_id, path from judged where reason is not null",
    "p5_three_runs": f"with {_THREE} " + " union all ".join(f"select cast({b} as bigint) as batch, project_id, path, reason from d{b}" for b in range(3)),
    "p5_replayed": f"with {_PENDING} select project_id, path, reason from judged where reason is not null",
}
