"""Foreign keys: exclusion closure, orphans and consistent subsets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablecloak.session import cut_lineage, local_rows

# A frontier is broadcast only when it was counted and has at most this many names.
BROADCAST_ROWS = 200_000


def _scope(edges: DataFrame) -> list[str]:
    """Edges of many databases carry a `database` column; the closure stays inside each."""
    return ["database"] if "database" in edges.columns else []


def fk_closure(edges: DataFrame, seed: DataFrame) -> DataFrame:
    """Seed tables plus every table that references one of them, directly or not.

    Breadth-first: each round joins the edges with the tables found last, so a table is
    expanded once and cycles end by themselves. Rounds = longest reference chain. Sizes are
    counted each round; a side is broadcast only while its count is small.
    """
    scope = _scope(edges)
    key = [*scope, "table"]
    edges = edges.select(*scope, "child", "parent").filter(
        F.col("child").isNotNull() & F.col("parent").isNotNull() & (F.col("child") != "")).persist()
    frontier = cut_lineage(seed.select(*key).filter(
        F.col("table").isNotNull() & (F.col("table") != "")).distinct())
    found, total = frontier, 0
    while (n := frontier.count()) > 0:
        total += n
        parents = frontier.withColumnRenamed("table", "parent")
        if n <= BROADCAST_ROWS:
            parents = F.broadcast(parents)
        children = (edges.join(parents, [*scope, "parent"], "left_semi")
                    .select(*scope, F.col("child").alias("table")))
        if total <= BROADCAST_ROWS:  # dropping what is known first leaves less to shuffle
            fresh = children.join(F.broadcast(found), key, "left_anti").distinct()
        else:  # repeated names are combined before the shuffle that the join then reuses
            fresh = children.distinct().join(found, key, "left_anti")
        frontier = cut_lineage(fresh)
        found = found.unionByName(frontier)
    edges.unpersist()
    return found


def fk_dangling(edges: DataFrame, excluded: DataFrame) -> DataFrame:
    """Edges whose parent is excluded while the child is kept."""
    scope = _scope(edges)
    names = excluded.select(*scope, "table").distinct()
    as_parent = names.withColumnRenamed("table", "parent")
    as_child = names.withColumnRenamed("table", "child")
    return (edges.select(*scope, "child", "parent")
            .join(as_parent, [*scope, "parent"], "left_semi")
            .join(as_child, [*scope, "child"], "left_anti"))


def cascade_exclusions(edges: DataFrame, excluded: DataFrame) -> DataFrame:
    """Tables the closure adds to the exclusions."""
    scope = _scope(edges)
    key = [*scope, "table"]
    return fk_closure(edges, excluded).join(excluded.select(*key).distinct(), key, "left_anti")


def exclude_dependents(database_setting: bool | None, default_setting: bool | None) -> bool:
    """Whether exclusions cascade: the database's own setting wins, also when it is false."""
    return bool(default_setting if database_setting is None else database_setting)


def fk_edges(constraints: DataFrame, tables: DataFrame) -> DataFrame:
    """Distinct child/parent names from constraint rows `(contype, conrelid, confrelid)` and
    table names `(oid, relname)`. The joins are on unique table ids."""
    fks = constraints.filter(F.col("contype") == "f").select("conrelid", "confrelid").distinct()
    child = tables.select(F.col("oid").alias("conrelid"), F.col("relname").alias("child"))
    parent = tables.select(F.col("oid").alias("confrelid"), F.col("relname").alias("parent"))
    return fks.join(child, "conrelid").join(parent, "confrelid").select("child", "parent").distinct()


def orphan_rows(child: DataFrame, parent: DataFrame,
                on: Sequence[tuple[str, str]]) -> DataFrame:
    """Child rows whose foreign key has no parent row; rows with a NULL key are no orphans.

    The parent keys go into the join as they are: an aggregate in between would keep Spark from
    splitting a key that many children share.
    """
    keys = parent.select(*[F.col(p).alias(c) for c, p in on])
    names = [c for c, _ in on]
    set_key = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in names])
    return child.filter(set_key).join(keys, names, "left_anti").select(*child.columns)


def truncate_tables(tables: Mapping[str, DataFrame], names: Sequence[str],
                    edges: DataFrame | None = None) -> dict[str, DataFrame]:
    """Empty the named tables; with `edges` also those that reference them.

    Only names of one dataset's tables reach the driver.
    """
    empty = set(names)
    if edges is not None:
        seed = local_rows(edges.sparkSession, [(n,) for n in names], "table string")
        mine = F.col("table").isin(*tables)
        empty |= {r["table"] for r in fk_closure(edges, seed).filter(mine).collect()}
    return {n: df.limit(0) if n in empty else df for n, df in tables.items()}


def keep_recent(df: DataFrame, ts_col: str, days: int, now: str) -> DataFrame:
    """Rows not older than `days` before `now`. The bound is a literal, so it reaches the scan."""
    data_type = df.schema[ts_col].dataType.simpleString()
    bound = F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))
    return df.filter(F.col(ts_col) >= bound.cast(data_type))


def prune_cascade(tables: Mapping[str, DataFrame], edges: Sequence[tuple[str, str, str, str]],
                  root: str, predicate: Column) -> dict[str, DataFrame]:
    """Delete matching root rows and everything that references them.

    `edges` are `(child, child_col, parent, parent_col)`. Tables are visited parents first. The keys
    to delete are narrow and are written once per level, so a deeper table does not work its
    parents out again. Tables that reference each other in a cycle, or one that references itself, are
    one component of the graph and are closed together, row by row.
    """
    children: dict[str, list[tuple[str, str, str]]] = {}
    for child, child_col, parent, parent_col in edges:
        children.setdefault(child, []).append((child_col, parent, parent_col))
    affected = {root}
    while more := {c for c, refs in children.items()
                   if c not in affected and any(p in affected for _, p, _ in refs)}:
        affected |= more

    out = dict(tables)
    keys: dict[tuple[str, str], DataFrame] = {}
    for group in _components(affected, children):
        hit: dict[str, DataFrame] = {}
        kept: dict[str, DataFrame] = {}
        for name in group:
            table = rest = tables[name]
            parts = []
            if name == root:
                parts, rest = [table.filter(predicate)], table.filter(~F.coalesce(predicate, F.lit(False)))
            for child_col, parent, parent_col in children.get(name, []):
                if parent in group or parent not in affected:
                    continue
                gone = keys[parent, parent_col].select(F.col(parent_col).alias(child_col))
                parts.append(rest.join(gone, child_col, "left_semi").select(*table.columns))
                rest = rest.join(gone, child_col, "left_anti").select(*table.columns)
            hit[name] = reduce(DataFrame.unionByName, parts) if parts else table.limit(0)
            kept[name] = rest
        inner = [(c, col, p, k) for c in group for col, p, k in children.get(c, []) if p in group]
        if inner:
            hit, kept = _close_component(hit, kept, inner)
        for name in group:
            used = sorted({k for c, refs in children.items() if c not in group for _, p, k in refs if p == name})
            if used:
                narrow = cut_lineage(hit[name].select(*used).distinct())
                keys.update({(name, k): narrow.select(k).filter(F.col(k).isNotNull()).distinct() for k in used})
            out[name] = kept[name]
    return out


def _components(affected: set[str], children: Mapping[str, list]) -> list[list[str]]:
    """Tables grouped by cycles, parents first: two tables belong together where each is above the other. A group
    has more tables above it than any group it references, itself counted."""
    parents = {n: {p for _, p, _ in children.get(n, []) if p in affected} for n in affected}
    above: dict[str, set[str]] = {}
    for name in affected:
        seen, todo = set(), [name]
        while todo:
            new = parents[todo.pop()] - seen
            seen |= new
            todo += new
        above[name] = seen
    groups = {frozenset({n} | {m for m in above[n] if n in above[m]}) for n in affected}
    return [sorted(g) for g in sorted(groups, key=lambda g: (len(g.union(*(above[n] for n in g))), sorted(g)))]


def _close_component(hit: Mapping[str, DataFrame], kept: Mapping[str, DataFrame],
                     inner: Sequence[tuple[str, str, str, str]]) -> tuple[dict, dict]:
    """Move rows of `kept` that reference a deleted row of any table of a component, directly or not.

    A fixpoint over all its tables at once: a round joins the key columns of the rows left, which are
    written once, with the keys that the round before it found in any table. Only new keys go on, so it
    ends also where rows reference each other in a ring."""
    tables = sorted({p for _, _, p, _ in inner})
    own = {t: sorted({k for _, _, p, k in inner if p == t}) for t in tables}
    refs = {t: [(col, p, k) for c, col, p, k in inner if c == t] for t in tables}
    narrow = {t: cut_lineage(kept[t].select(*sorted({*own[t], *(col for col, _, _ in refs[t])}))) for t in tables}
    frontier = {t: cut_lineage(hit[t].select(*own[t]).distinct()) for t in tables}
    gone = dict(frontier)
    open_ = {t for t in tables if not frontier[t].isEmpty()}
    while open_:
        found = {}
        for t in tables:
            parts = [narrow[t].join(frontier[p].select(F.col(k).alias(col)).filter(F.col(col).isNotNull()).distinct(),
                                    col, "left_semi").select(*own[t]) for col, p, k in refs[t] if p in open_]
            if parts:  # a set difference takes NULLs as equal, so a row with a key of NULL is not found twice
                found[t] = cut_lineage(reduce(DataFrame.unionByName, parts).subtract(gone[t]))
        gone |= {t: gone[t].unionByName(new) for t, new in found.items()}
        frontier = found
        open_ = {t for t, new in found.items() if not new.isEmpty()}
    gone = {t: cut_lineage(rows) for t, rows in gone.items()}
    hit, kept = dict(hit), dict(kept)
    for c, col, p, k in inner:  # whatever references a deleted key goes, also a row without a key of its own
        names = kept[c].columns
        keys = gone[p].select(F.col(k).alias(col)).filter(F.col(col).isNotNull()).distinct()
        hit[c] = hit[c].unionByName(kept[c].join(keys, col, "left_semi").select(*names))
        kept[c] = kept[c].join(keys, col, "left_anti").select(*names)
    return hit, kept
