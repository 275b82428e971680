"""Relations of users, projects and tasks: lookups, nesting, search, paging and counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions import columns as C
from sparkloom.functions.ordering import numbered

UNASSIGNED = "Unassigned"
SECRETS = ("hashed_password",)


def find_by_id(df: DataFrame, value, key: str = "id") -> DataFrame:
    """The rows of one id. The value is cast to the key's type, never the column, so the filter reaches the scan; a text that
    is no value of that type finds nothing."""
    return df.where(F.col(key) == F.lit(value).try_cast(df.schema[key].dataType))


def search_name(df: DataFrame, term: str, name: str = "name") -> DataFrame:
    """Rows whose name contains the trimmed term, in any case; an empty term finds all."""
    return df.where(F.lower(name).contains(term.strip().lower()))


def search_fields(df: DataFrame, term: str, names: Sequence[str]) -> DataFrame:
    """Rows where any listed column contains the term, in any case. Null, empty, 0 and false never match; an empty term
    finds all."""
    if not term:
        return df
    hits = []
    kinds = dict(df.dtypes)
    for n in names:
        c = F.col(n)
        solid = c.isNotNull() & (c if kinds[n] == "boolean" else c != (F.lit("") if kinds[n] == "string" else F.lit(0)))
        hits.append(F.coalesce(solid & F.lower(c.cast("string")).contains(term.lower()), F.lit(False)))
    found = hits[0]
    for h in hits[1:]:
        found = found | h
    return df.where(found)


def of_parent(df: DataFrame, parent_id: int | None, key: str = "project_id") -> DataFrame:
    """Rows of one parent; none or 0 means all."""
    return df.where(F.col(key) == parent_id) if parent_id else df


def public(users: DataFrame) -> DataFrame:
    return users.drop(*SECRETS)


#: Rows up to which a page is cut from a heap of all rows before it, and ranges that a range of keys is counted in.
HEAP, PARTS = 1000, 256


def page(df: DataFrame, skip: int = 0, limit: int = 10, key: str = "id") -> DataFrame:
    """One page in the order of the key, nulls first; rows that share a key stand in any order. A page far into the table is
    found by counted ranges of a whole-number key (:func:`range_of`), so that only the ranges that hold it are read and
    sorted; for other keys, or a key that more than HEAP rows of a page's range share, rows are numbered by a sort."""
    if skip < 0 or not 1 <= limit <= 100:
        raise ValueError("skip must be 0 or more, limit from 1 to 100")
    if skip + limit <= HEAP:
        return df.orderBy(key).offset(skip).limit(limit)
    if not isinstance(df.schema[key].dataType, T.IntegralType):
        return _numbered_page(df, skip, limit, key)
    nulls, low, high = df.agg(F.count_if(F.col(key).isNull()), F.min(key), F.max(key)).first()
    if low is None or skip < nulls:  # the page begins among rows without a key
        return _numbered_page(df, skip, limit, key)
    first = range_of(df, skip - nulls, key, low, high)
    last = range_of(df, skip + limit - 1 - nulls, key, low, high)
    if first is None:
        return df.where("false")
    part = df.where(F.col(key).between(first[0], last[1] if last else high))
    return part.orderBy(key).offset(skip - nulls - first[2]).limit(limit) if first[3] <= HEAP else _numbered_page(part, skip - nulls - first[2], limit, key)


def page_after(df: DataFrame, after: int | str | None, limit: int = 10, key: str = "id") -> DataFrame:
    """The page that follows the key ``after`` (none: the first page), for reading on from page to page: a filter that reaches
    the scan, and a heap of one page. Keys are distinct; rows without one are on no page."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must be from 1 to 100")
    return (df.where(F.col(key).isNotNull()) if after is None else df.where(F.col(key) > after)).orderBy(key).limit(limit)


def range_of(df: DataFrame, position: int, key: str, low: int, high: int) -> tuple[int, int, int, int] | None:
    """(from key, to key, rows before, rows) of a range that holds the row at ``position`` (from 0) in the order of a whole-number
    key, and HEAP rows or fewer, unless a single key has more. Each round counts the rows of PARTS equal parts of the
    range that the last one found; from the second on, the filter prunes files. None where there are not so many rows."""
    before = 0
    while True:
        width = (high - low) // PARTS + 1
        near = df.where(F.col(key).between(low, high))
        part = F.expr(f"cast((cast(`{key}` as decimal(20,0)) - ({low}BD)) div {width}BD as int)")  # a span may not fit into a long
        rows = None
        for r in near.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect():
            if before + r["n"] > position:
                low, rows = low + r["part"] * width, r["n"]
                high = min(high, low + width - 1)
                break
            before += r["n"]
        if rows is None:
            return None
        if rows <= HEAP or low == high:
            return low, high, before, rows


def _numbered_page(df: DataFrame, skip: int, limit: int, key: str) -> DataFrame:
    placed = numbered(df, key, name="_place")
    return placed.where((F.col("_place") >= skip) & (F.col("_place") < skip + limit)).drop("_place")


def sorted_nulls_last(df: DataFrame, column: str, descending: bool = False, key: str = "id") -> DataFrame:
    """Sorted by the column, nulls last in either direction, ties by the key."""
    c = F.col(column)
    return df.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last(), key)


def numbered_nulls_last(df: DataFrame, column: str, descending: bool = False, key: str = "id") -> DataFrame:
    """All rows with their position (from 1) in the order of :func:`sorted_nulls_last`."""
    first = F.col(column).desc_nulls_last() if descending else F.col(column).asc_nulls_last()
    return numbered(df, first, key).withColumn("position", F.col("position") + 1)


def recent(df: DataFrame, n: int = 5, ts: str | None = None, key: str = "id") -> DataFrame:
    return df.orderBy(*([F.desc(ts)] if ts else []), key).limit(n)


def head(df: DataFrame, n: int = 5, ordinal: str = "id") -> DataFrame:
    return df.orderBy(ordinal).limit(n)


def tail(df: DataFrame, n: int = 5, ordinal: str = "id") -> DataFrame:
    return df.orderBy(F.desc(ordinal)).limit(n).orderBy(ordinal)


def task_project(tasks: DataFrame, projects: DataFrame) -> DataFrame:
    """Tasks with project_title; a missing or empty title is Unassigned."""
    titles = projects.select(F.col("id").alias("project_id"), F.col("title").alias("project_title"))
    return tasks.join(titles, "project_id", "left").withColumn("project_title", C.text_or(F.col("project_title"), UNASSIGNED))


def project_owner(projects: DataFrame, users: DataFrame) -> DataFrame:
    """Projects with owner, owner_email and the description's default."""
    owners = users.select(F.col("id").alias("owner_id"), F.col("username").alias("owner"), F.col("email").alias("owner_email"))
    out = projects.join(owners, "owner_id", "left").withColumn("owner", F.coalesce("owner", F.lit(UNASSIGNED)))
    return out.withColumn("owner_email", F.coalesce("owner_email", F.lit(""))).withColumn("description", C.text_or(F.col("description"), "No description"))


def _children(df: DataFrame, key: str, alias: str) -> DataFrame:
    """(key, alias): each parent's rows as a list in the order of their ids. A parent's list is one row by nature."""
    fields = ["id", *[c for c in df.columns if c != "id"]]
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(alias))


def children_in_chunks(df: DataFrame, key: str, alias: str, size: int = 10_000) -> DataFrame:
    """(key, chunk, alias): as lists, but of at most ``size`` rows each, for parents of any number of children. Rows are
    dealt to chunks in the order of their ids."""
    ranked = numbered(df.where(F.col(key).isNotNull()), key, "id", name="_at")
    first = ranked.groupBy(F.col(key).alias("_key")).agg(F.min("_at").alias("_first"))
    chunk = F.floor((F.col("_at") - F.col("_first")) / size)
    fields = ["id", *[c for c in df.columns if c != "id"]]
    return ranked.join(first, F.col(key) == F.col("_key")).groupBy(key, chunk.alias("chunk")).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(alias))


def _with_children(parents: DataFrame, children: DataFrame, key: str, alias: str) -> DataFrame:
    lists = _children(children, key, alias).withColumnRenamed(key, "id")
    return parents.join(lists, "id", "left").withColumn(alias, F.coalesce(alias, F.array().cast(lists.schema[alias].dataType)))


def nested_projects(projects: DataFrame, tasks: DataFrame) -> DataFrame:
    """Projects with the list of their tasks (empty if none)."""
    return _with_children(projects, tasks, "project_id", "tasks")


def nested_users(users: DataFrame, projects: DataFrame, tasks: DataFrame) -> DataFrame:
    """Users, without secrets, with the projects they own (each with tasks) and the tasks assigned to them. Children
    are grouped before they are joined, so no product of the two lists arises."""
    out = _with_children(public(users), nested_projects(projects, tasks), "owner_id", "projects")
    return _with_children(out, tasks, "assigned_to", "tasks")


def project_detail(projects: DataFrame, users: DataFrame, tasks: DataFrame) -> DataFrame:
    """Projects with owner, tasks and task_count."""
    return nested_projects(project_owner(projects, users), tasks).withColumn("task_count", F.size("tasks"))


def tracker_counts(users: DataFrame, projects: DataFrame, tasks: DataFrame) -> DataFrame:
    """One row: projects, tasks, users and pending tasks of the whole tables."""
    p = projects.agg(F.count(F.lit(1)).alias("projects"))
    t = tasks.agg(F.count(F.lit(1)).alias("tasks"), F.count_if(F.col("status") == "pending").alias("pending"))
    return p.crossJoin(t).crossJoin(users.agg(F.count(F.lit(1)).alias("users")))
