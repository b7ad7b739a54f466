"""Data tasks: normalising, gating, ordering, completing, and running them on tables.

A task row is (ord, target, action, data: map<string,string>); flags in the data are the
texts true and false, lists are comma-separated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import lookup
from . import store

# Names, aliases and fields of the task language.
TARGET_ALIASES = {
    "review_sessions": "review_session", "review_session": "review_session", "curated_issues": "curated_issue", "curated_issue": "curated_issue",
    "issue_patterns": "issue_pattern", "issue_pattern": "issue_pattern", "issuepattern": "issue_pattern", "pattern": "issue_pattern",
    "session": "review_session", "issue": "curated_issue",
}
ACTION_ALIASES = {
    "insert": "create", "create": "create", "add": "create", "update": "update", "modify": "update", "upsert": "upsert", "create_or_update": "upsert",
    "delete": "delete", "remove": "delete", "delete_by_ids": "delete_by_ids", "delete_ids": "delete_by_ids", "delete_all": "delete_all", "truncate": "delete_all", "clear": "delete_all",
    "sync": "sync", "select": "query", "query": "query", "read": "query", "fetch": "query", "list": "query", "show": "query",
}
ACTIONS = ("create", "update", "delete", "delete_by_ids", "sync", "upsert", "query", "delete_all")
CONTROL = ("id", "limit", "offset", "ids", "confirm", "scope")
FIELDS = {
    "issue_pattern": ("title", "error_type", "language", "framework", "error_description", "problematic_pattern", "solution", "file_pattern", "class_pattern", "tags", "severity", "status", "layers", "pattern_id"),
    "curated_issue": ("session_id", "pattern_id", "project_path", "file_path", "start_line", "end_line", "code_snippet", "problem_phenomenon", "root_cause", "solution", "severity", "status", "issue_id", "session_db_id"),
    "review_session": ("session_id", "user_message", "code_directory", "status", "code_patch", "git_commit", "session_db_id"),
}
#: Besides id, the field that names the row itself.
OWN_ID = {"issue_pattern": "pattern_id", "curated_issue": "issue_id", "review_session": "session_db_id"}
ID_KEYS = ("id", "issue_id", "pattern_id", "session_db_id")
ORDER = {"issue_pattern": 0, "review_session": 1, "curated_issue": 2}


def value(key: str, data: Column | None = None) -> Column:
    return F.try_element_at(F.col("data") if data is None else data, F.lit(key))


def has(key: str) -> Column:
    return F.coalesce(value(key), F.lit("")) != ""


def delete_ids(data: Column | None = None) -> Column:
    """Distinct integers of the id keys, of id lists, and of ``id = n`` and ``id in (..)`` in a where text."""
    get = lambda k: value(k, data)
    listed = F.coalesce(F.nullif(get("ids"), F.lit("")), F.nullif(get("id_list"), F.lit("")), get("id_in"), F.lit(""))
    where = F.lower(F.coalesce(get("where"), F.lit("")))
    parts = F.concat(
        F.array(*[get(k) for k in ID_KEYS]),
        F.split(F.translate(listed, "[]", "  "), r"[,\s]+"),
        F.regexp_extract_all(where, F.lit(r"\bid\s*=\s*(\d+)"), F.lit(1)),
        F.split(F.regexp_extract(where, r"\bid\s+in\s*\(([^)]*)\)", 1), ","),
    )
    numbers = F.transform(parts, lambda p: F.trim(p).try_cast("bigint"))
    return F.array_distinct(F.array_compact(numbers))


def clean_action(action: Column) -> Column:
    """Words inside an action text decide first, in this order, then the aliases."""
    a = F.lower(F.trim(F.coalesce(action, F.lit(""))))
    holds = lambda *words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(a, w))
    said = (
        F.when(holds("select", "query", "read", "show", "list", "print"), "query")
        .when(holds("delete") & holds("all"), "delete_all")
        .when(holds("truncate", "clear"), "delete_all")
        .when(F.startswith(a, F.lit("delete")), "delete")
        .otherwise(a)
    )
    return lookup(said, ACTION_ALIASES, said)


def normalize(tasks: DataFrame, session_id: str) -> DataFrame:
    """Tasks with canonical target and action, and only the fields that their table knows.

    A delete with ids becomes a delete by ids (its ids come back as one list); a confirmed
    delete of scope all becomes delete_all; an update that names no row becomes an upsert; a
    session write without a session id takes the given one.
    """
    target = lookup(F.lower(F.coalesce("target", F.lit(""))), TARGET_ALIASES, F.lower(F.coalesce("target", F.lit(""))))
    rows = tasks.withColumn("data", F.coalesce("data", F.create_map().cast("map<string,string>"))).withColumn("__t", target).withColumn("__a", clean_action(F.col("action")))
    deleting = F.col("__a").isin("delete", "delete_by_ids")
    ids = delete_ids()
    rows = rows.withColumn("__ids", F.when(deleting, ids))
    rows = rows.withColumn("data", F.when(deleting & (F.size("__ids") > 0), F.map_concat(F.map_filter("data", lambda k, v: k != "ids"), F.create_map(F.lit("ids"), F.array_join(F.col("__ids").cast("array<string>"), ",")))).otherwise(F.col("data")))
    rows = rows.withColumn("__a", F.when(deleting & (F.size("__ids") > 0), "delete_by_ids").otherwise(F.col("__a")))
    everything = F.col("__a").isin("delete", "delete_by_ids") & (value("confirm") == "true") & value("scope").isin("all", "*")
    rows = rows.withColumn("__a", F.when(everything, "delete_all").when(~F.col("__a").isin(*ACTIONS), "upsert").otherwise(F.col("__a")))
    named = has("id")
    own = F.lit(False)
    for t, key in OWN_ID.items():
        own = F.when(F.col("__t") == t, has(key)).otherwise(own)
    rows = rows.withColumn("__a", F.when((F.col("__a") == "update") & ~(F.col("__t").isin(*FIELDS) & (named | own)), "upsert").otherwise(F.col("__a")))
    allowed = F.when(F.lit(False), F.array().cast("array<string>"))
    for t, fields in FIELDS.items():
        allowed = allowed.when(F.col("__t") == t, F.array(*map(F.lit, (*fields, *CONTROL))))
    rows = rows.withColumn("__allowed", allowed).withColumn("data", F.when(F.col("__allowed").isNull(), F.col("data")).otherwise(F.map_filter("data", lambda k, v: F.array_contains("__allowed", k))))
    needs_session = (F.col("__t") == "review_session") & F.col("__a").isin("create", "update", "upsert") & ~has("session_id")
    given = F.map_concat(F.map_filter("data", lambda k, v: k != "session_id"), F.create_map(F.lit("session_id"), F.lit(session_id)))
    return rows.select("ord", F.col("__t").alias("target"), F.col("__a").alias("action"), F.when(needs_session, given).otherwise(F.col("data")).alias("data"))


def needs_confirm(tasks: DataFrame, *keys: str) -> DataFrame:
    """One row, or one for each value of ``keys``: whether some normalised task deletes all without consent, or deletes without naming rows."""
    unscoped = (F.size("data") == 0) | ~(has("id") | has("pattern_id") | has("issue_id") | has("session_db_id") | has("ids"))
    risky = ((F.col("action") == "delete_all") & (F.coalesce(value("confirm"), F.lit("")) != "true")) | ((F.col("action") == "delete") & unscoped)
    return tasks.groupBy(*keys).agg(F.coalesce(F.bool_or(risky), F.lit(False)).alias("need_confirm"))


def confirmed(tasks: DataFrame) -> DataFrame:
    """Tasks with the confirm flag; a delete that names no rows means all of them."""
    data = F.map_concat(F.map_filter(F.coalesce("data", F.create_map().cast("map<string,string>")), lambda k, v: k != "confirm"), F.create_map(F.lit("confirm"), F.lit("true")))
    action = F.when(F.lower("action").isin("delete-all", "deleteall"), "delete_all").otherwise(F.col("action"))
    unscoped = (F.lower(action) == "delete") & (F.size(delete_ids()) == 0)
    return tasks.filter("coalesce(target, '') != ''").select("ord", "target", F.when(unscoped, "delete_all").otherwise(action).alias("action"), data.alias("data"))


def mode(tasks: DataFrame) -> DataFrame:
    """One row: delete before query before write; write for no tasks."""
    deletes, queries = F.bool_or(F.col("action").isin("delete", "delete_all")), F.bool_or(F.col("action") == "query")
    return tasks.agg(F.when(deletes, "delete").when(queries, "query").otherwise("write").alias("mode"))


def fan_out(tasks: DataFrame) -> DataFrame:
    """Tasks for all tables as one task for each, in place."""
    everywhere = F.lower("target").isin("all", "*", "all_tables")
    targets = F.when(everywhere, F.array(F.lit("issue_pattern"), F.lit("review_session"), F.lit("curated_issue"))).otherwise(F.array("target"))
    rows = tasks.select("ord", F.posexplode(targets).alias("part", "target"), "action", "data")
    return rows.select((F.col("ord") * 3 + F.col("part")).alias("ord"), "target", "action", "data")


def execution_order(tasks: DataFrame) -> DataFrame:
    """Patterns, sessions, issues, others; ties in the given order."""
    target = lookup(F.lower(F.coalesce("target", F.lit(""))), TARGET_ALIASES, "")
    rank = F.lit(50)
    for t, k in ORDER.items():
        rank = F.when(target == t, k).otherwise(rank)
    return tasks.withColumn("priority", rank).orderBy("priority", "ord")


#: Values of a task's fields where none is given; {text} is the request, {session} the session.
FILLERS = {
    "review_session": {"code_directory": "", "code_patch": "", "git_commit": "", "status": "open"},
    "curated_issue": {"pattern_id": "", "severity": "medium", "status": "open", "project_path": "", "file_path": "", "start_line": "0", "end_line": "0", "code_snippet": "", "problem_phenomenon": "{text}", "root_cause": "", "solution": ""},
    "issue_pattern": {"severity": "medium", "status": "active", "error_type": "general", "error_description": "{text}", "problematic_pattern": "{text}", "solution": "", "title": "", "language": "", "framework": "", "file_pattern": "", "class_pattern": "", "tags": ""},
}
FORCED = {"review_session": {"session_id": "{session}", "user_message": "{text}"}, "curated_issue": {"session_id": "{session}"}, "issue_pattern": {}}


def fill(tasks: DataFrame, text: str, session: str) -> DataFrame:
    """Write tasks without system-owned fields, with the forced ones set and defaults filled; others unchanged."""
    put = lambda v: v.replace("{text}", text).replace("{session}", session)
    literal = lambda m: F.create_map(*[F.lit(x) for k, v in m.items() for x in (k, put(v))]) if m else F.create_map().cast("map<string,string>")
    data = F.col("data")
    target = lookup(F.lower("target"), TARGET_ALIASES, "")
    for t in FILLERS:
        own = F.map_filter("data", lambda k, v: ~k.isin("id", "created_at", "updated_at", *FORCED[t]))  # noqa: B023
        missing = F.map_filter(literal(FILLERS[t]), lambda k, v: ~F.map_contains_key("data", k))
        data = F.when((target == t) & ~F.lower("action").isin("query", "delete", "delete_all"), F.map_concat(own, missing, literal(FORCED[t]))).otherwise(data)
    return tasks.withColumn("data", data)


def complete(tasks: DataFrame, text: str, session: str) -> DataFrame:
    """Tasks with a default write for each of the three tables that none of them names, at the end."""
    spark = tasks.sparkSession
    wanted = spark.createDataFrame([(k, t) for k, t in enumerate(("review_session", "curated_issue", "issue_pattern"))], "k int, target string")
    named = tasks.select(lookup(F.lower("target"), TARGET_ALIASES, "").alias("target")).distinct()
    top = tasks.agg(F.coalesce(F.max("ord"), F.lit(-1)).alias("top"))
    absent = wanted.join(named, "target", "left_anti").crossJoin(F.broadcast(top))
    fresh = absent.select((F.col("top") + 1 + F.col("k")).alias("ord"), "target", F.lit("upsert").alias("action"), F.create_map().cast("map<string,string>").alias("data"))
    return tasks.unionByName(fill(fresh, text, session))


def counts(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("target", "action").agg(F.count("*").alias("count"))


def fields_of(results: DataFrame) -> DataFrame:
    """A row per field of each result (target, action, status, data, row_id); one blank row without fields."""
    return results.select("target", "action", "status", F.explode_outer("data").alias("field", "value"), "row_id").withColumns({c: F.coalesce(c, F.lit("")) for c in ("field", "value")})


def with_ids(tasks: DataFrame, pattern_ids: DataFrame, session_ids: DataFrame) -> DataFrame:
    """Issue tasks with the pattern and session ids just created (one-row tables), where they name none."""
    ids = pattern_ids.agg(F.max("id").alias("__p")).crossJoin(session_ids.agg(F.max("id").alias("__s")))
    put = lambda key, v: F.map_concat(F.map_filter("data", lambda k, x: k != key), F.create_map(F.lit(key), v.cast("string")))
    rows = tasks.crossJoin(F.broadcast(ids))
    issue = F.col("target") == "curated_issue"
    rows = rows.withColumn("data", F.when(issue & ~has("pattern_id") & F.col("__p").isNotNull(), put("pattern_id", F.col("__p"))).otherwise(F.col("data")))
    rows = rows.withColumn("data", F.when(issue & ~F.coalesce(value("session_id"), F.lit("")).rlike(r"^\d+$") & F.col("__s").isNotNull(), put("session_id", F.col("__s"))).otherwise(F.col("data")))
    return rows.select(*tasks.columns)


def run_query(table: DataFrame, data: dict[str, str], target: str) -> DataFrame:
    """Rows that a query task asks for: by id, or by its filters, newest first, with limit and offset."""
    own = data.get("id") or data.get(OWN_ID[target])
    if own:
        return store.by_ids(table, [int(own)])
    filters = {k: data[k] for k in ("session_id", "file_path", "status") if data.get(k) and k in table.columns}
    number = lambda k: int(data[k]) if data.get(k) else None
    return store.newest(table, number("limit"), number("offset") or 0, **filters)


def run_delete(table: DataFrame, tasks: DataFrame, target: str) -> DataFrame:
    """The table without the rows that delete-by-ids tasks of its target name; all go for a delete_all."""
    own = tasks.filter(F.col("target") == target)
    ids = own.filter("action = 'delete_by_ids'").select(F.explode(delete_ids()).alias("id"))
    cleared = own.filter("action = 'delete_all'").select(F.lit(1).alias("__all")).limit(1)
    return store.delete(table, ids).join(F.broadcast(cleared), F.lit(True), "left_anti")
