"""The metadata service: each listing or change as one DataFrame query.

Tables: users(id, name), groups(id, name, owner_id), group_members(group_id,
user_id, role), file_info(id, group_id, uploader_id, name, size, type,
created_at), qa_records(id, user_id, group_id, question, answer, created_at),
favorites(id, user_id, qa_id, created_at).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.functions.filetype import UPLOAD_LIMIT
from quillstream.sources.numbering import numbered

ROLES = ("admin", "member")


def group_list(groups: DataFrame, members: DataFrame, users: DataFrame) -> DataFrame:
    """id, name, n_members, members (names with roles, in order) of each group."""
    named = members.join(users.select(F.col("id").alias("user_id"), F.col("name").alias("user_name")), "user_id", "left")
    lists = named.groupBy("group_id").agg(F.count("*").alias("n_members"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("user_id", "user_name", "role"))), lambda m: F.concat(F.coalesce(m["user_name"], F.lit("")), F.lit(":"), m["role"])), ",").alias("members"))
    return groups.join(lists, groups["id"] == lists["group_id"], "inner").select("id", "name", "n_members", "members")


def visible(rows: DataFrame, members: DataFrame, user: Column, group: str = "group_id") -> DataFrame:
    """Rows of the groups that a user is a member of."""
    return rows.join(members.where(F.col("user_id") == user).select(F.col("group_id").alias(group)), group, "left_semi")


def file_access(files: DataFrame, members: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (user_id, file_id) with allowed: the user is in the file's group."""
    wanted = requests.join(files.select(F.col("id").alias("file_id"), "group_id"), "file_id", "left")
    inside = members.select("group_id", "user_id", F.lit(True).alias("inside")).distinct()
    return wanted.join(inside, ["group_id", "user_id"], "left").select("user_id", "file_id", F.coalesce("inside", F.lit(False)).alias("allowed"))


def record_access(records: DataFrame, members: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (user_id, qa_id) with allowed: the user's own record, or one of the user's groups."""
    wanted = requests.join(records.select(F.col("id").alias("qa_id"), F.col("user_id").alias("owner"), "group_id"), "qa_id", "left")
    inside = members.select("group_id", "user_id", F.lit(True).alias("inside")).distinct()
    return wanted.join(inside, ["group_id", "user_id"], "left").select("user_id", "qa_id", F.coalesce((F.col("owner") == F.col("user_id")) | F.coalesce("inside", F.lit(False)), F.lit(False)).alias("allowed"))


def page(rows: DataFrame, skip: int, limit: int) -> DataFrame:
    """A page of rows, newest first, ties by id."""
    return rows.orderBy(F.desc("created_at"), F.desc("id")).offset(skip).limit(limit)


def favorites_page(favorites: DataFrame, records: DataFrame, user: Column, skip: int = 0, limit: int = 20) -> DataFrame:
    mine = page(favorites.where(F.col("user_id") == user), skip, limit)
    return mine.join(records.select(F.col("id").alias("qa_id"), "question"), "qa_id", "left").select("id", "qa_id", "question")


def added_members(members: DataFrame, wanted: DataFrame, admins_only: bool = True) -> DataFrame:
    """Members after requests (actor_id, group_id, user_id): actors must be admins, pairs new."""
    if admins_only:
        admins = members.where(F.col("role") == "admin").select("group_id", F.col("user_id").alias("actor_id"))
        wanted = wanted.join(admins, ["group_id", "actor_id"], "left_semi")
    new = wanted.select("group_id", "user_id").distinct().join(members.select("group_id", "user_id"), ["group_id", "user_id"], "left_anti")
    return members.select("group_id", "user_id", "role").unionByName(new.withColumn("role", F.lit("member")))


def removed_members(members: DataFrame, groups: DataFrame, wanted: DataFrame) -> DataFrame:
    """Members after removals (actor_id, group_id, user_id): by admins, not of themselves, not of owners."""
    admins = members.where(F.col("role") == "admin").select("group_id", F.col("user_id").alias("actor_id"))
    ok = wanted.where(F.col("actor_id") != F.col("user_id")).join(admins, ["group_id", "actor_id"], "left_semi")
    ok = ok.join(groups.select(F.col("id").alias("group_id"), F.col("owner_id").alias("user_id")), ["group_id", "user_id"], "left_anti")
    return members.join(ok.select("group_id", "user_id").distinct(), ["group_id", "user_id"], "left_anti")


def changed_roles(members: DataFrame, wanted: DataFrame) -> DataFrame:
    """Members after role changes (actor_id, group_id, user_id, new_role) by admins."""
    admins = members.where(F.col("role") == "admin").select("group_id", F.col("user_id").alias("actor_id"))
    ok = wanted.where(F.col("new_role").isin(*ROLES)).join(admins, ["group_id", "actor_id"], "left_semi").groupBy("group_id", "user_id").agg(F.max("new_role").alias("new_role"))
    return members.join(ok, ["group_id", "user_id"], "left").select("group_id", "user_id", F.coalesce("new_role", "role").alias("role"))


def accepted_uploads(uploads: DataFrame, members: DataFrame, limit: int = UPLOAD_LIMIT) -> DataFrame:
    """uploads (user_id, group_id, name, size) with verdict: accepted, too_large or forbidden."""
    admins = members.where(F.col("role") == "admin").select("group_id", "user_id", F.lit(True).alias("admin")).distinct()
    return uploads.join(admins, ["group_id", "user_id"], "left").withColumn("verdict", F.when(F.col("size") > limit, "too_large").when(F.col("admin"), "accepted").otherwise("forbidden")).drop("admin")


def added_favorites(favorites: DataFrame, records: DataFrame, members: DataFrame, wanted: DataFrame) -> DataFrame:
    """user_id, qa_id of favourites after requests: the record exists, is new to the user and may be seen."""
    may = record_access(records, members, wanted).where("allowed").select("user_id", "qa_id").distinct()
    return favorites.select("user_id", "qa_id").unionByName(may.join(favorites.select("user_id", "qa_id"), ["user_id", "qa_id"], "left_anti"))


def shared(records: DataFrame, members: DataFrame, wanted: DataFrame) -> DataFrame:
    """Records after shares (user_id, qa_id, to_group): the sharer owns the record and is in the group."""
    inside = members.select(F.col("group_id").alias("to_group"), "user_id").distinct()
    ok = wanted.join(inside, ["to_group", "user_id"], "left_semi").groupBy("user_id", "qa_id").agg(F.min("to_group").alias("to_group"))
    r = records.join(ok.withColumnRenamed("qa_id", "id"), ["id", "user_id"], "left")
    return r.select("id", "user_id", F.coalesce("to_group", "group_id").alias("group_id"))


def knowledge_base(asks: DataFrame, groups: DataFrame) -> DataFrame:
    """asks (ask_id, kb): the group whose id or else whose name it is."""
    by_id = groups.select(F.col("id").cast("string").alias("kb"), F.col("id").alias("g1"))
    by_name = groups.groupBy(F.col("name").alias("kb")).agg(F.min("id").alias("g2"))
    return asks.join(by_id, "kb", "left").join(by_name, "kb", "left").select("ask_id", F.coalesce("g1", "g2").alias("group_id"))


def export(record: DataFrame) -> DataFrame:
    """id with the record as json, markdown and text."""
    js = F.to_json(F.struct("id", "question", "answer"))
    md = F.concat(F.lit("# 问题\n\n"), F.col("question"), F.lit("\n\n# 回答\n\n"), F.col("answer"), F.lit("\n"))
    txt = F.concat(F.lit("问题: "), F.col("question"), F.lit("\n回答: "), F.col("answer"))
    return record.select("id", js.alias("json"), md.alias("markdown"), txt.alias("text"))


def created_groups(groups: DataFrame, members: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """groups and members after requests (actor_id, name): each makes a group, which the
    actor owns and administers. Requests without an actor or a name make none."""
    ok = wanted.where(F.col("actor_id").isNotNull() & (F.trim("name") != "")).select("actor_id", "name")
    last = groups.agg(F.coalesce(F.max("id"), F.lit(0)).alias("__last"))
    new = numbered(ok, "actor_id", "name").crossJoin(F.broadcast(last)).select((F.col("__last") + F.col("place")).alias("id"), "name", F.col("actor_id").alias("owner_id"))  # one row is broadcast
    return groups.select("id", "name", "owner_id").unionByName(new), members.select("group_id", "user_id", "role").unionByName(new.select(F.col("id").alias("group_id"), F.col("owner_id").alias("user_id"), F.lit("admin").alias("role")))


def allowed(asks: DataFrame, members: DataFrame, group: str = "kb") -> DataFrame:
    """asks (user_id, a group) with allowed: no group, or one that the user is a member of."""
    inside = members.select(F.col("group_id").cast("string").alias("__group"), F.col("user_id").alias("__user"), F.lit(True).alias("__in")).distinct()
    met = asks.join(inside, (F.col(group).cast("string") == F.col("__group")) & (F.col("user_id") == F.col("__user")), "left")
    return met.withColumn("allowed", F.col(group).isNull() | F.coalesce("__in", F.lit(False))).drop("__group", "__user", "__in")


def recorded(records: DataFrame, members: DataFrame, answered: DataFrame) -> DataFrame:
    """records after answered questions (id, user_id, group_id, question, answer,
    created_at): those that their user may ask in the group, or ask in none."""
    columns = ("id", "user_id", "group_id", "question", "answer", "created_at")
    return records.select(*columns).unionByName(allowed(answered, members, "group_id").where("allowed").select(*columns))


def call_metrics(calls: DataFrame, by: str, ok: Column, took: str, order: str, last: int = 10) -> DataFrame:
    """Of each value of ``by``: calls, how many succeeded and failed, their share in
    percent, the mean time, and the last times in order."""
    calls = calls.withColumn("__ok", F.coalesce(ok, F.lit(False)))
    sums = calls.groupBy(by).agg(F.count("*").alias("n"), F.count_if("__ok").alias("n_ok"), F.count_if(~F.col("__ok")).alias("n_failed"), F.avg(took).alias("mean"))
    late = calls.withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))).where(F.col("__n") <= last)
    lists = late.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct(-F.col("__n"), took))), lambda x: x[took]).alias("last"))
    return sums.join(lists, by).withColumn("success_rate", F.col("n_ok") / F.col("n") * 100)


def queue_status(tasks: DataFrame, status: str = "status") -> DataFrame:
    """One row: how many tasks are pending, running, completed and failed."""
    return tasks.agg(*[F.count_if(F.col(status) == s).alias(s) for s in ("pending", "running", "completed", "failed")])
