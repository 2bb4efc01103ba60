"""Rebuilding conversations from message rows.

Messages get parent pointers (to the message before them in their session; to none that exists if they have no place in
it), and pointers are resolved by iterative pointer-jumping joins: in each round every row takes over its target's
target, so chains of any length end after a logarithmic number of rounds; what reaches no root is an orphan or hangs on
a cycle. To keep the rounds cheap and hot sessions harmless, the ordered rows are first cut into runs of bounded length
and the runs jump; a message's root and distance are its run's and its place in it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.staging import spread_of, stage

#: Spellings of roles after NFKC-free lower casing and trimming.
ROLES = {
    "USER": ["user", "human", "usr", "customer", "client", "person", "用户", "使用者", "人类", "ユーザー", "사용자", "usuario", "utilisateur", "nutzer", "benutzer", "пользователь", "مستخدم", "ผู้ใช้", "उपयोगकर्ता", "χρήστης"],
    "ASSISTANT": ["assistant", "ai", "bot", "model", "agent", "gpt", "llm", "chatbot", "助手", "助理", "机器人", "アシスタント", "어시스턴트", "asistente", "assistent", "ассистент", "помощник", "مساعد", "ผู้ช่วย", "सहायक", "βοηθός"],
    "SYSTEM": ["system", "sys", "developer", "系统", "系統", "システム", "시스템", "sistema", "système", "systeme", "система", "نظام", "ระบบ", "प्रणाली", "σύστημα"],
}
#: Words that fill the place of a role without naming anybody.
FILLER = ["unknown", "none", "null", "nil", "na", "nan", "undefined", "tbd", "todo", "unspecified", "missing", "empty", "未知", "无", "不明"]
#: Fixed value: characters that show nothing although Unicode counts them as letters, marks or symbols.
UNSEEN = r"\x{034F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{2800}\x{3164}\x{FE00}-\x{FE0F}\x{FFA0}\x{E0100}-\x{E01EF}"

#: Consecutive messages of a session that form one run.
RUN = 4096


def role_of(role: Column) -> Column:
    """USER, ASSISTANT or SYSTEM; OTHER for a role that names somebody else; null for one that names nobody (null,
    blank, without any letter, or mere filler)."""
    word = F.lower(F.regexp_replace(F.coalesce(role, F.lit("")), r"^[^\p{L}\p{N}]+|[^\p{L}\p{M}\p{N}]+$", ""))
    letters = F.regexp_replace(word, r"[^\p{L}\p{N}]", "")
    named = reduce(lambda c, kv: c.when(word.isin(kv[1]), F.lit(kv[0])), ROLES.items(), F.when(~letters.rlike(r"\p{L}") | letters.isin(FILLER), F.lit(None).cast("string")))
    return named.otherwise(F.lit("OTHER"))


def visible(text: Column) -> Column:
    """Whether a text has a character that can be seen: no space, control, format or filler character."""
    return F.coalesce(text.rlike(rf"[^\s\p{{Z}}\p{{Cc}}\p{{Cf}}\p{{Cs}}\p{{Cn}}{UNSEEN}]"), F.lit(False))


def counted_messages(messages: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The messages that count, one row each: (session_id, id, created_at, role, <keep>).

    Of rows with one session and key the one with the smallest id tells; a null key is its own message. Rows without a
    session, of another type than CHAT (any letter case), or without visible content don't count.
    """
    key = F.coalesce(F.concat(F.lit("k"), "message_key"), F.concat(F.lit("i"), F.col("id").cast("string")))
    # content is reduced to one bit before the shuffle unless the caller wants it
    rows = messages.filter(F.col("session_id").isNotNull()).select(
        "session_id",
        key.alias("key"),
        F.struct(
            "id",
            "created_at",
            role_of(F.col("role")).alias("role"),
            (F.coalesce(F.upper(F.trim("message_type")) == "CHAT", F.lit(False)) & visible(F.col("content"))).alias("counts"),
            *keep,
        ).alias("m"),
    )
    first = rows.groupBy("session_id", "key").agg(F.min_by("m", F.col("m.id")).alias("m"))
    return first.filter("m.counts").select("session_id", "m.id", "m.created_at", "m.role", *[f"m.{c}" for c in keep])


def resolve_pointers(nodes: DataFrame, id_col: str = "id", parent_col: str = "parent", weight_col: str | None = None) -> DataFrame:
    """(id, root, distance bigint, state): where the chain of parents of each row ends.

    ``distance`` is the sum of the weights (1 each by default) of the rows above it. ``state`` is ``ok``; ``orphan`` if
    the chain ends at a row whose parent does not exist, the root then being that row; or ``cycle`` if it never ends,
    with null root and distance. Ids must be unique and not null. Rounds of pointer jumping: each joins the rows that
    are still under way with the rows they point to, and ends what has ended.
    """
    weight = F.lit(1) if weight_col is None else F.col(weight_col)
    own = stage(nodes.select(F.col(id_col).alias("id"), F.col(parent_col).alias("parent"), weight.cast("bigint").alias("w")))
    known = own.select(F.col("id").alias("p"), F.col("w").alias("pw"))
    start = own.join(known, F.col("parent") == F.col("p"), "left")
    state = F.when(F.col("parent").isNull(), "ok").when(F.col("p").isNull(), "orphan")
    # to: the row pointed to, null once the chain has ended; root: the farthest row reached
    now = stage(start.select("id", F.col("p").alias("to"), F.coalesce("p", "id").alias("root"), F.coalesce("pw", F.lit(0)).alias("distance"), state.alias("state")))
    ended, under_way = now.filter("to is null"), now.filter("to is not null")
    left, before = under_way.count(), None
    parts = [ended]
    # all rows that have a target of known end are ended each round; a round that ends none leaves only cycles
    while left and left != before:
        table = now.select(F.col("id").alias("t"), F.col("to").alias("t_to"), F.col("root").alias("t_root"), F.col("distance").alias("t_distance"), F.col("state").alias("t_state"))
        step = under_way.join(table, F.col("to") == F.col("t")).select(
            "id", F.col("t_to").alias("to"), F.col("t_root").alias("root"), (F.col("distance") + F.col("t_distance")).alias("distance"), F.col("t_state").alias("state")
        )
        moved = stage(step)
        ended = moved.filter("to is null")
        parts.append(ended)
        # targets that ended in earlier rounds are kept, as later rows may point to them
        now = reduce(DataFrame.unionByName, parts).unionByName(moved.filter("to is not null"))
        under_way = moved.filter("to is not null")
        before, left = left, under_way.count()
    cycles = under_way.select("id", F.lit(None).cast(dict(own.dtypes)["id"]).alias("root"), F.lit(None).cast("bigint").alias("distance"), F.lit("cycle").alias("state"))
    return reduce(DataFrame.unionByName, [p.select("id", "root", "distance", "state") for p in parts]).unionByName(cycles)


def link_messages(counted: DataFrame, run: int = RUN, lost: Column | None = None) -> DataFrame:
    """The counted messages, ordered within their session: + parent_id, parent_role, turn_no (from 0), root_id, root_role,
    state.

    Order is created_at, then id; rows without a time come last. The rows are range-partitioned in that order, so a
    session of any size spreads over tasks; each is cut into runs of at most ``run`` rows, a run points to the one
    before it, and the chains of all runs are resolved by pointer jumping. A message for which ``lost`` holds has no
    place in the order: it points to a message that isn't there, so it ends as an orphan (its own root, turn 0).
    """
    lost = F.lit(False) if lost is None else lost
    order = [F.col("session_id").asc(), F.col("lost").asc(), F.col("created_at").asc_nulls_last(), F.col("id").asc()]
    marked = counted.withColumn("lost", lost)
    placed = stage(
        marked.repartitionByRange(spread_of(marked), *order)
        .sortWithinPartitions(*order)
        .withColumn("at", F.monotonically_increasing_id())
        .withColumn("part", F.shiftright("at", 33).cast("int"))
        .withColumn("chunk", F.floor(F.col("at").bitwiseAND((1 << 33) - 1) / run).cast("bigint"))
    )
    inside = Window.partitionBy("session_id", "part", "chunk", F.when(F.col("lost"), F.col("at"))).orderBy("at")
    rows = placed.withColumn("run_id", F.first("at").over(inside)).withColumn("no", F.row_number().over(inside) - 1)
    rows = rows.withColumn("before", F.lag(F.struct("id", "role")).over(inside))
    runs = placed.filter("not lost").groupBy("session_id", "part", "chunk").agg(
        F.min("at").alias("run_id"), F.max_by(F.struct("id", "role"), "at").alias("last"), F.min_by(F.struct("id", "role"), "at").alias("first"), F.count("*").alias("n")
    )
    runs = stage(runs)
    # the run before: the chunk before it in its part, or the last chunk of the part before that has rows at all
    ends = placed.groupBy("part").agg(F.max("chunk").alias("chunk")).orderBy("part").collect()  # one row a partition
    bridge = [(b.part, a.part, a.chunk) for a, b in zip(ends, ends[1:])]
    spark = counted.sparkSession
    bridges = F.broadcast(spark.createDataFrame(bridge, "part int, before_part int, before_chunk bigint"))
    inner = runs.filter("chunk > 0").withColumn("before_part", F.col("part")).withColumn("before_chunk", F.col("chunk") - 1)
    linked = inner.unionByName(runs.filter("chunk = 0").join(bridges, "part"))
    before = runs.select("session_id", F.col("part").alias("before_part"), F.col("chunk").alias("before_chunk"), F.col("run_id").alias("parent"), "last")
    links = stage(linked.select("session_id", "before_part", "before_chunk", "run_id").join(before, ["session_id", "before_part", "before_chunk"]).select("run_id", "parent", "last"))
    # a run weighs as many messages as it has, so that distances are turns; no run has the id -1
    nodes = runs.select("run_id", "n").join(links.select("run_id", "parent"), "run_id", "left").select("run_id", "parent", "n")
    nodes = nodes.unionByName(placed.filter("lost").select(F.col("at").alias("run_id"), F.lit(-1).cast("bigint").alias("parent"), F.lit(1).cast("bigint").alias("n")))
    solved = resolve_pointers(nodes, "run_id", "parent", "n").select(F.col("id").alias("run_id"), F.col("root").alias("root_run"), "distance", "state")
    roots = runs.select(F.col("run_id").alias("root_run"), F.col("first").alias("root"))
    heads = solved.join(roots, "root_run", "left").join(links.select("run_id", "last"), "run_id", "left").select("run_id", "root", "distance", "state", "last")
    out = rows.join(heads, "run_id", "left")
    parent = F.when(F.col("no") == 0, F.col("last")).otherwise(F.col("before"))
    return out.select(
        *counted.columns,
        parent["id"].alias("parent_id"),
        parent["role"].alias("parent_role"),
        (F.col("distance") + F.col("no")).alias("turn_no"),
        F.when(F.col("lost"), F.col("id")).otherwise(F.col("root.id")).alias("root_id"),
        F.when(F.col("lost"), F.col("role")).otherwise(F.col("root.role")).alias("root_role"),
        "state",
    )


def judge(messages: DataFrame, run: int = RUN) -> tuple[DataFrame, DataFrame]:
    """(counted messages, (session_id, reason) of every session that has a row): reason is null for one to keep.

    Every reason comes from where the chains of pointers end: a session is empty without a chain of the two speakers;
    broken if a message is an orphan or on a cycle, if the root is the assistant's, or if its messages are not one path
    from one root; and lacks a reply if a user's message has no child of the assistant.
    """
    counted = stage(counted_messages(messages))
    # the system's words are no part of the exchange; who is nobody, or a speaker without a time, has no place in it
    speaks = F.coalesce(F.col("role").isin("USER", "ASSISTANT"), F.lit(False))
    linked = link_messages(counted.filter(speaks | F.col("role").isNull()), run, F.col("role").isNull() | F.col("created_at").isNull())
    paths = linked.groupBy("session_id").agg(
        F.count("role").alias("n"),
        F.count_if(F.col("role") == "USER").alias("users"),
        F.count_if((F.col("role") == "ASSISTANT") & F.coalesce(F.col("parent_role") == "USER", F.lit(False))).alias("replies"),
        F.max(F.coalesce(F.col("state") != "ok", F.lit(True))).alias("astray"),
        F.max(F.coalesce(F.col("root_role") != "USER", F.lit(True))).alias("answer_first"),
        (F.min("root_id") != F.max("root_id")).alias("many_roots"),
        (F.max("turn_no") + 1).alias("leaf"),
    )
    sessions = messages.filter(F.col("session_id").isNotNull()).select("session_id").distinct()
    reason = (
        F.when(F.coalesce("n", F.lit(0)) == 0, "empty")
        .when(F.col("astray") | F.col("answer_first") | F.coalesce("many_roots", F.lit(True)) | (F.coalesce("leaf", F.lit(0)) != F.col("n")), "broken")
        .when(F.col("users") > F.col("replies"), "missing_reply")
    )
    return counted, sessions.join(paths, "session_id", "left").select("session_id", reason.alias("reason"))


def dropped_conversations(messages: DataFrame) -> DataFrame:
    """(session_id, reason) of the conversations to drop: ``empty``, ``broken`` or ``missing_reply``.

    ``empty``: no counted message of the user or the assistant. ``broken``: a counted message whose role names nobody,
    a counted user or assistant message without a time, or an assistant speaking first. ``missing_reply``: a user
    message that the next of the two doesn't answer. Needs session_id, message_key, id, role, message_type, content and
    created_at; other columns are not read. An empty table gives no row.
    """
    return judge(messages)[1].filter("reason is not null")


def conversations(messages: DataFrame) -> DataFrame:
    """(session_id, turn_no, role, id, created_at, content): the kept conversations, turns numbered from 0 in order.

    A root-to-leaf path is one session's rows by turn_no; the system's messages and those of other named roles stand
    where their time puts them.
    """
    _, verdict = judge(messages)
    counted = counted_messages(messages, ("content",)).join(verdict.filter("reason is null"), "session_id", "left_semi")
    linked = link_messages(counted.filter("role is not null"))
    return linked.select("session_id", "turn_no", "role", "id", "created_at", "content")
