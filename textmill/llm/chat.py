"""Chat formatting of reply trees; DataFrame functions only.

A node may have many replies.  Iterative self-joins with doubling steps find, for
every node, its ancestors at distances 1, 2, 4, ... and the score of its path; so a
thread of depth d takes log2(d) joins.  The branches (paths from a root to a leaf) of a conversation
are ranked by mean score, and each chosen path is formatted as one conversation.

Turns are written as START role SEP text END.  Inside roles and texts, whatever
reads as a control string (of this template or of other common ones) gets a
backslash after its first character, one more than it has; so it never reads as
control, and taking one backslash away restores the text exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.functions.folds import running
from textmill.llm.scratch import UID, own, stash, with_uid

START, SEP, END = "<|start|>", "<|sep|>", "<|end|>"
#: First character, backslashes, rest of a control string.
CONTROL = r"([<\[])(\\*)(\|[a-z_]{1,32}\|>|/?s>|</?SYS>>|/?INST\])"
ESCAPED = r"([<\[])\\(\\*)(\|[a-z_]{1,32}\|>|/?s>|</?SYS>>|/?INST\])"
#: What both turns of the query's extra conversation say: control strings of another template.
PROBE = "</s>[INST] ok [/INST]"
#: Hash parts that a conversation's branches are ranked in before they meet.
PARTS = 64


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def chain(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A plain conversation as a tree: each row, by turn, replies to the one before it.

    Rows with the same turn follow by role, then text; a null turn comes last.
    """
    order = ("conv", F.asc_nulls_last("turn"), "role", "text")
    rows = own(turns, conv=conv_col, turn=turn_col, role=role_col, text=text_col)
    # Rows are dealt by range and numbered within each part; only counts of parts meet, so no task holds a whole long conversation.
    held = stash(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "chat-turns")
    sizes = held.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("conv").alias("of"), F.col("part").alias("at"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")).where("start > 0")
    local = F.row_number().over(Window.partitionBy("part", "conv").orderBy(*order[1:])).cast("long")
    met = held.withColumn("node", local).join(starts, F.col("conv").eqNullSafe(F.col("of")) & (F.col("part") == F.col("at")), "left")
    rows = met.withColumn("node", F.col("node") + F.coalesce("start", F.lit(0)))
    parent = F.when(F.col("node") > 1, F.col("node") - 1)
    return rows.select("conv", "node", parent.alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def _linked(nodes: DataFrame) -> DataFrame:
    """Nodes with a unique number and their parent's; an unknown parent makes a root."""
    held = stash(with_uid(nodes), "chat-nodes")
    named = held.where(F.col("node").isNotNull()).groupBy(F.col("conv").alias("at_conv"), F.col("node").alias("at_node")).agg(F.min(UID).alias("up"))
    met = held.join(named, F.col("conv").eqNullSafe(F.col("at_conv")) & (F.col("parent") == F.col("at_node")), "left")
    return stash(met.select(UID, "up", "conv", "role", "text", F.coalesce("score", F.lit(0.0)).cast("double").alias("score")), "chat-links")


def _jumps(linked: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Doubling steps up the trees.

    First, for each k, (uid, up): the ancestor 2^k above, of the nodes that have one.  Then
    (uid, total, depth): score and length of the whole path down from the root.  A round joins only
    nodes whose path goes on; those at their root are kept aside with their totals.
    """
    now = linked.select(UID, "up", F.col("score").alias("total"), F.lit(1).cast("long").alias("depth"))
    steps, most, done = [], linked.count(), None
    while True:
        ended, open_ = now.where("up IS NULL"), now.where("up IS NOT NULL")
        done = ended if done is None else done.unionAll(ended)
        if open_.isEmpty() or 1 << len(steps) > 2 * most:
            return steps, done.drop("up")
        steps.append(open_.select(UID, "up"))
        far = open_.unionAll(done).select(F.col(UID).alias("far"), F.col("up").alias("far_up"), F.col("total").alias("far_total"), F.col("depth").alias("far_depth"))
        met = open_.join(far, F.col("up") == F.col("far"))
        now = stash(met.select(UID, F.col("far_up").alias("up"), (F.col("total") + F.col("far_total")).alias("total"), (F.col("depth") + F.col("far_depth")).alias("depth")), "chat-jumps")


def branches(nodes: DataFrame, top: int = 1) -> DataFrame:
    """(conv, node, parent, role, text, score) -> the ``top`` best paths of each conversation.

    Columns conv, branch, branch_score, pos (from 0 at the root), role, text.  A branch's score is the
    mean of its nodes' scores (null: 0); ties go to the longer branch, then to the first stored.  Roots, and
    nodes whose parent is unknown, begin paths; nodes on or below a cycle have no root and so no path.
    """
    linked = _linked(nodes)
    steps, whole = _jumps(linked)
    parents = linked.where("up IS NOT NULL").select(F.col("up").alias(UID)).distinct()
    leaves = linked.select(UID, "conv").join(whole, UID).join(parents, UID, "left_anti")
    best = (F.desc("branch_score"), F.desc("depth"), F.asc(UID))
    ranked = leaves.withColumn("branch_score", F.col("total") / F.col("depth")).withColumn("part", F.pmod(F.xxhash64(UID), F.lit(PARTS)))
    # A conversation may have any number of branches: each part keeps its best ones first.
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("conv", "part").orderBy(*best))).where(F.col("rank") <= top)
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("conv").orderBy(*best))).where(F.col("rank") <= top)
    path = stash(ranked.select(F.col(UID).alias("leaf"), F.col("rank").alias("branch"), "branch_score", "depth", F.col(UID).alias("at"), F.lit(0).cast("long").alias("back")), "chat-paths")
    for k in range(len(steps) - 1, -1, -1):
        up = steps[k].select(F.col(UID).alias("at"), "up")
        higher = path.join(up, "at").select("leaf", "branch", "branch_score", "depth", F.col("up").alias("at"), (F.col("back") + (1 << k)).alias("back"))
        path = path.unionByName(higher)
        if k % 4 == 0:
            path = stash(path, "chat-paths")
    found = path.join(linked.select(F.col(UID).alias("at"), "conv", "role", "text"), "at")
    return found.select("conv", "leaf", "branch", "branch_score", (F.col("depth") - 1 - F.col("back")).alias("pos"), "role", "text")


def format_branches(paths: DataFrame, learn_from: str = "assistant") -> DataFrame:
    """Each path as one row: conv, branch, branch_score, formatted, loss_spans.

    ``loss_spans`` are (start, end) code point offsets of the texts whose role is
    ``learn_from``, in order.  Null roles and texts are empty.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    turn = F.struct("pos", escape(role).alias("role"), escape(text).alias("text"), (role == learn_from).alias("learn"))
    whole = paths.groupBy("conv", "leaf", "branch", "branch_score").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    formatted = F.array_join(F.transform("turns", lambda t: F.concat(F.lit(START), t["role"], F.lit(SEP), t["text"], F.lit(END))), "")
    state = "struct<start: int, end: int, learn: boolean>"

    def step(s: Column, t: Column) -> Column:
        start = s["end"] + F.when(s["start"] < 0, 0).otherwise(len(END)) + len(START) + len(SEP) + F.length(t["role"])
        return F.struct(start.alias("start"), (start + F.length(t["text"])).alias("end"), t["learn"].alias("learn"))

    spans = F.filter(running(F.col("turns"), F.struct(F.lit(-1), F.lit(0), F.lit(False)), step, state), lambda s: s["learn"])
    spans = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    return whole.select("conv", "branch", "branch_score", formatted.alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text), unescaped."""
    turns = F.split(formatted, r"<\|end\|>", -1)
    turns = F.slice(turns, F.lit(1), F.size(turns) - 1)

    def turn(t: Column) -> Column:
        body = F.substr(t, F.lit(len(START) + 1))
        at = F.instr(body, SEP)
        return F.struct(unescape(F.substring(body, F.lit(1), at - 1)).alias("role"), unescape(F.substr(body, at + len(SEP))).alias("text"))

    return F.transform(turns, turn)


def learned_text(formatted: Column, loss_spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(loss_spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["end"] - s["start"]))), "")


def format_trees(nodes: DataFrame, top: int = 1, learn_from: str = "assistant") -> DataFrame:
    """Chosen branches of reply trees, formatted.  An empty table gives no rows; other columns are ignored."""
    rows = own(nodes, **{c: c for c in ("conv", "node", "parent", "role", "text", "score")})
    return format_branches(branches(rows, top), learn_from)


def digest(formatted: DataFrame) -> DataFrame:
    """Figures of each formatted conversation, read back from it."""
    read = formatted.withColumn("__turns", read_back(F.col("formatted"))).withColumn("__loss", learned_text(F.col("formatted"), F.col("loss_spans")))
    said = F.array_join(F.transform("__turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        F.col("conv").alias("conv_id"),
        F.size("__turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("__loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("__loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def oracle_sql() -> str:
    """DuckDB SQL for the digest of all ``conversations`` and conversation -1."""
    esc = lambda c: f"regexp_replace(coalesce({c}, ''), '([<\\[])(\\\\*)(\\|[a-z_]{{1,32}}\\|>|/?s>|</?SYS>>|/?INST\\])', '\\1\\\\\\2\\3', 'g')"
    return f"""
WITH c AS (
  SELECT conv_id, 0 AS probe, turn, role, text FROM conversations
  UNION ALL SELECT -1, 1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 1, 'assistant', '{PROBE}'),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id, probe ORDER BY turn NULLS LAST, encode(role) NULLS FIRST, encode(text) NULLS FIRST) AS pos FROM c),
g AS (SELECT conv_id, count(*)::BIGINT AS n_turns,
        string_agg(coalesce(role, '') || chr(10) || coalesce(text, '') || chr(10), '' ORDER BY pos) AS said,
        coalesce(string_agg(coalesce(text, ''), '' ORDER BY pos) FILTER (WHERE role = 'assistant'), '') AS loss,
        sum({len(START) + len(SEP) + len(END)} + length({esc('role')}) + length({esc('text')}))::BIGINT AS formatted_chars
      FROM o GROUP BY conv_id, probe)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""
