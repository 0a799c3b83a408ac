"""Conversation threading as DataFrame jobs (JN3, JN4, THR1-THR12, WIN4-WIN6, AGG18).

The reference links the ids of each message's References in order, never
re-links a container that already has a parent and never closes a loop,
removes empty placeholders (keeping an empty root with two or more
children), sorts siblings by the newest date in their subtree and prints
each message's position as a path of zero-padded hex segments.

Here every step is a distributed job; no thread is gathered into one task:

1. Each message proposes links ``ref[i] -> ref[i+1]`` and ``ref[-1] -> id``
   in processing order (date, doc_id). Of equal proposals the first is kept
   (a partial aggregation, so a hot parent costs one row per task), and the first per child wins.
2. Parents and roots are found by pointer doubling (log2(depth) rounds), each
   round written to ``spark.checkpoint.dir``. When pointers stop closing, the open ones lead into loops; per loop
   the latest proposed link is refused, its child takes its next proposal, and the doubling restarts until no loop is left.
3. Pointers jump over placeholders to the nearest message above; duplicates (later copies of
   a message id) hang under the first copy.
4. Subtree dates and paths double likewise: a node takes what the nodes 2^k below hold, and puts its path
   behind that of the node 2^k above. A round has a row per node, and no list of ancestors is made; only the
   paths themselves grow with the depth. Sibling order is a skew-safe distributed ranking per parent.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import subject_tail
from ..session import ensure_checkpoint_dir, scratch_path
from .windows import ranked

DUP_PREFIX = "\u0000dup-"


def _ckpt(df: DataFrame) -> DataFrame:
    """Lineage cut by a table written to the shared folder. A checkpoint would hand on what the optimiser knows of a column's
    origin, which doubles with each round of joins of a table with itself. Tables of a row per node are joined by sorting: the files
    are so small that Spark would send them through the driver to all tasks, in each round."""
    path = scratch_path(df.sparkSession, "threads")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).hint("merge")


def parent_edges(m: DataFrame) -> tuple[DataFrame, DataFrame]:
    """JN3: (child, parent, order) links proposed by the References of the first
    copies, equal ones once at their first place; and the container id set."""
    ext = F.concat(F.coalesce(F.col("refs"), F.array().cast("array<string>")), F.array(F.col("id")))
    k = F.size(ext)
    pairs = F.arrays_zip(F.slice(ext, 1, k - 1).alias("parent"), F.slice(ext, 2, k - 1).alias("child"))
    props = (m.where(F.size(F.coalesce(F.col("refs"), F.array())) > 0)
             .select("date", "doc_id", F.posexplode(pairs).alias("pos", "e"))
             .select(F.col("e.parent").alias("parent"), F.col("e.child").alias("child"),
                     F.struct(F.col("date"), F.col("doc_id"), F.col("pos")).alias("order"))
             .where(F.col("parent").isNotNull() & F.col("child").isNotNull() & (F.col("parent") != F.col("child"))))
    edges = props.groupBy("child", "parent").agg(F.min("order").alias("order"))
    ids = (m.select(F.col("id")).unionByName(m.select(F.explode("refs").alias("id")))
           .where(F.col("id").isNotNull()).distinct())
    return edges, ids


def parents(ids: DataFrame, proposals: DataFrame) -> DataFrame:
    """(id, parent, root) of each id, loops cut as described above: pointers double until each has reached its root.

    After k rounds a node's pointer is 2^k links up, and a node is open if its root is farther. While any node of a tree is open, one closes
    in each round; so when none does, all open nodes lead into loops. Every link before the latest of a loop stands,
    so that one is refused for good; each restart refuses one proposal at least, and so the restarts end."""
    ensure_checkpoint_dir(ids.sparkSession)
    proposals = _ckpt(proposals)
    while True:
        edges = _ckpt(proposals.groupBy("child").agg(F.min(F.struct("order", "parent")).alias("own"))
                      .select("child", "own.parent", "own.order"))
        state = _ckpt(ids.join(edges.select(F.col("child").alias("id"), "parent"), "id", "left")
                      .select("id", "parent", F.coalesce("parent", "id").alias("far"), F.col("parent").isNull().alias("done")))
        left = state.where("not done").count()
        while left:
            b = state.select(F.col("id").alias("far"), F.col("far").alias("_far"), F.col("done").alias("_done"))
            state = _ckpt(state.where("done").unionByName(state.where("not done").join(b, "far")
                          .select("id", "parent", F.col("_far").alias("far"), F.col("_done").alias("done"))))
            before, left = left, state.where("not done").count()
            if left == before:
                break
        if not left:
            return state.select("id", "parent", F.col("far").alias("root"))
        cut = _loop_cuts(state.where("not done").select("id", "parent"), edges)
        proposals = _ckpt(proposals.join(cut, ["child", "parent"], "left_anti"))


def _loop_cuts(links: DataFrame, edges: DataFrame) -> DataFrame:
    """For each loop, the link (child, parent) that was proposed last. All of ``links`` lead into loops.

    The nodes that pointers reach after enough doublings are those on loops; a loop is named by the least node that its
    pointers have passed, once they have passed as many as there are such nodes."""
    state, step, reached = _ckpt(links.select("id", F.col("parent").alias("far"), F.col("id").alias("low"))), 1, None
    while True:
        before, reached = reached, state.select("far").distinct().count()
        if reached == before and step >= reached:
            break
        b = state.select(F.col("id").alias("far"), F.col("far").alias("_far"), F.col("low").alias("_low"))
        state = _ckpt(state.join(b, "far").select("id", F.col("_far").alias("far"), F.least("low", "_low").alias("low")))
        step *= 2
    on_loop = state.join(state.select(F.col("far").alias("id")).distinct(), "id", "left_semi")
    own = on_loop.select(F.col("id").alias("child"), "low").join(edges, "child")
    return own.groupBy("low").agg(F.max(F.struct("order", "child", "parent")).alias("link")).select("link.child", "link.parent")


def _real_parents(nodes: DataFrame) -> DataFrame:
    """``nodes`` (id, is_real, parent, root) with ``up``, the nearest real id above, or null: pointers jump over placeholders, doubling."""
    real = nodes.where("is_real").select(F.col("id").alias("parent"), F.lit(True).alias("_real"))
    state = _ckpt(nodes.join(real.hint("merge"), "parent", "left").select("id", "is_real", "root", F.col("parent").alias("up"),
                                                            (F.col("parent").isNull() | F.coalesce("_real", F.lit(False))).alias("done")))
    while not state.where("not done").isEmpty():
        b = state.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("done").alias("_done"))
        state = _ckpt(state.where("done").unionByName(state.where("not done").join(b, "up")
                      .select("id", "is_real", "root", F.col("_up").alias("up"), F.col("_done").alias("done"))))
    return state.drop("done")


def _newest_below(nodes: DataFrame) -> DataFrame:
    """(node, newest): the greatest ``value`` of a node and all below it, for (node, up, value). In round k a node takes
    what the nodes 2^k below it hold, which covers all that lie less far below them; a hot parent's children are maximised before the shuffle."""
    state = _ckpt(nodes.select("node", "up", "value"))
    while not state.where("up is not null").isEmpty():
        more = state.where("up is not null").groupBy(F.col("up").alias("node")).agg(F.max("value").alias("_more"))
        above = state.select(F.col("node").alias("up"), F.col("up").alias("_up"))
        state = _ckpt(state.join(more, "node", "left").join(above, "up", "left")
                      .select("node", F.col("_up").alias("up"), F.greatest("value", "_more").alias("value")))
    return state.select("node", F.col("value").alias("newest"))


def _paths(nodes: DataFrame, names: list[str]) -> DataFrame:
    """(node, top, level, and for each name the path of its segments from the top) for (node, up, and segments): a node's path so
    far is put behind that of the node it points to, and its pointer moves there."""
    state = _ckpt(nodes.select("node", "up", F.col("node").alias("top"), F.lit(0).cast("bigint").alias("level"), *names))
    while not state.where("up is not null").isEmpty():
        b = state.select(F.col("node").alias("up"), F.col("up").alias("_up"), F.col("top").alias("_top"), F.col("level").alias("_level"),
                         *[F.col(n).alias(f"_{n}") for n in names])
        state = _ckpt(state.where("up is null").unionByName(state.join(b, "up").select(
            "node", F.col("_up").alias("up"), F.col("_top").alias("top"), (F.col("level") + F.col("_level") + 1).alias("level"),
            *[F.concat(f"_{n}", F.lit(":"), n).alias(n) for n in names])))
    return state.drop("up")


def _seg(idx: Column, width: int) -> Column:
    h = F.lower(F.hex(idx))
    return h if width <= 1 else F.lpad(h, width, "0")


def build_threads(m: DataFrame, descending: bool = False) -> DataFrame:
    """THR2-THR7 + WIN4-WIN6: thread info per message of ``m``.

    ``m`` needs doc_id, msgid, path, refs, date, subject. Returns one row per
    message: doc_id, thread_root, thread_path, thread_level, thread_date and the
    flags root, orphan, has_child, first, last, duplicate, thread_subject.
    """
    spark = m.sparkSession
    ensure_checkpoint_dir(spark)
    base = m.select("doc_id", F.coalesce("msgid", "path").alias("id"), "refs", "date", "subject")
    firsts = base.groupBy("id").agg(F.min("doc_id").alias("first_doc"))
    b = base.join(firsts.hint("merge"), "id").withColumn("is_dup", F.col("doc_id") != F.col("first_doc")).drop("first_doc")
    real = b.where(~F.col("is_dup"))
    dups = b.where(F.col("is_dup"))

    edges, ids = parent_edges(real)
    tree = parents(ids, edges).hint("merge")

    # --- prune placeholders -------------------------------------------------
    real_ids = real.select("id", F.lit(True).alias("is_real"))
    nodes = _real_parents(tree.join(real_ids.hint("merge"), "id", "left").withColumn("is_real", F.coalesce("is_real", F.lit(False))))
    top = nodes.where(F.col("is_real") & F.col("up").isNull() & (F.col("root") != F.col("id")))
    kept = (top.groupBy("root").agg(F.count("*").alias("n_top")).where(F.col("n_top") >= 2)
            .select(F.col("root").alias("kept_root")))
    rn = nodes.where("is_real").join(kept.hint("merge"), F.col("root") == F.col("kept_root"), "left")
    date_type = real.schema["date"].dataType
    real_nodes = (rn.join(real.select("id", "doc_id", "date", "subject").hint("merge"), "id")
                  .select(F.col("id").alias("node"), "doc_id", "date", "subject", F.lit(False).alias("is_dup"),
                          F.lit(False).alias("is_placeholder"), F.coalesce("up", "kept_root").alias("parent")))
    dup_nodes = dups.select(F.concat(F.lit(DUP_PREFIX), F.col("doc_id").cast("string")).alias("node"), "doc_id",
                            F.lit(None).cast(date_type).alias("date"), "subject", F.lit(True).alias("is_dup"),
                            F.lit(False).alias("is_placeholder"), F.col("id").alias("parent"))
    ph_nodes = kept.select(F.col("kept_root").alias("node"), F.lit(None).cast("bigint").alias("doc_id"),
                           F.lit(None).cast(date_type).alias("date"), F.lit(None).cast("string").alias("subject"),
                           F.lit(False).alias("is_dup"), F.lit(True).alias("is_placeholder"), F.lit(None).cast("string").alias("parent"))
    fin = _ckpt(real_nodes.unionByName(dup_nodes).unionByName(ph_nodes))

    # --- subtree date keys: newest date of the (non-duplicate) leaves --------
    nd = fin.where(~F.col("is_dup"))
    inner = nd.where(F.col("parent").isNotNull()).select(F.col("parent").alias("node"), F.lit(True).alias("_inner")).distinct()
    is_leaf = F.col("_inner").isNull() & ~F.col("is_placeholder")
    leaf_key = _newest_below(nd.join(inner.hint("merge"), "node", "left").select("node", F.col("parent").alias("up"), F.when(is_leaf, F.col("date")).alias("value")))
    fin = fin.join(leaf_key.hint("merge"), "node", "left").withColumn(
        "key", F.when(F.col("is_dup"), F.lit(None)).otherwise(F.coalesce("newest", "date"))).drop("newest")
    fin = _ckpt(fin)

    # --- sibling and root order ----------------------------------------------
    # siblings by subtree date (ascending), roots ascending or descending: one
    # distributed ranking pass with the roots as one more group
    is_root = F.col("parent").isNull()
    k_asc = F.when(~is_root | F.lit(not descending), F.col("key"))
    k_desc = F.when(is_root & F.lit(descending), F.col("key"))
    keyed = fin.withColumn("_grp", F.coalesce(F.col("parent"), F.lit(DUP_PREFIX + "root")))
    keyed = keyed.withColumn("_ka", k_asc).withColumn("_kd", k_desc)
    fin = ranked(keyed, [F.col("_ka").asc_nulls_first(), F.col("_kd").desc_nulls_last(),
                         F.col("doc_id").asc_nulls_last(), F.col("node").asc()], ["_grp"], out="sib")
    fin = fin.withColumn("sib", F.col("sib") - 1).drop("_grp", "_ka", "_kd")
    n_sibs = fin.where(F.col("parent").isNotNull()).groupBy("parent").agg(F.max("sib").alias("max_sib"))
    fin = _ckpt(fin.join(n_sibs.withColumnRenamed("parent", "p2").hint("merge"), F.col("parent") == F.col("p2"), "left").drop("p2"))

    # id-table size decides the hex width of a path segment
    n_ids = tree.count() + dups.count()  # the tree is a written table: one row per container id
    width = int(math.ceil(math.log2(n_ids) / 4.0)) if n_ids > 0 else 0
    full = (1 << (4 * width)) - 1

    # --- paths: sibling indices along root..self; of one width, so that they order as their numbers do --------
    is_root = F.col("parent").isNull()
    segs = fin.select("node", F.col("parent").alias("up"), _seg(F.col("sib"), width).alias("order"),
                      F.when(is_root, _seg(F.col("sib"), width)).otherwise(_seg(F.lit(full) - F.col("sib"), width)).alias("shown"))
    paths = _paths(segs, ["order", "shown"] if descending else ["order"])
    path = F.concat("shown", F.lit(":z")) if descending else F.col("order")
    fin = fin.join(paths.select("node", F.col("order").alias("_order"), path.alias("thread_path"), F.col("level").alias("thread_level"),
                                F.col("top").alias("thread_root")).hint("merge"), "node")
    has_child = fin.where(F.col("parent").isNotNull()).select(F.col("parent").alias("node")).distinct().withColumn("hc", F.lit(True))
    placeholders = fin.where("is_placeholder").select(F.col("node").alias("parent"), F.lit(True).alias("parent_empty"))
    fin = fin.join(has_child.hint("merge"), "node", "left").join(placeholders.hint("merge"), "parent", "left")
    fin = _ckpt(fin)

    # --- thread-subject: subject differs from the previous message in thread order
    msgs = fin.where(~F.col("is_placeholder"))
    pos = ranked(msgs, [F.col("_order"), F.col("node")], ["thread_root"], out="tpos")
    prev = pos.select("thread_root", (F.col("tpos") + 1).alias("tpos"), F.col("subject").alias("prev_subject"))
    out = pos.join(prev.hint("merge"), ["thread_root", "tpos"], "left")
    is_root = F.col("parent").isNull()
    tsubj = (is_root | F.coalesce(F.col("prev_subject"), F.lit("")).eqNullSafe("")
             | (subject_tail(F.coalesce("prev_subject", F.lit(""))) != subject_tail(F.coalesce("subject", F.lit("")))))
    return out.select(
        "doc_id", "thread_root", "thread_path", "thread_level",
        F.col("key").alias("thread_date"),
        is_root.alias("root"),
        (~is_root & F.coalesce("parent_empty", F.lit(False))).alias("orphan"),
        F.coalesce("hc", F.lit(False)).alias("has_child"),
        (~is_root & (F.col("sib") == 0)).alias("first"),
        (~is_root & (F.col("sib") == F.col("max_sib"))).alias("last"),
        F.col("is_dup").alias("duplicate"),
        tsubj.alias("thread_subject"),
    )


def run_threaded(m: DataFrame, expr: Column, descending: bool = False, related: bool = True,
                 max_results: int = 0) -> DataFrame:
    """THR8: match -> (related messages) -> threads -> order by path.

    With a limit, the leaders take it (newest first); the related expansion is
    not limited; the limit applies again to the final threaded list."""
    from .ordering import top_k
    from .related import include_related, thread_id
    mm = m.withColumn("thread_id", thread_id())
    res = mm.where(expr)
    if max_results > 0:
        res = top_k(res, max_results, "date", desc=True)
    if related:
        res = include_related(mm, res)
    th = build_threads(res, descending)
    out = res.join(th, "doc_id").orderBy("thread_path")
    return out.limit(max_results) if max_results > 0 else out


def thread_prefix(level: Column | str = "thread_level", root: Column | str = "root", first: Column | str = "first",
                  last: Column | str = "last", orphan: Column | str = "orphan", dup: Column | str = "duplicate") -> Column:
    """THR9: indentation and arrow: two spaces per level above 1, then
    '\\' first / '/' last / ' ' other, then '*> ' orphan, '=> ' dup, '-> '."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    indent = F.repeat(F.lit("  "), F.greatest(c(level) - 1, F.lit(0)).cast("int"))
    mark = F.when(c(first), F.lit("\\")).when(c(last), F.lit("/")).otherwise(F.lit(" "))
    arrow = F.when(c(orphan), F.lit("*> ")).when(c(dup), F.lit("=> ")).otherwise(F.lit("-> "))
    return F.when(c(root), indent).otherwise(F.concat(indent, mark, arrow))


def whole_thread(res: DataFrame, path: str) -> DataFrame:
    """THR10: messages whose first path segment equals the given path's."""
    first = path.split(":")[0]
    return res.where(F.split("thread_path", ":")[0] == F.lit(first))


def subthread(res: DataFrame, path: str) -> DataFrame:
    """THR11: the message and everything below it."""
    p = path[:-2] if path.endswith(":z") else path
    tp = F.regexp_replace("thread_path", ":z$", "")
    return res.where((tp == F.lit(p)) | tp.startswith(p + ":"))
