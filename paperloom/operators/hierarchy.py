"""Parent-child rows to full hierarchies: status, depth, root, path, subtree size and nested-set ranges.

Upward, every row finds its ancestor 1, 2, 4, ... steps above (each round joins the rows still under way with their
targets) and hands its subtree's count to that ancestor, so sizes of trees of any depth are complete after a
logarithmic number of rounds. Rows whose chains have ended are processed; those that never end hang on cycles.
Downward, siblings get offsets by prefix sums over their sizes, and a row's preorder number is the sum of the offsets
on its path. ``lft`` and ``rgt`` bound a row's subtree: its descendants are the rows with lft between them, its
ancestors those whose range holds it. No array is carried through the rounds. A parent with very many children makes a
hot key of the joins; its other side has one row a key, so adaptive execution can split it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from paperloom.staging import spread_of, stage, unstage

#: Siblings that one task sums over.
BLOCK = 8192


def latest_rows(rows: DataFrame, id_col: str, version_col: str, keep: list[str]) -> DataFrame:
    """One row an id, the one with the latest version (nulls first); of equal versions the greatest row, so that the
    result doesn't depend on the order of rows. Rows without an id are left out."""
    best = rows.filter(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(F.struct(version_col, *keep)).alias("r"))
    return best.select(id_col, *[f"r.{c}" for c in keep])


def _counted(df: DataFrame, condition: str) -> tuple[DataFrame, int]:
    """(``df`` staged, how many of its rows meet the condition), in one job."""
    seen = Observation()
    out = stage(df.observe(seen, F.count_if(F.expr(condition)).alias("n")))
    return out, seen.get["n"] or 0


def _climb(nodes: DataFrame, sums: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame | None]:
    """(processed, unprocessed) of unique (id, parent, *sums): subtree sizes upward.

    processed: (id, state ok|orphan, root, depth, size, *sums), sizes and sums being those of the whole subtree.
    unprocessed: (id, to, least), the rows whose sizes are never complete as their chains don't end, with ``to`` some row
    far along the chain and ``least`` the smallest id on the way; None if there are none.
    """
    known = nodes.select(F.col("id").alias("p"))
    start = nodes.join(known, F.col("parent") == F.col("p"), "left")
    state = F.when(F.col("parent").isNull(), "ok").when(F.col("p").isNull(), "orphan")
    start = start.select(
        "id", F.col("p").alias("to"), F.coalesce("p", "id").alias("root"), F.when(F.col("p").isNull(), 0).otherwise(1).cast("bigint").alias("depth"),
        state.alias("state"), F.least("id", "p").alias("least"), F.lit(1).cast("bigint").alias("size"), *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in sums],
    )
    own = ("size", *sums)
    now, left = _counted(start, "to is not null")
    before = None
    while left and left != before:
        # what lies less than 2^k below, plus what the rows 2^k below have less than 2^k below them; summed before the shuffle
        given = now.filter("to is not null").groupBy(F.col("to").alias("above")).agg(*[F.sum(c).alias(f"more_{c}") for c in own])
        table = now.select(F.col("id").alias("t"), F.col("to").alias("t_to"), F.col("root").alias("t_root"), F.col("depth").alias("t_depth"), F.col("state").alias("t_state"), F.col("least").alias("t_least"))
        met = now.join(table, F.col("to") == F.col("t"), "left").join(given, F.col("id") == F.col("above"), "left")
        moves = F.col("t").isNotNull()
        after, n = _counted(
            met.select(
                "id", F.col("t_to").alias("to"), F.when(moves, F.col("t_root")).otherwise(F.col("root")).alias("root"), (F.col("depth") + F.coalesce("t_depth", F.lit(0))).alias("depth"),
                F.when(moves, F.col("t_state")).otherwise(F.col("state")).alias("state"), F.least("least", "t_least").alias("least"), *[(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in own],
            ),
            "to is not null",
        )
        unstage(now)
        now, before, left = after, left, n
    return now.filter("to is null").select("id", "state", "root", "depth", *own), now.filter("to is not null").select("id", "to", "least") if left else None


def _cycles(unprocessed: DataFrame) -> DataFrame:
    """(id, anchor, on_cycle) of the rows whose chains never end.

    The targets far along the chains shrink, from round to round, to the rows on cycles, and are those once they
    become no fewer; the smallest id on the way round is found once no row's changes any more.
    """
    now, targets = unprocessed, None

    def doubled(df: DataFrame) -> DataFrame:
        table = df.select(F.col("id").alias("t"), F.col("to").alias("t_to"), F.col("least").alias("t_least"))
        return df.join(table, F.col("to") == F.col("t")).select("id", F.col("t_to").alias("to"), F.least("least", "t_least").alias("least"), (F.col("t_least") < F.col("least")).alias("changed"))

    while True:  # two doublings a staged round
        moved, changed = _counted(doubled(doubled(now)), "changed")
        many = moved.select("to").distinct().count()
        if many == targets and not changed:
            break
        unstage(now)
        now, targets = moved, many
    on_cycle = moved.select(F.col("to").alias("c")).distinct()
    mins = moved.select(F.col("id").alias("a"), F.col("least").alias("anchor"))
    marked = moved.join(on_cycle, F.col("id") == F.col("c"), "left").join(mins, F.col("to") == F.col("a"))
    return marked.select("id", "anchor", F.col("c").isNotNull().alias("on_cycle"))


def unsound(nodes: DataFrame, id_col: str = "id", parent_col: str = "parent_id") -> DataFrame:
    """(id, anchor_id, reason) of the rows whose chain of parents ends at no row with a null parent.

    ``cycle``, ``below_cycle`` (anchor: the smallest id on the cycle), ``orphan`` (its parent does not exist) or
    ``below_orphan`` (anchor: that orphan). Ids must be unique and not null.

    Sizes are summed upward; rows that this never completes are on or below cycles, which are cut above their smallest
    id. What then hangs on orphans and on cut cycles is a forest: it gets nested-set ranges, and a row belongs to the
    anchor whose range holds it.
    """
    own = stage(nodes.select(F.col(id_col).alias("id"), F.col(parent_col).alias("parent")))
    done, lost = _climb(own)
    sizes = done.filter("state = 'orphan'").select("id", "size").withColumn("ring", F.lit(None).cast("boolean")).withColumn("top", F.lit(None).cast(dict(own.dtypes)["id"]))
    if lost is not None:
        rings = stage(_cycles(lost))
        cut = own.join(rings, "id").select("id", F.when(F.col("id") != F.col("anchor"), F.col("parent")).alias("parent"))
        sizes = sizes.unionByName(_climb(cut)[0].select("id", "size").join(rings.select("id", F.col("on_cycle").alias("ring"), F.col("anchor").alias("top")), "id"))
    known = own.select(F.col("id").alias("p"))
    forest, n = _counted(
        own.join(sizes, "id").join(known, F.col("parent") == F.col("p"), "left").select("id", F.when(F.col("id").eqNullSafe(F.col("top")), None).otherwise(F.col("p")).alias("parent"), "size", "ring"), "true"
    )
    placed = stage(forest.join(_ranges(forest, []), "id"))
    tops = placed.filter("parent is null").select(F.col("id").alias("anchor_id"), "lft", (F.col("lft") + F.col("size") - 1).alias("rgt"), F.col("ring").isNotNull().alias("rings"))
    at_top = tops.select(F.col("anchor_id").alias("id"), "anchor_id", F.when(F.col("rings"), "cycle").otherwise("orphan").alias("reason"))
    below = contained(tops, placed.select("id", F.col("lft").alias("at"), "ring"), max(1, n.bit_length()))
    return at_top.unionByName(below.select("id", "anchor_id", F.when(F.col("ring"), "cycle").when(F.col("rings"), "below_cycle").otherwise("below_orphan").alias("reason")))


def subtree_sums(nodes: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """(id, *columns) of the rows of unique (id, parent, *columns) that hang on a sound root: each row's own value and
    those of all rows below it, summed upward. Nulls count as 0."""
    return _climb(nodes, columns)[0].filter("state = 'ok'").select("id", *columns)


def _offsets(nodes: DataFrame, order: list[str]) -> DataFrame:
    """(id, offset): 1 + the sizes of the siblings before; for roots the sizes of the roots before, in ``order``.

    A parent may have any number of children: they are spread over blocks of the sorted rows, sums within blocks and
    over blocks being separate steps.
    """
    spread = spread_of(nodes)
    keys = [F.col("parent").asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order], F.col("id").asc()]
    placed = stage(
        nodes.repartitionByRange(spread, *keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()).withColumn("block", F.floor(F.col("at") / BLOCK).cast("bigint"))
    )
    inside = Window.partitionBy("parent", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    # a parent has one row a block here, BLOCK times fewer than children
    blocks = placed.groupBy("parent", "block").agg(F.sum("size").alias("block_size"))
    over = Window.partitionBy("parent").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.withColumn("earlier", F.coalesce(F.sum("block_size").over(over), F.lit(0))).select(F.col("parent").alias("b_parent"), F.col("block").alias("b_block"), "earlier")
    rows = placed.withColumn("near", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = rows.join(before, (F.col("block") == F.col("b_block")) & F.col("parent").eqNullSafe(F.col("b_parent")))
    one = F.when(F.col("parent").isNull(), 0).otherwise(1)
    return joined.select("id", (F.col("near") + F.col("earlier") + one).alias("offset"))


def _ranges(nodes: DataFrame, order: list[str]) -> DataFrame:
    """(id, lft) of (id, parent, size, *order) with null parents at the tops: preorder numbers from 0.

    Siblings' offsets by prefix sums; a row's number is the sum of the offsets on its chain of parents, added up by
    doubling."""
    now, left = _counted(
        nodes.select("id", F.col("parent").alias("to")).join(_offsets(nodes.select("id", "parent", "size", *order), order), "id").select("id", "to", F.col("offset").alias("lft")), "to is not null"
    )

    def doubled(df: DataFrame) -> DataFrame:
        table = df.select(F.col("id").alias("t"), F.col("to").alias("t_to"), F.col("lft").alias("t_lft"))
        return df.join(table, F.col("to") == F.col("t"), "left").select("id", F.col("t_to").alias("to"), (F.col("lft") + F.coalesce("t_lft", F.lit(0))).alias("lft"))

    while left:  # two doublings a staged round
        after, left = _counted(doubled(doubled(now)), "to is not null")
        unstage(now)
        now = after
    return now.select("id", "lft")


def hierarchy(
    rows: DataFrame, id_col: str = "id", parent_col: str = "parent_id", name_col: str = "name", version_col: str = "updated_at", order_col: str = "sort_order", paths: bool = True
) -> DataFrame:
    """(id, parent_id, name, root_id, depth[, path array<string>, path_ids array], lft, rgt, n_descendants) of every row
    that hangs on a sound root; the paths only with ``paths``.

    Of rows with one id the latest version counts; rows without an id are left out; only a null parent means top
    level. Depth counts from 0, paths run from the root to the row itself with names as they are (null stays null).
    Preorder follows the order column, then id. Descendants of a row are those with lft between its lft + 1 and rgt;
    the paths are its ancestors by the same ranges, in order of lft. Rows on or below cycles and orphans are what
    ``unsound`` reports. An empty table gives no row.
    """
    own = stage(latest_rows(rows, id_col, version_col, [parent_col, name_col, order_col]).select(F.col(id_col).alias("id"), F.col(parent_col).alias("parent"), F.col(name_col).alias("name"), F.col(order_col).alias("place")))
    done, _ = _climb(own.select("id", "parent"))
    sound, n = _counted(done.filter("state = 'ok'").join(own, "id"), "true")
    numbered = sound.join(_ranges(sound.select("id", "parent", "size", "place"), ["place"]), "id").select(
        "id", F.col("parent").alias("parent_id"), "name", F.col("root").alias("root_id"), F.col("depth").cast("int").alias("depth"), "lft", (F.col("lft") + F.col("size") - 1).alias("rgt"), (F.col("size") - 1).alias("n_descendants")
    )
    if not paths:
        return numbered
    tree = stage(numbered)
    above = contained(tree.select(F.col("id").alias("up_id"), F.col("name").alias("up_name"), "lft", "rgt"), tree.select("id", F.col("lft").alias("at")), max(1, n.bit_length()))
    chains = above.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("lft", "up_id", "up_name"))).alias("up"))
    up = lambda c: F.coalesce(F.col(f"up.{c}"), F.array())
    return tree.join(chains, "id", "left").select(
        "id", "parent_id", "name", "root_id", "depth", F.concat(up("up_name").cast("array<string>"), F.array("name")).alias("path"),
        F.concat(up("up_id").cast(f"array<{dict(own.dtypes)['id']}>"), F.array("id")).alias("path_ids"), "lft", "rgt", "n_descendants",
    )


def contained(outer: DataFrame, inner: DataFrame, bits: int = 40) -> DataFrame:
    """Pairs (outer row, inner row) with outer.lft < inner.at <= outer.rgt, without comparing rows with all others.

    Each range is cut into at most 2 * ``bits`` dyadic blocks and each point lies in one block of every size, so the
    pairs are an equi-join on blocks and none comes twice. ``outer`` has lft and rgt, ``inner`` has at, all below
    2^bits; other columns are kept and must differ in name.
    """
    # the blocks of size 2^k between the ends, rounded inwards: an odd low end and an odd high end each leave one over
    blocks = F.expr(f"""flatten(transform(
        transform(sequence(0, {bits}), k -> named_struct('k', k, 'l', shiftright(lft + shiftleft(1L, k), k), 'r', shiftright(rgt + 1, k))),
        x -> filter(array(
            named_struct('k', x.k, 'b', x.l, 'on', x.l < x.r and x.l % 2 = 1),
            named_struct('k', x.k, 'b', x.r - 1, 'on', x.l < x.r and x.r % 2 = 1)), y -> y.on)))""")
    ranges = outer.filter("rgt > lft").withColumn("blk", F.explode(blocks)).withColumn("blk", F.struct("blk.k", "blk.b"))
    points = inner.withColumn("blk", F.explode(F.expr(f"transform(sequence(0, {bits}), k -> named_struct('k', k, 'b', shiftright(at, k)))")))
    return ranges.join(points, "blk").drop("blk")
