"""Orders that a crawl makes one step at a time, worked out for whole logs at once.

The loop of a crawler takes, saves and puts back one item after the other. Here its log is a table: places in a total
order come from range partitions, so no key's rows meet in one task, and what each step makes of the one before is
found by joins on places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .graph import written

#: Rows that are looked at together when the next save is sought, at least as many as a segment may have.
BLOCK = 4096


def numbered(rows: DataFrame, keys: list[str], order: list[Column | str], name: str = "place") -> DataFrame:
    """rows with their place, from 1, among the rows of the same keys; order must be total and keys not null.

    Rows are range partitioned and written, so slices of one key are as even as Spark's sampling makes them; a slice
    numbers its own rows and starts from what the slices before it add up to.
    """
    ranged = written(rows.repartitionByRange(*keys, *order).withColumn("__slice", F.spark_partition_id()))
    sizes = ranged.groupBy(*keys, "__slice").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("__n", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    own = F.row_number().over(Window.partitionBy(*keys, "__slice").orderBy(*order))
    out = ranged.withColumn("__place", own).join(starts, [*keys, "__slice"])
    return out.select(*rows.columns, (F.col("__place") + F.col("__n")).cast("long").alias(name))


def running(rows: DataFrame, keys: list[str], value: Column, name: str, least: bool = False, place: str = "place") -> DataFrame:
    """rows with name, the sum of value over the rows of the same keys up to their place, and name_before, up to the row before.

    With least, the least value instead of the sum, and 0 if that is less. Places are dense, so blocks of them are even;
    a block starts from what the blocks before it come to.
    """
    total = F.min if least else F.sum
    start = F.lit(0).cast("long")
    joined = (lambda a, b: F.least(a, b)) if least else (lambda a, b: a + b)
    blocks = rows.withColumns({"__value": value.cast("long"), "__block": F.floor(F.col(place) / BLOCK)})
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.groupBy(*keys, "__block").agg(total("__value").alias("__all"))
    carried = carried.withColumn("__all", joined(start, F.coalesce(total("__all").over(before), start)))
    own = Window.partitionBy(*keys, "__block").orderBy(place)
    here = lambda last: joined(F.coalesce(total("__value").over(own.rowsBetween(Window.unboundedPreceding, last)), start), F.col("__all"))
    out = blocks.join(carried, [*keys, "__block"])
    return written(out.select(*rows.columns, here(0).alias(name), here(-1).alias(f"{name}_before")))


# --- when a run saves its state ------------------------------------------------------------------------------------


def segments(visits: DataFrame, every_pages: int, every_micros: int, keys: list[str] | None = None, visit: str = "visit_id", started: str = "started", finished: str = "finished") -> DataFrame:
    """Rows (keys…, visit, segment, saved): in which segment of its run each visit falls, and whether a save ends that.

    A run saves after the visit that is the every_pages-th since the last save, or that finishes every_micros after
    that save or later, whichever comes first; the first counts from the start of the first visit. Visits are in order
    of their finish and number. started and finished are in microseconds.

    The place of the next save is a function of the place of the last one. Its blocks are looked at in parallel, and
    the saves that the start leads to are found by pointer doubling: after n rounds 2^n saves are known, and each
    place knows the 2^n-th save after it. No step has all rows of a run in one task.
    """
    keys = keys or ["site_key"]
    log = visits.select(*keys, F.col(visit).alias("visit"), F.col(started).cast("long").alias("started"), F.col(finished).cast("long").alias("at"))
    placed = written(numbered(log, keys, ["at", "visit"]))
    starts = placed.groupBy(*keys).agg(F.lit(0).cast("long").alias("place"), F.min("started").alias("at"))
    points = placed.select(*keys, "place", "at").unionByName(starts)

    size = max(BLOCK, every_pages)
    block = lambda place: F.floor(place / size)
    seen_from = points.withColumn("block", F.explode(F.sequence(block(F.greatest(F.col("place") - every_pages, F.lit(0))), block(F.col("place")))))
    late = Window.partitionBy(*keys, "block").orderBy(F.col("at").desc()).rangeBetween(Window.unboundedPreceding, -every_micros)
    timed = seen_from.withColumn("timed", F.min("place").over(late)).filter(F.col("block") == block(F.col("place")))
    hops = timed.select(*keys, "place", F.least(F.col("place") + every_pages, F.col("timed")).alias("to"))
    known = placed.select(*keys, F.col("place").alias("to"))
    hops = written(hops.join(known, [*keys, "to"]).select(*keys, "place", "to"))  # a save beyond the last visit is none

    marked = written(starts.select(*keys, "place", F.lit(0).cast("long").alias("segment")))
    jumps, step = hops, 1
    while True:
        new = written(marked.join(jumps, [*keys, "place"]).select(*keys, F.col("to").alias("place"), (F.col("segment") + step).alias("segment")))
        if new.isEmpty():
            break
        marked = marked.unionByName(new)
        onward = jumps.select(*keys, F.col("place").alias("to"), F.col("to").alias("further"))
        jumps, step = written(jumps.join(onward, [*keys, "to"]).select(*keys, "place", F.col("further").alias("to"))), 2 * step

    last = placed.groupBy(*keys).agg(F.max("place").alias("n"))
    spans = marked.join(hops, [*keys, "place"], "left").join(last, keys).filter(F.col("place") < F.col("n"))
    inside = F.explode(F.sequence(F.col("place") + 1, F.coalesce("to", "n")))
    members = spans.select(*keys, "segment", F.col("to").isNotNull().alias("saved"), inside.alias("place"))
    return members.join(placed, [*keys, "place"]).select(*keys, F.col("visit").alias(visit), "segment", "saved")


# --- the frontier as a deque ---------------------------------------------------------------------------------------

BACK, FRONT, TAKE = "back", "front", "take"


def replayed(log: DataFrame, keys: list[str], order: list[str], item: str) -> tuple[DataFrame, DataFrame]:
    """(taken, waiting) of a log of what was done to each key's deque: rows (keys…, order…, op, item).

    op is back (an item joins the end), front (one that failed goes back to the front) or take (the first item is
    dispatched; the row's own item is not read). taken has a row for each take: keys, order, item (the one it got) and
    came (back or front, by which that item came in), both null where the deque was empty. waiting has what is left:
    keys, order, item, side and turn, by which the deque is sorted. order must be total, other columns are not read.

    An item's key is (0, -place) where it was put in front and (1, place) where it joined the end, so a later front
    item is before an earlier one. Of front items there are as many as fronts have outnumbered takes since the least
    such balance so far; a take that makes a new least finds none and turns to the end's items, which go out in
    order. A front item goes to the next take on its own level of the balance: sorted by level and place, it is the
    row after it. So each take is matched by joins on places, however long a site's log is.
    """
    op = F.col("op")
    rows = log.select(*keys, *order, "op", F.col(item).alias("item"))
    rows = written(numbered(rows, keys, list(order)))
    rows = running(rows, keys, F.when(op == FRONT, 1).when(op == TAKE, -1).otherwise(0), "balance")
    rows = running(rows, keys, F.col("balance"), "least", least=True)
    from_end = (op == TAKE) & (F.col("least") < F.col("least_before"))
    rows = running(rows, keys, F.when(op == BACK, 1).when(from_end, -1).otherwise(0), "line")
    rows = running(rows, keys, F.col("line"), "short", least=True)
    rows = running(rows, keys, (op == BACK).cast("long"), "joined")
    empty = from_end & (F.col("short") < F.col("short_before"))
    got = rows.withColumns({"from_end": from_end & ~empty, "empty": empty, "turn": F.when(op == BACK, F.col("joined")).otherwise(F.col("short") - F.col("least"))})

    ends = got.filter(op == BACK).select(*keys, "turn", F.col("item").alias("got"), *[F.col(c).alias(f"__{c}") for c in order])
    takes = got.filter("from_end").select(*keys, *order, "turn")
    by_end = takes.join(ends, [*keys, "turn"]).select(*keys, *order, F.col("got").alias("item"), F.lit(BACK).alias("came"))
    left_end = ends.join(takes.select(*keys, "turn"), [*keys, "turn"], "left_anti").select(*keys, *[F.col(f"__{c}").alias(c) for c in order], F.col("got").alias("item"), F.lit(1).alias("side"), "turn")

    stack = got.filter((op == FRONT) | ((op == TAKE) & ~from_end))
    level = F.when(op == FRONT, F.col("balance")).otherwise(F.col("balance") + 1)
    stack = written(numbered(stack.select(*keys, *order, "op", "item", "place", level.alias("level")), keys, ["level", "place"], "at"))
    fronts = stack.filter(op == FRONT).select(*keys, (F.col("at") + 1).alias("at"), F.col("item").alias("got"), *[F.col(c).alias(f"__{c}") for c in order], F.col("place").alias("__place"))
    back_out = stack.filter(op == TAKE).select(*keys, "at", *order)
    by_front = back_out.join(fronts, [*keys, "at"]).select(*keys, *order, F.col("got").alias("item"), F.lit(FRONT).alias("came"))
    left_front = fronts.join(back_out.select(*keys, "at"), [*keys, "at"], "left_anti").select(*keys, *[F.col(f"__{c}").alias(c) for c in order], F.col("got").alias("item"), F.lit(0).alias("side"), (-F.col("__place")).alias("turn"))

    none = got.filter("empty").select(*keys, *order, F.lit(None).cast(rows.schema["item"].dataType).alias("item"), F.lit(None).cast("string").alias("came"))
    return by_end.unionByName(by_front).unionByName(none), left_front.unionByName(left_end)


# --- best first ----------------------------------------------------------------------------------------------------


def best_first(items: DataFrame, links: DataFrame, keys: list[str], node: str, priority: list[Column | str], budget: int = 0) -> DataFrame:
    """Rows (keys…, node, place): the order in which a queue that always takes its best item takes what it reaches.

    items has keys, node, start and whatever priority sorts by, best first and total; links has keys, src and dst. The
    queue of each key begins with its starts, and a node that is taken adds those it links to. Nodes that are not
    reached have no row, links to what is no item are nothing, and budget keeps the first so many of each key.

    Nothing is taken one by one. Of all paths to a node, take the one whose worst item is best: that item is the
    node's gate, for the node is taken as soon as its gate has been, before any item worse than that. Gates are found for
    all nodes at once, in rounds as many as a path is long; a path of ever better items nests that deep. What one gate lets in is ordered by the same rule with the
    gate as its start; the gates found one inside the other are a node's key, and keys sort as the queue does.
    """
    rows = written(numbered(items.select(*keys, node, "start", *[c for c in items.columns if c not in (*keys, node, "start")]), keys, priority, "rank").select(*keys, node, "start", "rank"))
    end = lambda side, name: rows.select(*keys, F.col(node).alias(side), F.col("rank").alias(name))
    edges = written(links.select(*keys, "src", "dst").join(end("src", "source"), [*keys, "src"]).join(end("dst", "target"), [*keys, "dst"]).filter("source <> target").select(*keys, "source", "target").distinct())

    gates = F.array().cast("array<long>")
    inside = rows.select(*keys, "rank", gates.alias("gates"))
    reached = rows.filter("start").select(*keys, gates.alias("gates"), "rank", F.col("rank").alias("gate"))
    settled = None
    while True:
        found = _gates(inside, reached, edges, keys)
        keyed = written(found.select(*keys, F.array_append("gates", F.col("gate")).alias("gates"), "rank", (F.col("gate") == F.col("rank")).alias("own")))
        done = keyed.filter("own").select(*keys, "rank", "gates")
        settled = done if settled is None else settled.unionByName(done)
        inside = keyed.filter("not own").select(*keys, "rank", "gates")
        if inside.isEmpty():
            break
        let_in = done.select(*keys, "gates", F.col("rank").alias("source")).join(edges, [*keys, "source"]).select(*keys, "gates", F.col("target").alias("rank"))
        reached = written(let_in.join(inside, [*keys, "gates", "rank"], "left_semi").distinct().withColumn("gate", F.col("rank")))
    order = numbered(settled, keys, ["gates"])
    order = order.filter(F.col("place") <= budget) if budget else order
    return order.join(rows.select(*keys, "rank", node), [*keys, "rank"]).select(*keys, node, "place")


def _gates(inside: DataFrame, reached: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys…, gates, rank, gate) of what reached leads to among inside, each with the least worst rank on a path to it."""
    group = [*keys, "gates", "rank"]
    best = written(reached.select(*group, "gate", F.lit(True).alias("changed")))
    while True:
        moved = best.filter("changed").select(*keys, "gates", F.col("rank").alias("source"), "gate")
        offers = moved.join(edges, [*keys, "source"]).select(*keys, "gates", F.col("target").alias("rank"), F.greatest("gate", "target").alias("gate"))
        offers = offers.groupBy(*group).agg(F.min("gate").alias("offer")).join(inside, group, "left_semi")
        both = best.select(*group, "gate").join(offers, group, "full")
        better = F.col("gate").isNull() | F.coalesce(F.col("offer") < F.col("gate"), F.lit(False))
        best = written(both.select(*group, F.when(better, F.col("offer")).otherwise(F.col("gate")).alias("gate"), better.alias("changed")))
        if best.filter("changed").isEmpty():
            return best.drop("changed")
