"""Parent-child links to full hierarchies: peeling, Euler tours and parallel list ranking."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..tables import cut


def parent_links(nodes: DataFrame, id_col: str = "id", parents_col: str = "parent_ids") -> tuple[DataFrame, DataFrame]:
    """``(ids, links)``: distinct ids, and distinct ``(child, parent)`` where both are in the table."""
    ids = cut(nodes.select(F.col(id_col).cast("bigint").alias("id")).where("id is not null").distinct())
    links = nodes.select(F.col(id_col).cast("bigint").alias("child"), F.explode(parents_col).alias("parent")).select("child", F.col("parent").cast("bigint").alias("parent"))
    links = links.where("child is not null and parent is not null").distinct().join(ids.withColumnRenamed("id", "parent"), "parent", "left_semi")
    return ids, cut(links.select("child", "parent"))


def _rake(ids: DataFrame, links: DataFrame) -> tuple[list[tuple[DataFrame, DataFrame]], DataFrame, DataFrame]:
    """Peel leaves, nodes without children, as long as a round removes a tenth of what is left: ``(layers, nodes, links)``.

    A layer is the leaves of one round and their links; what remains holds every circle. The rounds are at most
    logarithmic in the nodes: where leaves are few (long chains), peeling stops and ``_settle`` takes over.
    """
    layers: list[tuple[DataFrame, DataFrame]] = []
    n = ids.count()
    while n:
        seen = Observation()
        inner = ids.join(links.select(F.col("parent").alias("id")).distinct(), "id", "left_semi")
        inner = cut(inner.observe(seen, F.count(F.lit(1)).alias("n")))
        if (n - seen.get["n"]) * 10 < n:
            return layers, ids, links
        held = inner.select(F.col("id").alias("child"), F.lit(True).alias("kept"))
        marked = cut(links.join(held, "child", "left").select("child", "parent", F.coalesce("kept", F.lit(False)).alias("kept")))
        layers.append((ids.join(inner, "id", "left_anti"), marked.where("not kept").select("child", "parent")))
        ids, links, n = inner, marked.where("kept").select("child", "parent"), seen.get["n"]
    return layers, ids, links


def _follow(chosen: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Follow the one chosen parent of each node by pointer doubling: ``(way, circles)``.

    ``chosen`` has ``id``, ``parent``, ``hit`` and ``salt``, the number of the choice where several are followed at once. ``way`` has for each id the end ``to`` of its way up, the ``steps`` to it and
    whether any node on it was ``hit``. ``circles`` has the ids on circles of chosen parents with the smallest id of the circle
    as ``label``; it is None if every way ends. After k rounds a way that has not ended is 2^k steps long. Of acyclic ways more
    than 2^(k-1) would then have moved in the last round, so with 2^k at least twice the moved ones only circles and
    what hangs on them is left, and every pointer is on its circle.
    """
    way = cut(chosen.select("salt", "id", F.col("parent").alias("to"), F.lit(1).cast("bigint").alias("steps"), F.col("id").alias("least"), "hit", F.lit(False).alias("done")))
    k = 0
    while True:
        ahead = way.select("salt", F.col("id").alias("to"), F.col("to").alias("to2"), F.col("steps").alias("s2"), F.col("least").alias("l2"), F.col("hit").alias("h2"))
        seen = Observation()
        # a way that has ended looks for a key that is none's, so that the many that end in one root don't meet in one task
        moved = way.withColumn("key", F.when(F.col("done"), F.col("id") - (1 << 62)).otherwise(F.col("to"))).drop("done").join(ahead.withColumnRenamed("to", "key"), ["salt", "key"], "left").select(
            "salt", "id", F.coalesce("to2", "to").alias("to"), (F.col("steps") + F.coalesce("s2", F.lit(0))).alias("steps"), F.least("least", "l2").alias("least"),
            (F.col("hit") | F.coalesce("h2", F.lit(False))).alias("hit"), F.col("to2").isNull().alias("done"),
        )
        way = cut(moved.observe(seen, F.count_if(~F.col("done")).alias("n")), replaces=way)
        k, n = k + 1, seen.get["n"]
        if n == 0:
            return way, None
        if 2**k >= 2 * n:
            open_ = way.where("not done").join(way.select("salt", F.col("id").alias("to")), ["salt", "to"], "left_semi")
            on = cut(open_.select("salt", F.col("to").alias("id")).distinct())
            return (way, None) if on.isEmpty() else (way, cut(way.join(on, ["salt", "id"], "left_semi").groupBy("id").agg(F.min("least").alias("label"))))


def _contracted(circles, under, ids, links, depth, stuck, member):  # noqa: ANN001, ANN202
    """The state of ``_settle`` with every circle as one node, its smallest id; ``under`` are nodes newly known to lie on or under one.

    Choices followed at once may put a node on several circles; it goes to the smallest, and what is left of the
    others is still a circle of the contracted graph.
    """
    up = lambda c: circles.select(F.col("id").alias(c), F.col("label").alias(f"{c}_label"))
    if under is not None:
        stuck = under if stuck is None else stuck.unionByName(under)
    stuck = cut(stuck.join(up("id"), "id", "left").select(F.coalesce("id_label", "id").alias("id")).distinct())
    if depth is not None:
        depth = cut(depth.join(up("id"), "id", "left").groupBy(F.coalesce("id_label", "id").alias("id")).agg(F.max("depth").alias("depth")))
    ids = cut(ids.join(up("id"), "id", "left").select(F.coalesce("id_label", "id").alias("id")).distinct())
    joined = links.join(up("child"), "child", "left").join(up("parent"), "parent", "left")
    links = cut(joined.select(F.coalesce("child_label", "child").alias("child"), F.coalesce("parent_label", "parent").alias("parent")).where("child <> parent").distinct())
    if member is None:
        return ids, links, depth, stuck, circles
    again = member.join(circles.select(F.col("id").alias("label"), F.col("label").alias("next")), "label", "left").select("id", F.coalesce("next", "label").alias("label"))
    return ids, links, depth, stuck, cut(again.unionByName(circles.join(member.select("id"), "id", "left_anti")))


def _settle(ids: DataFrame, links: DataFrame) -> DataFrame:
    """``(id, depth, circle, bad)``: largest number of steps from a root, whether the node is on a circle, and whether an ancestor is or it is itself.

    Every node chooses one parent and the chosen ways are measured by pointer doubling. Circles of chosen parents are
    contracted to their smallest id. Among the nodes known to lie on or under a circle several choices by hash are followed at
    once, which exposes the circles that share nodes. When they show none, all nodes choose the deepest parent known, at
    first the one that names the most parents itself. When that shows no circle either, nodes choose anew where another parent lies deeper. Around a circle somebody always
    finds a deeper parent, so when nobody does, the contracted graph has no circle left and the depths are the longest
    ways. Which nodes are under a circle is found likewise, choosing parents known to be. A doubling takes as many rounds
    as the logarithm of the longest way; lists of ancestors settle in a few choices.
    """
    # nodes that name themselves are circles of their own
    own = cut(links.where("child = parent").select(F.col("child").alias("id"), F.col("child").alias("label")).distinct())
    member: DataFrame | None = None if own.isEmpty() else own
    links = links.where("child <> parent")
    none, zero = F.lit(False).alias("hit"), F.lit(0).alias("salt")
    stuck: DataFrame | None = None  # known to lie on or under a circle
    depth: DataFrame | None = None  # as measured last
    turn = 0
    while True:
        circles = None
        if stuck is not None:  # several choices at once among them, by hash
            near = links.join(stuck.withColumnRenamed("id", "child"), "child", "left_semi").join(stuck.withColumnRenamed("id", "parent"), "parent", "left_semi")
            salted = near.withColumn("salt", F.explode(F.array(*map(F.lit, range(4))))).groupBy("salt", F.col("child").alias("id"))
            way, circles = _follow(salted.agg(F.max_by("parent", F.xxhash64(F.lit(turn), "salt", "child", "parent")).alias("parent")).select("salt", "id", "parent", none))
            turn += 1
        if circles is not None:
            ids, links, depth, stuck, member = _contracted(circles, None, ids, links, depth, stuck, member)
            continue
        named = links.groupBy(F.col("child").alias("parent")).agg(F.count(F.lit(1)).alias("n"))
        seen_by = links.join(named, "parent", "left")
        order = [F.coalesce("n", F.lit(0)), -F.col("parent")]
        if depth is not None:
            seen_by = seen_by.join(depth.select(F.col("id").alias("parent"), "depth"), "parent", "left")
            order = [F.col("depth"), *order]
        chosen = seen_by.groupBy(F.col("child").alias("id")).agg(F.max_by("parent", F.struct(*order)).alias("parent"))
        while True:
            way, circles = _follow(chosen.select(zero, "id", "parent", none))
            if circles is not None:
                break
            depth = cut(ids.join(way.select("id", F.col("steps").alias("depth")), "id", "left").select("id", F.coalesce("depth", F.lit(0)).cast("bigint").alias("depth")))
            # of equally deep parents the chosen one stays: only what lies deeper is a change
            known = links.join(depth.select(F.col("id").alias("parent"), F.col("depth").alias("d")), "parent").join(chosen.select(F.col("id").alias("child"), F.col("parent").alias("now")), "child")
            best = known.groupBy(F.col("child").alias("id")).agg(F.max(F.struct("d", F.col("parent") == F.col("now"), (-F.col("parent")).alias("key"))).alias("b"))
            seen = Observation()
            best = best.join(depth, "id").select("id", (-F.col("b.key")).alias("parent"), (F.col("b.d") >= F.col("depth")).alias("deeper"))
            chosen = cut(best.observe(seen, F.count_if("deeper").alias("n")))
            if seen.get["n"] == 0:
                break
        if circles is None:
            break
        ids, links, depth, stuck, member = _contracted(circles, way.where("not done").select("id").distinct(), ids, links, depth, stuck, member)
    if member is None:
        return depth.select("id", "depth", F.lit(False).alias("circle"), F.lit(False).alias("bad"))
    bad = cut(member.select(F.col("label").alias("id")).distinct())
    n = bad.count()
    while True:
        known = bad.select(F.col("id").alias("parent"), F.lit(True).alias("hit"))
        pick = links.join(known, "parent", "left").groupBy(F.col("child").alias("id")).agg(F.max(F.struct(F.coalesce("hit", F.lit(False)).alias("hit"), (-F.col("parent")).alias("key"))).alias("b"))
        way, _ = _follow(pick.select(zero, "id", (-F.col("b.key")).alias("parent"), F.col("b.hit").alias("hit")))
        bad = cut(bad.unionByName(way.where("hit").select("id")).distinct())
        before, n = n, bad.count()
        if n == before:
            break
    flags = depth.join(bad.withColumn("bad", F.lit(True)), "id", "left").select("id", "depth", F.coalesce("bad", F.lit(False)).alias("bad"))
    on = member.join(flags.withColumnRenamed("id", "label"), "label").select("id", "depth", F.lit(True).alias("circle"), "bad")
    return cut(flags.join(on, "id", "left_anti").select("id", "depth", F.lit(False).alias("circle"), "bad").unionByName(on))


def _placed(ids: DataFrame, links: DataFrame) -> DataFrame:
    """``(id, depth, circle, bad, parent)``: ``_settle`` for what peeling leaves, then the peeled layers backwards; ``parent`` is the deepest one, of equals the smallest."""
    layers, inner, core = _rake(ids, links)
    settled = _settle(inner, core)
    deepest = lambda via, values: via.join(values.select(F.col("id").alias("parent"), "depth", "bad"), "parent").groupBy(F.col("child").alias("id")).agg(
        F.max(F.struct("depth", (-F.col("parent")).alias("key"))).alias("b"), F.max("bad").alias("under")
    )
    whole = cut(settled.join(deepest(core, settled), "id", "left").select("id", "depth", "circle", "bad", (-F.col("b.key")).alias("parent")))
    for leaves, via in reversed(layers):
        got = leaves.join(deepest(via, whole), "id", "left")
        layer = got.select("id", F.coalesce(F.col("b.depth") + 1, F.lit(0)).cast("bigint").alias("depth"), F.lit(False).alias("circle"), F.coalesce("under", F.lit(False)).alias("bad"), (-F.col("b.key")).alias("parent"))
        whole = whole.unionByName(cut(layer))
    return cut(whole)


def _siblings(tree: DataFrame) -> DataFrame:
    """``(child, sibling)``: the next child of the same parent, by a range sort; no parent's children meet in one task."""
    ordered = tree.repartitionByRange("parent", "child").sortWithinPartitions("parent", "child").withColumn("p", F.spark_partition_id())
    ordered = cut(ordered.select("parent", "child", "p"))
    inner = ordered.withColumn("next", F.lead(F.struct("parent", "child")).over(Window.partitionBy("p").orderBy("parent", "child")))
    first = ordered.groupBy("p").agg(F.min(F.struct("parent", "child")).alias("head"))  # one row a partition
    after = first.select("p", F.lead("head").over(Window.orderBy("p")).alias("over"))
    whole = inner.join(F.broadcast(after), "p").withColumn("next", F.coalesce("next", "over"))
    return whole.select("child", F.when(F.col("next.parent") == F.col("parent"), F.col("next.child")).alias("sibling"))


def _double(steps: DataFrame) -> DataFrame:
    """Pointer doubling over ``(e, next, steps, weight, stop)`` until every ``next`` is a stop or NULL."""
    while True:
        seen = Observation()
        ahead = steps.select(F.col("e").alias("next"), F.col("next").alias("n2"), F.col("steps").alias("s2"), F.col("weight").alias("w2"), F.col("stop").alias("stop2"))
        on = F.col("stop2") == False  # noqa: E712
        jumped = steps.join(ahead, "next", "left").select(
            "e", F.when(on, F.col("n2")).otherwise(F.col("next")).alias("next"),
            (F.col("steps") + F.when(on, F.col("s2")).otherwise(0)).alias("steps"), (F.col("weight") + F.when(on, F.col("w2")).otherwise(0)).alias("weight"), "stop",
            on.alias("moved"),
        )
        steps = cut(jumped.observe(seen, F.count_if("moved").alias("n")).drop("moved"), replaces=steps)
        if seen.get["n"] == 0:
            return steps


def rank_lists(elements: DataFrame, direct: int = 4_000_000, sample: int = 64) -> DataFrame:
    """List ranking: for each ``(e, next, weight)`` the ``last`` element of its list, ``steps`` to it, and the ``weight`` from e to the end.

    ``next`` is NULL at the end of a list. Up to ``direct`` elements by pointer doubling, one self-join a round. Above
    that one element in ``sample`` is a stop, chosen by hash: elements double up to the next stop, in about
    log2(sample * ln n) rounds, the stops alone are ranked, and one join adds both parts. So only those few rounds move
    the whole list.
    """
    ends = F.col("next").isNull()
    base = elements.select("e", F.when(ends, F.col("e")).otherwise(F.col("next")).alias("next"), F.when(ends, 0).otherwise(1).cast("bigint").alias("steps"),
                           F.when(ends, 0).otherwise(F.col("weight")).cast("bigint").alias("weight"), ends.alias("end"), F.col("weight").cast("bigint").alias("own"))
    base = cut(base)
    own = base.where("end").select(F.col("e").alias("last"), "own")
    if base.count() <= direct:
        done = _double(cut(base.select("e", "next", "steps", "weight", F.col("end").alias("stop"))))
        out = done.select("e", F.col("next").alias("last"), "steps", "weight")
    else:
        stop = F.col("end") | (F.pmod(F.xxhash64("e"), F.lit(sample)) == 0)
        part = _double(cut(base.select("e", "next", "steps", "weight", stop.alias("stop"))))
        top = part.where("stop").select("e", F.when(F.col("next") != F.col("e"), F.col("next")).alias("next"), "steps", "weight")
        whole = _double(cut(top.select("e", F.coalesce("next", "e").alias("next"), "steps", "weight", F.col("next").isNull().alias("stop"))))
        rest = whole.select(F.col("e").alias("next"), F.col("next").alias("last"), F.col("steps").alias("s2"), F.col("weight").alias("w2"))
        far = part.where("not stop").join(rest, "next").select("e", "last", (F.col("steps") + F.col("s2")).alias("steps"), (F.col("weight") + F.col("w2")).alias("weight"))
        out = far.unionByName(whole.select("e", F.col("next").alias("last"), "steps", "weight"))
    return out.join(own, "last").select("e", "last", "steps", (F.col("weight") + F.col("own")).alias("weight"))


def hierarchy(nodes: DataFrame, id_col: str = "id", parents_col: str = "parent_ids", direct: int = 4_000_000) -> DataFrame:
    """``(id, root_id, depth, status, parent_id, entry, exit, n_descendants)``: one row per distinct id.

    Leaves are peeled off while there are many, which exposes the circles; the direct parent of a node, the deepest of those it
    names, is found by ``_settle``. ``status`` is 'cycle' for a node that is its own ancestor, else 'below_cycle' if an
    ancestor is, else 'tree'. The tree nodes' Euler tour (down before a node, up after it) is ranked as a list: a
    node's ``entry`` and ``exit`` are its positions in the tour of its root, so a is an ancestor of b when a's interval
    holds b's; ``depth`` is the downs less the ups before it, ``n_descendants`` (exit - entry) / 2. Rounds grow with the
    logarithm of the nodes and not with the depth.

    For 'cycle' and 'below_cycle' root_id, depth, entry, exit, n_descendants and parent_id are -1; a root's parent_id is -1 too.

    NULL ids are dropped and repeated ids count once with all their parents; NULL, repeated and unknown parents do not
    count; a node that names itself is a circle; of several deepest parents the smallest id is taken; other columns are
    not read; an empty table gives an empty result. Ids lie within 2^61 of 0.
    """
    ids, links = parent_links(nodes, id_col, parents_col)
    placed = _placed(ids, links)
    status = placed.select("id", F.when(F.col("circle"), "cycle").when(F.col("bad"), "below_cycle").otherwise("tree").alias("status"))
    forest = placed.where("not bad").select("id", "parent")
    tree = forest.where("parent is not null").select(F.col("id").alias("child"), "parent")
    down, up = (lambda c: c * 2), (lambda c: c * 2 + 1)
    first = tree.groupBy(F.col("parent").alias("id")).agg(F.min("child").alias("first"))
    going_down = forest.join(first, "id", "left").select(down(F.col("id")).alias("e"), F.coalesce(down(F.col("first")), up(F.col("id"))).alias("next"), F.lit(1).alias("weight"))
    going_up = forest.join(_siblings(tree).withColumnRenamed("child", "id"), "id", "left").select(
        up(F.col("id")).alias("e"), F.coalesce(down(F.col("sibling")), up(F.col("parent"))).alias("next"), F.lit(-1).alias("weight")
    )
    ranked = cut(rank_lists(going_down.unionByName(going_up), direct))
    side = F.pmod("e", F.lit(2)) == 0
    placed = (
        ranked.withColumn("id", F.floor((F.col("e") - F.pmod("e", F.lit(2))) / 2).cast("bigint"))
        .groupBy("id")
        .agg(F.max(F.when(side, F.col("steps"))).alias("in"), F.max(F.when(~side, F.col("steps"))).alias("out"), F.max(F.when(side, F.col("weight"))).alias("w"), F.max("last").alias("last"))
        .select("id", ((F.col("last") - 1) / 2).cast("bigint").alias("root_id"), (-F.col("w")).alias("depth"), "in", "out")
    )
    length = placed.where("id = root_id").select("root_id", F.col("in").alias("length"))
    placed = placed.join(length, "root_id").select(
        "id", "root_id", "depth", (F.col("length") - F.col("in")).alias("entry"), (F.col("length") - F.col("out")).alias("exit"), ((F.col("in") - F.col("out") - 1) / 2).cast("bigint").alias("n_descendants")
    )
    whole = status.join(placed, "id", "left").join(forest.select("id", F.col("parent").alias("parent_id")), "id", "left")
    minus = lambda c: F.coalesce(F.col(c), F.lit(-1)).cast("bigint").alias(c)
    return cut(whole.select("id", minus("root_id"), minus("depth"), "status", *[minus(c) for c in ("parent_id", "entry", "exit", "n_descendants")]))


def paths(tree: DataFrame, block: int = 50_000) -> DataFrame:
    """``(id, path)``: the ids from the root down to the node, for the 'tree' rows of ``hierarchy``.

    The tours are cut into blocks of positions. An interval that is open where a block begins is handed to it, so a block
    is swept alone with a stack; it gets at most ``block`` nodes and as many open intervals as the tree is deep.
    """
    nodes = tree.where("status = 'tree'").select("id", "root_id", "entry", "exit")
    at = lambda c: F.floor(F.col(c) / block)
    own = nodes.withColumn("block", at("entry")).withColumn("own", F.lit(True))
    open_ = nodes.where(at("entry") < at("exit")).withColumn("block", F.explode(F.sequence(at("entry") + 1, at("exit")))).withColumn("own", F.lit(False))

    def sweep(rows: pd.DataFrame) -> pd.DataFrame:
        stack: list[tuple[int, int]] = []
        out = []
        for key, entry, exit_, mine in rows.sort_values("entry")[["id", "entry", "exit", "own"]].itertuples(index=False):
            while stack and stack[-1][1] < entry:
                stack.pop()
            stack.append((key, exit_))
            if mine:
                out.append((key, [k for k, _ in stack]))
        return pd.DataFrame(out, columns=["id", "path"])

    return own.unionByName(open_).groupBy("root_id", "block").applyInPandas(sweep, "id bigint, path array<bigint>")
