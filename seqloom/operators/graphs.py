"""Similarity graphs: induced and split graphs, closures, components, paralog collapse, Markov clustering.

Edges are ``(seq1, seq2, score)``, each unordered pair once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.operators.hits import best_hits, both_directions
from seqloom.plans.stages import Stages

MAX_ROUNDS = 100


def induced(edges: DataFrame, members: DataFrame, key: str = "member") -> DataFrame:
    """The edges with both ends among the members."""
    out = edges
    for side in ("seq1", "seq2"):
        out = out.join(members.select(F.col(key).alias(side)).distinct(), side, "left_semi")
    return out.select(edges.columns)


def split(edges: DataFrame, members: DataFrame, key: str = "member") -> tuple[DataFrame, DataFrame]:
    """(edges with both ends among the members, edges with neither); edges with one end are in neither part."""
    rest = edges
    for side in ("seq1", "seq2"):
        rest = rest.join(members.select(F.col(key).alias(side)).distinct(), side, "left_anti")
    return induced(edges, members, key), rest.select(edges.columns)


def without_edges(edges: DataFrame, taken: DataFrame) -> DataFrame:
    """The edges that are not among the taken ones."""
    return edges.join(taken.select("seq1", "seq2"), ["seq1", "seq2"], "left_anti")


def components(edges: DataFrame, a: str = "seq1", b: str = "seq2") -> DataFrame:
    """``(member, grp)``: connected components by smallest label, with pointer jumping; written once a round."""
    stages = Stages(edges.sparkSession, "labels")
    sides = stages.cut(both_directions(edges.where(F.col(a) != F.col(b)), a, b).distinct(), "sides")
    labels = stages.cut(sides.groupBy(F.col("a").alias("member")).agg(F.least(F.min("b"), F.first("a")).alias("grp")), "labels")
    for _ in range(MAX_ROUNDS):
        near = sides.join(labels.select(F.col("member").alias("b"), "grp"), "b").groupBy(F.col("a").alias("member")).agg(F.min("grp").alias("g"))
        hooked = labels.join(near, "member").select("member", F.col("grp").alias("old"), F.least("grp", "g").alias("grp"))
        jump = labels.select(F.col("member").alias("grp"), F.col("grp").alias("root"))
        moved = hooked.join(jump, "grp", "left").select("member", "old", F.coalesce(F.least("root", "grp"), "grp").alias("grp"))
        moved, changed = stages.cut_counted(moved, "labels", F.col("old") != F.col("grp"))
        stages.drop(labels)
        labels = moved
        if not changed:
            return labels.select("member", "grp")
    raise RuntimeError("labels did not settle")


def sized_components(edges: DataFrame, least: int = 3, a: str = "seq1", b: str = "seq2") -> DataFrame:
    """The components of at least ``least`` members."""
    members = components(edges, a, b)
    big = members.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return members.join(big.select("grp"), "grp", "left_semi").select("member", "grp")


def best_hit_closure(edges: DataFrame) -> DataFrame:
    """``(member, grp)``: groups of what best hits, all ties included, reach from each other."""
    hits = best_hits(edges, "seq1", "seq2", "score")
    return components(hits, "a", "b")


def collapse_paralogs(edges: DataFrame, taxon, rounds: int = MAX_ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(``(member, kept)``, the edges left): reciprocal best hits of one taxon are folded until there are none.

    In a round every group of reciprocal best hits within a taxon is folded into its smallest member, and the
    edges of the others are dropped; the next round looks at the edges left.
    """
    stages = Stages(edges.sparkSession, "paralogs")
    left, folded = edges.select("seq1", "seq2", "score"), None
    for _ in range(rounds):
        hits = best_hits(left, "seq1", "seq2", "score")
        back = hits.select(F.col("b").alias("a"), F.col("a").alias("b"))
        pairs = hits.where(taxon(F.col("a")) == taxon(F.col("b"))).join(back, ["a", "b"], "left_semi").where("a < b")
        pairs, n = stages.cut_counted(pairs.select("a", "b"), "pairs")
        if not n:
            break
        fold = stages.cut(components(pairs, "a", "b").where("member <> grp").select("member", F.col("grp").alias("kept")), "fold")
        folded = fold if folded is None else folded.join(fold.select(F.col("member").alias("kept"), F.col("kept").alias("then")), "kept", "left").select(
            "member", F.coalesce("then", "kept").alias("kept")
        ).unionByName(fold)
        folded = stages.cut(folded, "folded")
        gone = fold.select(F.col("member"))
        left = stages.cut(
            left.join(gone.withColumnRenamed("member", "seq1"), "seq1", "left_anti").join(gone.withColumnRenamed("member", "seq2"), "seq2", "left_anti").select("seq1", "seq2", "score"),
            "edges",
        )
    else:
        raise RuntimeError(f"paralogs are still to be folded after {rounds} rounds")
    if folded is None:
        folded = edges.select(F.col("seq1").alias("member"), F.col("seq1").alias("kept")).limit(0)
    return folded, left


def markov_clusters(edges: DataFrame, inflation: float = 2.0, threshold: float = 0.0, prune: float = 1e-4, rounds: int = 100) -> DataFrame:
    """``(member, grp)``: Markov clustering of the edges at or above the threshold; see :func:`markov_grid`."""
    return markov_grid(edges, [(inflation, threshold)], prune, rounds).select("member", "grp")


#: Members of a block that one task clusters in memory.
MOST_MEMBERS = 1000
#: Edges for each task that clusters blocks, about.
TASK_EDGES = 50_000
#: Entries of a column of the flow from which on its products are counted and not made.
HEAVY = 500


def markov_grid(edges: DataFrame, settings: list[tuple[float, float]], prune: float = 1e-4, rounds: int = 100, block: str | None = None) -> DataFrame:
    """``(k, member, grp)``: Markov clustering under each setting (inflation, edge threshold), all of them in one plan.

    Columns of the flow sum to one.  A round expands the flow, inflates, and leaves out values below ``prune`` (of a
    column that has no other its largest ones are kept).  A part is done when its flow hardly changes; one that is not
    after ``rounds`` is an error.  The groups are the components of what flow is left.

    Flow stays within a connected part of the edges, so parts of up to ``MOST_MEMBERS`` are clustered in the tasks'
    memory, many in each (:mod:`~seqloom.operators.markov`); larger ones by joins.  ``block`` names a column of the
    edges whose values are such parts, or several of them together, where that is known.
    """
    from seqloom.operators.markov import cluster_blocks

    stages = Stages(edges.sparkSession, "flow")
    least = min(t for _, t in settings)
    columns = ["seq1", "seq2", "score"] if block is None else [F.col(block).alias("block"), "seq1", "seq2", "score"]
    strong, n = stages.cut_counted(edges.where((F.col("score") >= least) & (F.col("seq1") != F.col("seq2"))).select(columns), "edges")
    if block is None:
        parts = stages.cut(_blocks(strong, stages), "blocks")
        labelled = strong.withColumn("key", F.xxhash64("seq1")).join(parts, "key").select("block", "seq1", "seq2", "score")
        sizes = parts.groupBy("block").agg(F.count(F.lit(1)).alias("size"))
    else:
        labelled = strong
        ends = strong.select("block", F.explode(F.array("seq1", "seq2")).alias("member")).distinct()
        sizes = ends.groupBy("block").agg(F.count(F.lit(1)).alias("size"))
    # each has more members than a task takes, so they are few
    large, many = stages.cut_counted(sizes.where(F.col("size") > MOST_MEMBERS).select("block"), "large")
    small = labelled.join(F.broadcast(large), "block", "left_anti") if many else labelled
    tasks = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // TASK_EDGES))
    ready = small.repartition(tasks, "block").sortWithinPartitions("block")
    found, open_ = stages.cut_counted(ready.mapInPandas(cluster_blocks(settings, prune, rounds), "k int, member string, grp string"), "found", F.col("grp").isNull())
    if open_:
        _not_settled(rounds, [settings[r.k] for r in found.where("grp is null").select("k").distinct().collect()])
    if many:
        rest = labelled.join(F.broadcast(large), "block", "left_semi").select("seq1", "seq2", "score")
        found = found.unionByName(_markov_by_joins(rest, settings, prune, rounds, stages))
    return found


def _blocks(edges: DataFrame, stages: Stages) -> DataFrame:
    """``(key, block)``: the hash of every vertex and a number of its component, by contraction: in a round every vertex goes to the
    smallest of its neighbours and itself in a new order, and edges follow.  Vertices of equal hash share a block, which may
    so hold several components."""
    left, maps = stages.cut(edges.select(F.xxhash64("seq1").alias("u"), F.xxhash64("seq2").alias("v")).where("u <> v"), "links"), []
    for r in range(MAX_ROUNDS):
        place = lambda c: F.struct(F.xxhash64(c, F.lit(r)).alias("at"), F.col(c).alias("to"))  # noqa: B023, E731
        both = left.select(F.inline(F.array(*[F.struct(F.col(a).alias("key"), F.least(place("u"), place("v")).alias("low")) for a in "uv"])))
        to = stages.cut(both.groupBy("key").agg(F.min("low").alias("low")).select("key", "low.to"), "to")
        maps.append(to)
        step = lambda c: to.select(F.col("key").alias(c), F.col("to").alias(f"{c}2"))  # noqa: B023, E731
        half = left.join(step("u"), "u").select("u2", "v").distinct() if r else left.join(step("u"), "u").select("u2", "v")
        moved = half.join(step("v"), "v").where("u2 <> v2").select(F.least("u2", "v2").alias("u"), F.greatest("u2", "v2").alias("v")).distinct()
        after, n = stages.cut_counted(moved, "links")
        stages.drop(left)
        left = after
        if not n:
            break
    else:
        raise RuntimeError("links did not contract")
    found = maps.pop().withColumnRenamed("to", "block")
    while maps:
        then = found.select(F.col("key").alias("to"), "block")
        found = maps.pop().join(then, "to", "left").select("key", F.coalesce("block", "to").alias("block"))
    return found


def _not_settled(rounds: int, settings: list) -> None:
    raise RuntimeError(f"Markov clustering has not settled after {rounds} rounds under {sorted(settings)}")


def _markov_by_joins(edges: DataFrame, settings: list[tuple[float, float]], prune: float, rounds: int, stages: Stages) -> DataFrame:
    """:func:`markov_grid` of parts of any size: the flow is a table ``(k, i, j, v)``, expanded by a join and a sum."""
    table = edges.sparkSession.createDataFrame([(k, float(i), float(t)) for k, (i, t) in enumerate(settings)], "k int, p double, threshold double")
    strong = edges.crossJoin(F.broadcast(table)).where(F.col("score") >= F.col("threshold"))
    sides = both_directions(strong, "seq1", "seq2", "score", "k", "p").select("k", "p", F.col("a").alias("i"), F.col("b").alias("j"), F.col("score").alias("v"))
    loops = sides.groupBy("k", "p", "j").agg(F.max("v").alias("v")).select("k", "p", F.col("j").alias("i"), "j", "v")
    column = Window.partitionBy("k", "j")
    start = sides.unionByName(loops).groupBy("k", "p", "i", "j").agg(F.max("v").alias("v"))
    flow = stages.cut(start.withColumn("v", F.try_divide(F.col("v"), F.sum("v").over(column))), "flow")
    done, todo = None, set(range(len(settings)))
    for _ in range(rounds):
        spread = _expanded(flow, prune, stages)
        # rows without i are what a column's sum has besides its entries
        shared = spread.withColumn("v", F.try_divide("v", F.sum("v").over(column))).where("i is not null")
        kept = shared.withColumn("most", F.max("v").over(column)).where(F.col("v") >= F.least(F.lit(prune), "most")).drop("most")
        new = kept.withColumn("v", F.try_divide("v", F.sum("v").over(column)))
        old = flow.select("k", "i", "j", F.col("v").alias("before"))
        moving = F.abs(F.col("v") - F.coalesce("before", F.lit(0.0))) > 1e-3
        new = stages.cut(new.join(old, ["k", "i", "j"], "left").select("k", "p", "i", "j", "v", moving.alias("moving")), "flow")
        stages.drop(flow)
        still = {r.k for r in new.where("moving").select("k").distinct().collect()}  # a row a setting
        if still != todo:
            ended = new.where(F.col("k").isin(list(todo - still))).select("k", "i", "j")
            done = ended if done is None else done.unionByName(ended)
            todo = still
        if not todo:
            break
        flow = new.where(F.col("k").isin(list(todo))).drop("moving")
    if todo:
        _not_settled(rounds, [settings[k] for k in todo])
    mark = lambda c: F.concat_ws("\x1f", F.col("k").cast("string"), c).alias
    linked = stages.cut(done.select(mark("i")("seq1"), mark("j")("seq2")), "linked")
    groups = components(linked)
    alone = linked.select(F.col("seq1").alias("member")).distinct().join(groups, "member", "left_anti").select("member", F.col("member").alias("grp"))
    both = groups.unionByName(alone)
    plain = lambda c: F.expr(f"substr({c}, instr({c}, '\x1f') + 1)").alias(c)
    return both.select(F.substring_index("member", "\x1f", 1).cast("int").alias("k"), plain("member"), plain("grp"))


def _expanded(flow: DataFrame, prune: float, stages: Stages) -> DataFrame:
    """``(k, p, i, j, v)``: the squared flow, inflated, not yet shared out; rows of no ``i`` hold a column's further sum.

    A vertex tied to n others would make n x n products, of which nearly all are left out again.  A column j that
    flows through one such vertex with a column h of more than ``HEAVY`` entries, by c, has the entries of its other
    ways, each with c h_i, and c h_i for all others: their inflated sum is c^p times what is left of that of h, and
    those that are not too small to stay are found by the size of h_i.
    """
    left = flow.select("k", "p", "i", F.col("j").alias("via"), "v")
    right = flow.select("k", F.col("i").alias("via"), "j", F.col("v").alias("w"))
    product = lambda r: left.join(r, ["k", "via"]).groupBy("k", "p", "i", "j").agg(F.sum(F.col("v") * F.col("w")).alias("v"))
    inflated = F.pow("v", "p")
    heavy, n = stages.cut_counted(flow.groupBy("k", "p", F.col("j").alias("via")).agg(F.count(F.lit(1)).alias("n"), F.sum(inflated).alias("all"), F.max("v").alias("top")).where(F.col("n") > HEAVY).drop("n"), "heavy")
    if not n:
        return product(right).withColumn("v", inflated)
    # a column of several such vertices goes its ways one by one
    ways = right.join(heavy, ["k", "via"]).withColumn("ways", F.count(F.lit(1)).over(Window.partitionBy("k", "j"))).where("ways = 1").drop("ways")
    ways = stages.cut(ways.withColumnRenamed("w", "c"), "ways")
    light = product(right.join(ways.select("k", "via", "j"), ["k", "via", "j"], "left_anti"))
    of = ways.select("k", "via", "j", "c")
    h = left.join(heavy.select("k", "via"), ["k", "via"], "left_semi").select("k", "via", "i", F.col("v").alias("h"))
    met = light.join(of, ["k", "j"], "left").join(h, ["k", "via", "i"], "left")
    h0 = F.coalesce("h", F.lit(0.0))
    met = stages.cut(met.select("k", "p", "i", "j", F.pow(F.col("v") + F.coalesce(F.col("c") * h0, F.lit(0.0)), "p").alias("v"), F.col("c").isNotNull().alias("through"), F.pow(h0, "p").alias("hp")), "met")
    own = met.where("through").groupBy("k", "j").agg(F.sum("v").alias("sum"), F.max("v").alias("most"), F.sum("hp").alias("hp"))
    scale = F.pow("c", "p")
    rest = scale * F.greatest(F.col("all") - F.coalesce("hp", F.lit(0.0)), F.lit(0.0))
    total = F.coalesce("sum", F.lit(0.0)) + rest
    least = F.pow(total * prune * (1 - 1e-9) / scale, 1 / F.col("p"))
    bound = F.when(F.coalesce("most", F.lit(0.0)) >= total * prune, least).otherwise(F.least(least, "top"))
    asked = stages.cut(ways.join(own, ["k", "j"], "left").select("k", "p", "via", "j", "c", "top", rest.alias("rest"), bound.alias("bound")), "asked")
    seen = met.where("through").select("k", "i", "j")
    more = asked.where("bound <= top").join(h, ["k", "via"]).where("h >= bound").join(seen, ["k", "i", "j"], "left_anti")
    more = stages.cut(more.select("k", "p", "i", "j", F.pow(F.col("c") * F.col("h"), "p").alias("v")), "more")
    taken = more.groupBy("k", "j").agg(F.sum("v").alias("taken"))
    further = asked.join(taken, ["k", "j"], "left").select("k", "p", F.lit(None).cast("string").alias("i"), "j", F.greatest(F.col("rest") - F.coalesce("taken", F.lit(0.0)), F.lit(0.0)).alias("v"))
    return met.select("k", "p", "i", "j", "v").unionByName(more).unionByName(further)


def few_ids(edges: DataFrame, a: str, b: str, most: int = 5000) -> list[str]:
    """The ids of a graph in order, for the columns of a matrix; more than ``most`` are an error."""
    found = edges.select(F.explode(F.array(a, b)).alias("id")).distinct().orderBy("id").limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} ids: a matrix is not the form for this graph")
    return [r.id for r in found]


def matrix_form(edges: DataFrame, ids: list[str], diagonal: float = 1.0) -> DataFrame:
    """A square labelled matrix of stated ids (its columns): symmetric, a constant on the diagonal, null without an edge."""
    sides = both_directions(edges, "seq1", "seq2", "score").select(F.col("a").alias("id"), F.col("b").alias("other"), "score")
    spark = edges.sparkSession
    own = spark.createDataFrame([(i,) for i in ids], "id string").select("id", F.col("id").alias("other"), F.lit(diagonal).alias("score"))
    chosen = sides.where(F.col("id").isin(ids) & F.col("other").isin(ids))
    return chosen.unionByName(own).groupBy("id").pivot("other", ids).agg(F.max("score"))


def melted(matrix: DataFrame, id_: str) -> DataFrame:
    """``(seq1, seq2, score)`` of a square labelled matrix: each unordered pair once, blanks and the diagonal left out."""
    others = [c for c in matrix.columns if c != id_]
    long = matrix.unpivot([id_], others, "other", "score").where("score is not null").where(F.col(id_) != F.col("other"))
    return long.select(F.least(id_, "other").alias("seq1"), F.greatest(id_, "other").alias("seq2"), "score").distinct()


def linkage(edges: DataFrame, cut_at: float, method: str = "single") -> DataFrame:
    """``(member, grp)``: hierarchical clustering of distances cut at a height; ``score`` is a similarity in 0..1.

    Single linkage is the components of close pairs.  Complete linkage is refined within those components, one
    component in a task: there all members must be close to each other.
    """
    close = edges.where(1 - F.col("score") <= cut_at)
    groups = components(close)
    if method == "single":
        return groups
    if method != "complete":
        raise ValueError("method must be single or complete")
    g = groups.select(F.col("member").alias("seq1"), "grp")
    inner = close.join(g, "seq1").select("grp", "seq1", "seq2", "score")

    def agglomerate(pdf):
        import heapq

        import pandas as pd

        # links between groups whose members are all close to each other, with the largest distance; both directions
        far: dict = {}
        for a, b, s in zip(pdf["seq1"], pdf["seq2"], pdf["score"]):
            far.setdefault(a, {})[b] = far.setdefault(b, {})[a] = 1 - s
        groups = {m: [m] for m in far}  # by its smallest member
        heap = [(d, a, b) for a, near in far.items() for b, d in near.items() if a < b]
        heapq.heapify(heap)
        while heap:
            d, a, b = heapq.heappop(heap)
            if a not in groups or b not in groups or far[a].get(b) != d:
                continue  # of a group that is no more, or has grown
            groups[a] = sorted(groups[a] + groups.pop(b))
            gone = far.pop(b)
            del far[a][b], gone[a]
            for c in [c for c in far[a] if c not in gone]:
                del far[a][c], far[c][a]
            for c in gone:
                far[c].pop(b, None)
            for c in far[a]:
                if c in gone:
                    far[a][c] = far[c][a] = max(far[a][c], gone[c])
                    heapq.heappush(heap, (far[a][c], min(a, c), max(a, c)))
        return pd.DataFrame([(m, g[0]) for g in groups.values() for m in g], columns=["member", "grp"])

    return inner.groupBy("grp").applyInPandas(agglomerate, "member string, grp string")
