"""Grouping searches, shuffles, simulation and sampling; none of them has a form in SQL, or a fixed one."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.functions.ids import taxon
from seqloom.operators import grouping, stochastic
from seqloom.operators.alignment import bits_of
from seqloom.operators.dedup import with_row_number
from seqloom.operators.graphs import components, markov_grid
from seqloom.operators.pairs import substitution
from seqloom.queries.alignments import MATRIX
from seqloom.queries.carriers import COLUMNS, TOPOLOGY, columns, graph, sequences, topology
from seqloom.queries.registry import SQL, query, table

#: A child's residue: kept with 0.98, else one of its neighbours in the alphabet.
SUBSTITUTION = {a: (a + b + c, [0.98, 0.99, 1.0]) for a, b, c in zip("ARNDCQEGHILKMFPSTWYV", "RNDCQEGHILKMFPSTWYVA", "NDCQEGHILKMFPSTWYVAR")}


@query(f"SELECT id, symbol AS region, count(*) AS n FROM {TOPOLOGY} GROUP BY 1, 2")
def region_sizes_after_shuffle(spark, sf_dir):
    """A shuffle keeps every region's size: counted over the shuffled rows."""
    c = columns(spark, sf_dir).select("id", "pos", "aa").join(topology(spark, sf_dir), ["id", "pos"])
    s = stochastic.region_shuffle(c, "symbol", 1, 5)
    return s.join(topology(spark, sf_dir), ["id", "pos"]).groupBy("id", F.col("symbol").alias("region")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT shuffle, c.id, symbol AS region, aa, count(*) AS n FROM {COLUMNS} c JOIN {TOPOLOGY} t ON t.id = c.id AND t.pos = c.pos, (VALUES (CAST(0 AS INTEGER)), (CAST(1 AS INTEGER))) s(shuffle) GROUP BY ALL")
def region_shuffle(spark, sf_dir):
    """The residues of every region after two shuffles: the same ones, how often each."""
    t = topology(spark, sf_dir)
    c = columns(spark, sf_dir).select("id", "pos", "aa").join(t, ["id", "pos"])
    s = stochastic.region_shuffle(c, "symbol", 2, 5)
    return s.join(t, ["id", "pos"]).groupBy("shuffle", "id", F.col("symbol").alias("region"), "aa").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH b AS ({SQL['alignment_bits']}) SELECT id1, id2, bits AS observed, CAST(10 AS INTEGER) AS shuffles FROM b")
def null_distributions(spark, sf_dir):
    """Alignment scores of all pairs of rows, and how many shuffled ones of both stand against each."""
    c = columns(spark, sf_dir).select("id", "pos", "aa").join(topology(spark, sf_dir), ["id", "pos"])
    tile = "total double, matches bigint, gaps bigint, residues bigint"
    found = stochastic.null_distributions(c, "symbol", 10, 5, substitution(MATRIX), tile, lambda s: bits_of(s).withColumn("value", F.round("bits", 6)))
    return found.select("id1", "id2", "observed", F.size("shuffled").alias("shuffles"))


@query()
def simulate_generation(spark, sf_dir):
    """One generation of as many children as there are sequences."""
    s = sequences(spark, sf_dir).where("seq <> ''").withColumn("positions", F.transform(F.sequence(F.lit(0), F.length("seq") - 1), lambda n: F.struct(F.xxhash64("id").alias("child"), n.cast("bigint").alias("n"))))
    n = s.count()
    return stochastic.next_generation(s.withColumn("id", F.xxhash64("id")), n, 1, 7, SUBSTITUTION)


@query()
def simulated_population(spark, sf_dir):
    """Five generations of two hundred from the first sequence that begins with M: how many, and how long, in each."""
    first = sequences(spark, sf_dir).where("seq like 'M%'").orderBy("id").head()
    found = stochastic.simulate(first.seq, 200, 5, 7, SUBSTITUTION, spark)
    return found.groupBy("generation").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.length("seq")), 3).alias("length"), F.count_distinct("parent").alias("parents"))


@query()
def sampled_records(spark, sf_dir):
    """A sample of 1000 rows, the same ones for one seed."""
    return stochastic.sampled(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), 1000, 3, "l_orderkey", "l_linenumber", "l_partkey")


@query()
def mc3_trace(spark, sf_dir):
    """Coupled chains over a paraboloid whose greatest value is 2 at the origin."""
    variables = [stochastic.Variable("x", -100, 100), stochastic.Variable("y", -100, 100)]
    trace, _, _ = stochastic.coupled_chains(variables, lambda b: [-6 * v["x"] ** 2 - 2 * v["y"] ** 2 + 2 for v in b], steps=1000, seed=4)
    return spark.createDataFrame(trace)


@query()
def mcl_grid(spark, sf_dir):
    """How many groups Markov clustering makes over a grid of settings, all in one plan."""
    grid = [tuple(r) for r in stochastic.parameter_grid(spark, inflation=(1.5, 4.0, 3), threshold=(0.6, 0.9, 3)).select("inflation", "threshold").orderBy("inflation", "threshold").collect()]
    found = markov_grid(graph(spark, sf_dir), grid).groupBy("k").agg(F.count_distinct("grp").alias("groups"), F.count(F.lit(1)).alias("members"))
    settings = spark.createDataFrame([(k, *x) for k, x in enumerate(grid)], "k int, inflation double, threshold double")
    return found.join(F.broadcast(settings), "k").select("inflation", "threshold", "groups", "members")


def _groups(spark, sf_dir):
    g = graph(spark, sf_dir)
    return g, components(g.where("score >= 0.7"))


@query()
def recursive_groups(spark, sf_dir):
    """Components of close pairs, each subdivided while a sampled clustering scores better; ``group_0`` is the largest one."""
    g, members = _groups(spark, sf_dir)
    sizes = members.groupBy("grp").agg(F.count(F.lit(1)).alias("size"))
    numbers = with_row_number(sizes, "n", F.desc("size"), "grp").select("grp", F.concat(F.lit("group_"), (F.col("n") - 1).cast("string")).alias("name"))
    start = members.join(numbers, "grp").select(F.col("name").alias("grp"), "member")
    return grouping.subdivided(g, start, [grouping.Setting(1.5, 0.6), grouping.Setting(3.0, 0.8)])


@query()
def ortholog_groups(spark, sf_dir):
    """Components of tied pairs, divided by coupled chains over Markov clustering, with their cliques."""
    from seqloom.operators.orthologs import orthogroups

    g = graph(spark, sf_dir).where("score >= 0.5")
    return orthogroups(g, components(g).select(F.concat(F.lit("group_"), "grp").alias("grp"), "member"), steps=20)


@query()
def significant_cliques(spark, sf_dir):
    g, members = _groups(spark, sf_dir)
    return grouping.significant_cliques(g, members)


@query()
def merge_small_groups(spark, sf_dir):
    g, members = _groups(spark, sf_dir)
    return grouping.merged_small(members, g, 4)


@query()
def scored_grouping(spark, sf_dir):
    """The summed score of a set of groups and their cliques."""
    g, members = _groups(spark, sf_dir)
    return grouping.scored_clustering(members, grouping.significant_cliques(g, members)).select(F.round("score", 4).alias("score"))


@query("SELECT DISTINCT split_part(id, '-', 1) AS taxon FROM fasta")
def taxa(spark, sf_dir):
    return table(spark, sf_dir, "fasta").select(taxon(F.col("id")).alias("taxon")).distinct()
