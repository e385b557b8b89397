"""Round trips: tables are written in a format and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.operators import alignment as al
from seqloom.operators import pssm as ps
from seqloom.plans.stages import Stages
from seqloom.queries.alignments import tmd_spans
from seqloom.queries.carriers import COLUMNS, GRAPH, MEMBERS, SEQUENCES, TOPOLOGY, alignment, columns, graph, members, sequences, topology
from seqloom.queries.profiles import _LOD, pssm_lod
from seqloom.queries.registry import query, table
from seqloom.sinks import writers as to
from seqloom.sources import readers as of


def _place(spark, name: str) -> str:
    """A folder of its own for one round trip, deleted when the session ends."""
    return f"{Stages(spark, 'formats').root}/{name}"


def _lines(df, spark, name: str, *cells) -> str:
    """Writes one text a row, of columns and plain texts; the folder."""
    where = _place(spark, name)
    df.select(F.concat(*[c if not isinstance(c, str) else F.lit(c) for c in cells]).alias("value")).write.text(where)
    return where


def _s(c: str):
    return F.col(c).cast("string")


def _records(spark, sf_dir):
    """``(id, description, seq)``: a description in one line."""
    d = F.trim(F.regexp_replace(F.coalesce("description", F.lit("")), r"\s+", " "))
    f = table(spark, sf_dir, "fasta").select("id", d.alias("description"), F.upper(F.regexp_replace(F.coalesce("seq", F.lit("")), "[^A-Za-z]", "")).alias("seq"))
    return f.groupBy("id", "seq").agg(F.min("description").alias("description")).select("id", "description", "seq")


_RECORDS = r"(SELECT id, min(trim(regexp_replace(coalesce(description, ''), '\s+', ' ', 'g'))) AS description, upper(regexp_replace(coalesce(seq, ''), '[^A-Za-z]', '', 'g')) AS seq FROM fasta GROUP BY 1, 3)"


@query(f"SELECT id, description, seq FROM {_RECORDS}")
def fasta_records(spark, sf_dir):
    to.fasta(_records(spark, sf_dir), where := _place(spark, "fasta"))
    return of.fasta(spark, where).select("id", "description", "seq")


@query(f"SELECT id, seq FROM {_RECORDS}")
def fasta_appended(spark, sf_dir):
    """Two writers add to one folder."""
    r, where = _records(spark, sf_dir), _place(spark, "fasta")
    to.fasta(r.where("description = ''"), where)
    to.fasta(r.where("description <> ''"), where, mode="append")
    return of.fasta(spark, where).select("id", "seq")


@query(f"SELECT id AS key, seq FROM {_RECORDS}")
def fasta_dict(spark, sf_dir):
    """Keyed by id; a repeated id would be an error."""
    to.fasta(_records(spark, sf_dir), where := _place(spark, "fasta"))
    return of.fasta_unique(spark, where).select("key", "seq")


@query(f"SELECT upper(id) AS key, length(seq) AS n FROM {_RECORDS}")
def fasta_dict_by_function(spark, sf_dir):
    to.fasta(_records(spark, sf_dir), where := _place(spark, "fasta"))
    return of.fasta_unique(spark, where, F.upper("id")).select("key", F.length("seq").cast("bigint").alias("n"))


@query(f"SELECT id, seq FROM {_RECORDS}")
def guessed_fasta(spark, sf_dir):
    to.fasta(_records(spark, sf_dir), where := _place(spark, "fasta"))
    return of.sequences(spark, where)


@query(f"SELECT CAST(ceil(count(*) / 1000) AS BIGINT) AS least_files, count(*) AS records, true AS within FROM {_RECORDS}")
def records_in_files(spark, sf_dir):
    """No file has more records than stated."""
    to.fasta(_records(spark, sf_dir), where := _place(spark, "fasta"), records_per_file=1000)
    per = of.fasta(spark, where).groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.ceil(F.sum("n") / 1000).alias("least_files"), F.sum("n").alias("records"), (F.max("n") <= 1000).alias("within"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS gi, concat('NP_', lpad(CAST(p_partkey AS VARCHAR), 6, '0')) AS accession, p_name AS description FROM part WHERE p_size <= 25")
def ncbi_records(spark, sf_dir):
    """Pipe-delimited headers, those with an accession of one kind."""
    p = table(spark, sf_dir, "part")
    acc = F.concat(F.when(F.col("p_size") <= 25, "NP_").otherwise("XP_"), F.lpad(_s("p_partkey"), 6, "0"))
    where = _lines(p, spark, "ncbi", ">gi|", _s("p_partkey"), "|ref|", acc, "| ", F.col("p_name"), "\nMKV")
    return of.ncbi_fasta(spark, where).select("gi", "accession", "description")


_ALIGNED = f"SELECT concat('r', id) AS id, string_agg(aa, '' ORDER BY pos) AS seq FROM {COLUMNS} GROUP BY 1"


def _aligned(spark, sf_dir):
    return alignment(spark, sf_dir).select(F.concat(F.lit("r"), _s("id")).alias("id"), "seq")


@query(_ALIGNED)
def phylip_alignment(spark, sf_dir):
    to.phylip(_aligned(spark, sf_dir), where := _place(spark, "phylip"))
    return of.sequences(spark, where)


@query(_ALIGNED)
def stockholm_alignment(spark, sf_dir):
    where = _lines(_aligned(spark, sf_dir), spark, "stockholm", F.col("id"), "  ", F.col("seq"))
    return of.alignment(spark, where, "stockholm").select("id", "seq")


@query(_ALIGNED)
def clustal_alignment(spark, sf_dir):
    """Rows in two blocks."""
    a = _aligned(spark, sf_dir)
    where = _lines(a, spark, "clustal", F.col("id"), "  ", F.left("seq", F.lit(40)), " 40\n\n", F.col("id"), "  ", F.substr("seq", F.lit(41)), " 64\n")
    return of.alignment(spark, where, "clustal").select("id", "seq")


@query(_ALIGNED)
def nexus_alignment(spark, sf_dir):
    """A file for each row's label, with its matrix."""
    a = alignment(spark, sf_dir).select("label", F.concat(F.lit("r"), _s("id"), F.lit("  "), F.col("seq")).alias("line"))
    files = a.groupBy("label").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("m"))
    where = _place(spark, "nexus")
    to.by_group(files, where, "label", F.concat(F.lit("#NEXUS\nbegin data;\nmatrix\n"), F.col("m"), F.lit("\n;\nend;")))
    return of.alignment(spark, f"{where}/label=*", "nexus").select("id", "seq")


@query(f"""WITH w AS (SELECT id, pos, symbol, pos - row_number() OVER (PARTITION BY id, symbol ORDER BY pos) AS island FROM {TOPOLOGY}), q AS (SELECT id, string_agg(replace(aa, '-', 'X'), '' ORDER BY pos) AS seq FROM {COLUMNS} GROUP BY 1),
f AS (SELECT id, concat('TMD', row_number() OVER (PARTITION BY id ORDER BY min(pos))) AS type, CAST(min(pos) AS INTEGER) AS "start", CAST(max(pos) + 1 AS INTEGER) AS "end" FROM w WHERE symbol = 'M' GROUP BY id, island)
SELECT concat('r', id) AS id, seq, type, "start", "end" FROM f JOIN q USING (id)""")
def genbank_features(spark, sf_dir):
    f = tmd_spans(spark, sf_dir).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("start", "end", F.col("name").alias("type")))).alias("features"))
    a = alignment(spark, sf_dir).join(f, "id").select(F.concat(F.lit("r"), _s("id")).alias("id"), F.lit("a record").alias("description"), F.replace("seq", F.lit("-"), F.lit("X")).alias("seq"), "features")
    to.genbank(a, where := _place(spark, "genbank"))
    return of.genbank(spark, where).select("id", "seq", F.inline("features")).select("id", "seq", "type", "start", "end")


@query(f"SELECT seq1, seq2, score FROM {GRAPH}")
def edges_with_header(spark, sf_dir):
    to.delimited(graph(spark, sf_dir), where := _place(spark, "edges"), ",")
    return of.edges(spark, where)


@query(f"SELECT seq1, seq2, score FROM {GRAPH}")
def edges_without_header(spark, sf_dir):
    to.delimited(graph(spark, sf_dir), where := _place(spark, "edges"), "\t", header=False)
    return of.edges(spark, where, header=False, separator="\t")


@query(f"SELECT seq1 AS a, seq2 AS b, round(score, 6) AS value FROM {GRAPH}")
def pair_lines(spark, sf_dir):
    """``a->b`` and a value, read as text."""
    to.pair_values(graph(spark, sf_dir).withColumn("score", F.round("score", 6)), where := _place(spark, "pairs"), "seq1", "seq2", "score")
    p = spark.read.text(where).select(F.split("value", "\t").alias("v"))
    return p.select(F.split(F.col("v")[0], "->")[0].alias("a"), F.split(F.col("v")[0], "->")[1].alias("b"), F.col("v")[1].cast("double").alias("value"))


@query("SELECT l_quantity AS support, l_returnflag AS grp, count(*) AS n FROM lineitem GROUP BY 1, 2")
def support_file(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_quantity", "l_returnflag")
    to.delimited(li, where := _place(spark, "support"), ",", header=False)
    return of.support_groups(spark, where).groupBy("support", "grp").agg(F.count(F.lit(1)).alias("n"))


_PSIPRED = """SELECT vec_id AS id, CAST(pos AS INTEGER) AS indx, aa, round(x, 3) + 0.0::DOUBLE AS coil_prob FROM (SELECT vec_id, pos, x, CASE WHEN x > 0 THEN 'H' ELSE 'C' END AS aa FROM
 (SELECT vec_id, generate_subscripts(embedding, 1) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings))"""


def _psipred(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.posexplode("embedding").alias("pos", "x"))
    return e.select("id", (F.col("pos") + 1).alias("indx"), F.when(F.col("x") > 0, "H").otherwise("C").alias("aa"), (F.round(F.col("x").cast("double"), 3) + F.lit(0.0)).alias("coil"))


@query(f"SELECT indx, aa, coil_prob, count(*) AS n FROM ({_PSIPRED}) GROUP BY 1, 2, 3")
def structure_file(spark, sf_dir):
    """Secondary-structure lines with comments between them."""
    where = _lines(_psipred(spark, sf_dir), spark, "ss2", "# a comment\n   ", _s("indx"), " ", F.col("aa"), " C   ", F.format_string("%.3f", "coil"), "  0.100  0.200")
    return of.profile(spark, where).groupBy("indx", "aa", "coil_prob").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_quantity AS c0, l_discount AS c2, count(*) AS n FROM lineitem GROUP BY 1, 2")
def number_columns(spark, sf_dir):
    """Two of three columns of numeric text."""
    where = _lines(table(spark, sf_dir, "lineitem"), spark, "numbers", _s("l_quantity"), "  ", _s("l_tax"), " ", _s("l_discount"))
    return of.numbers(spark, where, 0, 2).groupBy("c0", "c2").agg(F.count(F.lit(1)).alias("n"))


_GROUPS = f"(SELECT grp, list_sort(list(member)) AS members FROM {MEMBERS} GROUP BY 1)"


def _groups(spark, sf_dir):
    return members(spark, sf_dir).groupBy("grp").agg(F.array_sort(F.collect_list("member")).alias("members"))


@query(f"SELECT array_to_string(members, ' ') AS members, count(*) AS n FROM {_GROUPS} GROUP BY 1")
def cluster_file(spark, sf_dir):
    to.clusters(_groups(spark, sf_dir), where := _place(spark, "clusters"))
    return of.clusters(spark, where).groupBy(F.array_join("members", " ").alias("members")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT CAST(grp AS VARCHAR) AS name, len(members) / 2 AS score, array_to_string(members, ' ') AS members FROM {_GROUPS}")
def group_report_file(spark, sf_dir):
    g = _groups(spark, sf_dir).select(_s("grp").alias("name"), (F.size("members") / 2).alias("score"), "members")
    to.group_report(g, where := _place(spark, "report"))
    return of.group_report(spark, where).select("name", "score", F.array_join("members", " ").alias("members"))


@query(f"""WITH t AS (SELECT least(x, y) AS s, greatest(x, y) AS t, max(score) AS v FROM (SELECT split_part(seq1, '-', 1) AS x, split_part(seq2, '-', 1) AS y, score FROM {GRAPH}) WHERE x <> y GROUP BY 1, 2)
SELECT s AS "row", t AS "column", v AS value FROM t UNION ALL SELECT t, s, v FROM t UNION ALL SELECT DISTINCT unnest([s, t]) AS x, x, 1.0::DOUBLE FROM t""")
def matrix_file(spark, sf_dir):
    """The taxa's matrix as labelled text."""
    from seqloom.queries.graph import pivot_matrix

    m = pivot_matrix(spark, sf_dir)
    others = [c for c in m.columns if c != "id"]
    cells = F.concat_ws(",", "id", *[F.coalesce(_s(f"`{c}`"), F.lit("")) for c in others])
    head = spark.createDataFrame([(0, "," + ",".join(others))], "o int, value string")
    where = _place(spark, "matrix")
    to._one_file(head.unionByName(m.select(F.lit(1).alias("o"), cells.alias("value"))), where, "error", "o")
    return of.matrix(spark, where)


@query("SELECT p_name AS label, CAST(p_size AS DOUBLE) AS length, CASE WHEN p_partkey > 0 THEN p_partkey // 2 END AS parent FROM part")
def newick_round_trip(spark, sf_dir):
    """A tree of all parts as one text, read again: labels hold the numbers."""
    from seqloom.operators.trees import newick
    from seqloom.queries.trees import tree

    t = tree(spark, sf_dir).select(F.lit(1).alias("tree"), "node", "parent", F.concat(F.lit("'"), _s("node"), F.lit(" "), "label", F.lit("'")).alias("label"), F.col("length").cast("double").alias("length"))
    where = _place(spark, "newick")
    newick(t, "tree", "node", "parent", "label", "length").select(F.col("newick").alias("value")).write.text(where)
    n = of.newick(spark, where)
    own = F.substring_index("label", " ", 1).cast("bigint")
    up = n.select(F.col("node").alias("parent"), own.alias("number"))
    return n.join(up, "parent", "left").select(F.expr("substr(label, instr(label, ' ') + 1)").alias("label"), "length", F.col("number").alias("parent"))


@query("SELECT CAST(o_orderkey AS INTEGER) AS inference, -o_totalprice AS likelihood, concat('tree', o_custkey) AS file FROM orders")
def inference_log(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    where = _lines(o, spark, "log", "starting\nInference[", _s("o_orderkey"), "] final GAMMA-based Likelihood: -", _s("o_totalprice"), " tree written to file ", F.concat(F.lit("tree"), _s("o_custkey")))
    return of.inference_log(spark, where)


@query(f"SELECT indx AS n, coil_prob AS m1, count(*) AS rows FROM ({_PSIPRED}) GROUP BY 1, 2")
def aligned_profile_file(spark, sf_dir):
    """Paired profiles, a file for each pair; gaps are ``?0``, and the last line is no row."""
    p = _psipred(spark, sf_dir).withColumn("line", F.concat(_s("indx"), F.lit("  "), F.format_string("%.3f", "coil"), F.lit(" 1 0 0 ?0 ?0 ?0 ?0")))
    files = p.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("indx", "line"))), lambda x: x["line"]), "\n").alias("m"))
    where = _place(spark, "profiles")
    to.by_group(files, where, "id", F.concat("m", F.lit("\nlast line")))
    return of.aligned_profile(spark, f"{where}/id=*").where("m2 is null").groupBy(F.col("n").cast("int").alias("n"), "m1").agg(F.count(F.lit(1)).alias("rows"))


@query(f"SELECT label, count(*) AS n FROM (SELECT DISTINCT label, id FROM {COLUMNS}) GROUP BY 1")
def truncated_profile_file(spark, sf_dir):
    """Files with lines before and behind a mark: the lines before it are counted."""
    a = alignment(spark, sf_dir).groupBy("label").agg(F.array_join(F.collect_list(_s("id")), "\n").alias("m"))
    where = _place(spark, "truncated")
    to.by_group(a, where, "label", F.concat("m", F.lit("\nEND\nmore\nEND")))
    t = of.truncated_profile(spark, f"{where}/label=*")
    return t.select(F.regexp_extract("path", "label=([0-9]+)", 1).cast(alignment(spark, sf_dir).schema["label"].dataType).alias("label"), F.size(F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")).cast("bigint").alias("n"))


@query(f"SELECT concat('r', id) AS id, string_agg(symbol, '' ORDER BY pos) AS topology FROM {TOPOLOGY} GROUP BY 1")
def topology_file(spark, sf_dir):
    t = _topologies(spark, sf_dir)
    to.fasta(t.select("id", F.col("topology").alias("seq")), where := _place(spark, "topology"), description=None, width=20)
    return of.topology(spark, where).select("id", "topology")


def _topologies(spark, sf_dir):
    t = topology(spark, sf_dir).groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "symbol"))), lambda x: x["symbol"]), "").alias("topology"))
    return t.select(F.concat(F.lit("r"), _s("id")).alias("id"), "topology")


@query(f"WITH {_LOD} SELECT CAST(pos AS INTEGER) AS pos, aa, round(score, 1) + 0.0::DOUBLE AS score FROM lod WHERE aa NOT IN ('X', '-')")
def pssm_file(spark, sf_dir):
    """The profile with two decimals, compared to one."""
    to.pssm(pssm_lod(spark, sf_dir).withColumn("score", F.round("score", 1) + F.lit(0.0)), where := _place(spark, "pssm"))
    order = "ARNDCQEGHILKMFPSTWYV"
    p = of.pssm_lines(spark, where).select(F.col("scores")[0].cast("int").alias("pos"), F.posexplode(F.slice("scores", F.lit(2), F.lit(20))).alias("i", "score"))
    return p.select("pos", F.substr(F.lit(order), F.col("i") + 1, F.lit(1)).alias("aa"), "score")


_HITS = """SELECT CAST(l_orderkey AS VARCHAR) AS qacc, CAST(l_partkey AS VARCHAR) AS sacc, l_quantity AS pident, CAST(l_linenumber AS INTEGER) AS length, l_tax AS evalue, l_extendedprice AS bitscore FROM lineitem"""


@query(_HITS)
def hits_table(spark, sf_dir):
    """Fifteen columns by tabs, with comment lines."""
    li, zero = table(spark, sf_dir, "lineitem"), F.lit("\t0" * 6)
    where = _lines(li, spark, "hits", "# search\n", F.concat_ws("\t", "l_orderkey", "l_partkey", "l_quantity", "l_linenumber"), zero, "\t", _s("l_tax"), "\t", _s("l_extendedprice"), "\t1\t1\t1")
    return of.hits(spark, where).select("qacc", "sacc", "pident", "length", "evalue", "bitscore")


@query("SELECT o_custkey AS query, o_orderkey AS subject, o_totalprice AS bits FROM (SELECT CAST(o_custkey AS VARCHAR) AS o_custkey, CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_totalprice FROM orders)")
def hits_xml_file(spark, sf_dir):
    """A report in XML, of every hit its first alignment; its files are zipped, as a hit is much longer than its row."""
    h = lambda c: c.cast("string")
    hsp = lambda bits: F.format_string("<Hsp><Hsp_bit-score>%s</Hsp_bit-score><Hsp_evalue>0.1</Hsp_evalue><Hsp_identity>3</Hsp_identity><Hsp_align-len>9</Hsp_align-len></Hsp>", h(bits))
    other = "<Hsp><Hsp_bit-score>0</Hsp_bit-score><Hsp_evalue>9</Hsp_evalue><Hsp_identity>0</Hsp_identity><Hsp_align-len>1</Hsp_align-len></Hsp>"
    hit = lambda o: F.concat(F.lit("<Hit><Hit_id>x</Hit_id><Hit_def>"), h(o["o_orderkey"]), F.lit("</Hit_def><Hit_hsps>"), hsp(o["o_totalprice"]), F.lit(other + "</Hit_hsps></Hit>"))
    per = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list(F.struct("o_orderkey", "o_totalprice")).alias("o"))
    hits = F.array_join(F.transform("o", hit), "\n")
    one = F.concat(F.lit("<Iteration>\n<Iteration_query-def>"), _s("o_custkey"), F.lit("</Iteration_query-def>\n<Iteration_hits>\n"), hits, F.lit("\n</Iteration_hits>\n</Iteration>"))
    where = _place(spark, "xml")
    to.by_group_in_order(per.withColumn("file", F.col("o_custkey") % 16), where, "file", one, "<Output>", "</Output>", compression="gzip")
    return of.hits_xml(spark, f"{where}/file=*").select("query", "subject", "bits")


@query("SELECT concat('s', s_suppkey) AS id, symbol, CAST(s AS INTEGER) AS \"start\", CAST(e AS INTEGER) AS \"end\" FROM (SELECT s_suppkey, unnest(['i', 'M', 'o']) AS symbol, unnest([0, 9 + s_nationkey, 30 + s_nationkey]) AS s, unnest([9 + s_nationkey, 30 + s_nationkey, 100]) AS e FROM supplier)")
def tmhmm_report(spark, sf_dir):
    """One span in each sequence of 100 residues."""
    s = table(spark, sf_dir, "supplier")
    where = _lines(s, spark, "tmhmm", "s", _s("s_suppkey"), "\tlen=100\tExpAA=20\tFirst60=9\tPredHel=1\tTopology=i", (F.col("s_nationkey") + 10).cast("string"), "-", (F.col("s_nationkey") + 30).cast("string"), "o")
    return of.tmhmm(spark, where).select("id", F.inline("segments")).select("id", "symbol", "start", "end")


@query("SELECT concat('s', s_suppkey) AS id, concat('PS', lpad(CAST(s_nationkey AS VARCHAR), 5, '0')) AS motif, CAST(s_nationkey AS INTEGER) AS \"start\", CAST(s_nationkey + 5 AS INTEGER) AS \"end\" FROM supplier")
def motif_report(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    where = _lines(s, spark, "motifs", ">s", _s("s_suppkey"), " : PS", F.lpad(_s("s_nationkey"), 5, "0"), " a motif\n    ", (F.col("s_nationkey") + 1).cast("string"), " - ", (F.col("s_nationkey") + 5).cast("string"), "  AAAAA")
    return of.motifs(spark, where)


@query(f"SELECT concat('r', id) AS id, m.method, CASE WHEN m.method = 'ONE' THEN topology ELSE reverse(topology) END AS topology FROM (SELECT id, string_agg(symbol, '' ORDER BY pos) AS topology FROM {TOPOLOGY} GROUP BY 1), (VALUES ('ONE'), ('TWO')) m(method)")
def zipped_topology_report(spark, sf_dir):
    """Reports of two predictors, put into a zip archive and read from there."""
    t = _topologies(spark, sf_dir)
    where = _lines(t, spark, "topcons", "Sequence name: ", F.col("id"), "\n\nONE predicted topology:\n", F.col("topology"), "\n\nTWO predicted topology:\n", F.reverse("topology"), "\n")
    to.zip_files(spark, where, r"^part-.*\.txt$", f"{where}-zip/report.zip")
    return of.topology_report(spark, f"{where}-zip/report.zip", zipped=True)


@query("SELECT n_name AS species, concat('s', s_suppkey) AS id FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def name_map_file(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    per = s.groupBy("n_name").agg(F.array_join(F.collect_list(F.concat(F.lit("x\ts"), _s("s_suppkey"))), "\n").alias("l"))
    where = _lines(per, spark, "names", "abc - ", F.col("n_name"), "\n", F.col("l"), "\n")
    return of.name_map(spark, where)


@query("SELECT CAST(o_custkey AS VARCHAR) AS file, CAST(o_orderkey AS VARCHAR) AS name, CAST(o_orderkey % 50 AS INTEGER) AS \"start\", CAST(o_orderkey % 50 + 9 AS INTEGER) AS \"end\" FROM orders")
def block_sets(spark, sf_dir):
    """Sets of data blocks, a set for each customer."""
    line = F.concat_ws(",", _s("o_orderkey"), (F.col("o_orderkey") % 50).cast("string"), (F.col("o_orderkey") % 50 + 9).cast("string"))
    per = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.collect_list(line), "  # a note\n").alias("l"))
    where = _lines(per, spark, "blocks", _s("o_custkey"), "\n", F.col("l"), "\n//")
    return of.blocks(spark, where).select("file", "name", "start", "end")


@query("SELECT DISTINCT trim(hash) AS hash, trim(name) AS name FROM id_map")
def id_dictionary_file(spark, sf_dir):
    d = table(spark, sf_dir, "id_map").select(F.trim("hash").alias("hash"), F.trim("name").alias("name")).distinct()
    to.delimited(d, where := _place(spark, "ids"), ",", header=False)
    return of.id_dictionary(spark, where)


@query("SELECT concat('o', l_orderkey) AS id, array_to_string(list(CAST(l_partkey AS INTEGER) ORDER BY l_partkey), ' ') AS positions FROM lineitem GROUP BY 1")
def provenance_file(spark, sf_dir):
    per = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list("l_partkey")), ", ").alias("l"))
    where = _lines(per, spark, "provenance", "o", _s("l_orderkey"), "\n", F.col("l"))
    return of.provenance(spark, where).select("id", F.array_join("positions", " ").alias("positions"))


_MINUTES = "strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M')"


@query(f"SELECT CAST(user_id AS INTEGER) AS pid, {_MINUTES} AS minute, event_type AS command, strftime(ts, '%Y%m') AS month, count(*) AS n FROM events GROUP BY ALL")
def history_files(spark, sf_dir):
    """Entries as lines of a shell history, read again."""
    where = _lines(table(spark, sf_dir, "events"), spark, "history", ":", _s("user_id"), " ", F.date_format("ts", "MMM/dd/yy HH:mm"), "; ", F.col("event_type"))
    h = of.history_lines(spark.read.text(where), F.lit(""))
    return h.groupBy("pid", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("minute"), "command", "month").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(strftime(ts, '%Y%m') AS INTEGER) AS month, count(*) AS n FROM events GROUP BY 1")
def monthly_log(spark, sf_dir):
    """A log kept by month, appended to twice."""
    e, where = table(spark, sf_dir, "events").withColumn("month", F.date_format("ts", "yyyyMM")), _place(spark, "months")
    to.monthly(e.where("value is null"), where)
    to.monthly(e.where("value is not null"), where)
    return spark.read.parquet(where).groupBy("month").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id FROM events WHERE event_id <> (SELECT event_id FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id LIMIT 1 OFFSET 2)")
def log_without_third(spark, sf_dir):
    """The log without the third newest entry of one kind."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    return to.without_nth(e, 3, F.col("event_type") == "click", F.desc("ts"), F.col("event_id")).select("event_id")


@query("SELECT n_name AS name, CAST(n_nationkey AS VARCHAR) AS key FROM nation")
def html_table(spark, sf_dir):
    """A page with a table; entities are resolved."""
    where = _lines(table(spark, sf_dir, "nation"), spark, "pages", "<table><tr class='x'><td><b>", F.col("n_name"), "</b></td>\n<td>&lt;", _s("n_nationkey"), "&gt;</td></tr></table>")
    h = of.html_rows(spark, where)
    return h.select(F.col("cells")[0].alias("name"), F.regexp_replace(F.col("cells")[1], "[<>]", "").alias("key"))


@query("SELECT DISTINCT label FROM embeddings")
def files_of_groups(spark, sf_dir):
    """One folder for each label, found by a scan of the folders."""
    a = alignment(spark, sf_dir)
    where = _place(spark, "groups")
    to.by_group(a, where, "label", F.col("seq"))
    f = of.files(spark, where, r"\.txt$", depth=2)
    return f.select(F.regexp_extract("path", "label=([0-9]+)", 1).cast(a.schema["label"].dataType).alias("label")).distinct()


@query(f"SELECT concat('>', id, chr(10), seq) AS value FROM (SELECT id, replace(seq, 'X', '') AS seq FROM {SEQUENCES} WHERE replace(seq, 'X', '') <> '')")
def repaired_alignments(spark, sf_dir):
    """Broken alignment output, a record a text: marks at line starts, no empty lines."""
    s = sequences(spark, sf_dir).select("id", F.replace("seq", F.lit("X"), F.lit("")).alias("seq")).where("seq <> ''")
    return s.select(to.repaired_alignment(F.concat(F.lit("  > "), "id", F.lit("\n \n\n"), "seq")).alias("value"))


@query("SELECT CAST(o_orderkey AS INTEGER) AS gen, o_totalprice AS x, CAST(o_custkey AS DOUBLE) AS result FROM orders")
def trace_file(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("gen"), F.col("o_totalprice").alias("x"), F.col("o_custkey").alias("result"))
    to.delimited(o, where := _place(spark, "trace"))
    return of.trace(spark, where, ["x"])


@query(f"SELECT aa, o AS other, i * k / 1000 AS cumulative FROM (SELECT aa, unnest(string_split('ARNDCQEGHILKMFPSTWYV*', '')) AS o, unnest(range(1, 22)) AS i, n % 7 AS k FROM (SELECT aa, count(*) AS n FROM {COLUMNS} WHERE aa <> '-' GROUP BY 1))")
def probability_file(spark, sf_dir):
    """A line of cumulative numbers for every residue."""
    c = columns(spark, sf_dir).where("aa <> '-'").groupBy("aa").agg((F.count(F.lit(1)) % 7).alias("k"))
    where = _lines(c, spark, "probabilities", F.col("aa"), "\t", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(21)), lambda i: (i * F.col("k") / 1000).cast("string")), "\t"))
    return of.probability_matrix(spark, where)


@query("SELECT CAST(p_size AS DOUBLE) AS support, count(*) AS n FROM part GROUP BY 1")
def support_of_trees(spark, sf_dir):
    where = _lines(table(spark, sf_dir, "part"), spark, "support", "(a:1,(b:1,c:2)", _s("p_size"), ":0.5);")
    return of.support_values(spark, where).groupBy("support").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT concat('#!/bin/sh', chr(10), 'run ', p_name, ' --size=', p_size) AS value FROM part")
def job_scripts(spark, sf_dir):
    return to.from_template(table(spark, sf_dir, "part"), "#!/bin/sh\nrun {p_name} --size={p_size}")


@query("SELECT concat('WEIGHT: ', p_size, ' TYPE: UniversalProfileSimilarity COLUMN: ', p_partkey, ' HEADERLINES: 3 PROFILE1: ', p_brand, ' PROFILE2: ', p_name) AS value FROM part")
def similarity_definitions(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return to.similarity_definitions(p.select(F.col("p_size").alias("weight"), F.col("p_partkey").alias("column"), F.col("p_brand").alias("profile1"), F.col("p_name").alias("profile2")))


@query("SELECT concat(p_name, '_pos', k + 1) AS name, CAST(p_size + k AS INTEGER) AS \"start\", CAST(p_size + 60 AS INTEGER) AS \"end\", CAST(3 AS INTEGER) AS step FROM part, (VALUES (0), (1), (2)) v(k)")
def codon_position_blocks(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_size").cast("int").alias("start"), (F.col("p_size") + 60).cast("int").alias("end"))
    return to.codon_positions(p)


@query(f"""WITH {_LOD}, v AS (SELECT x.pos AS p1, y.pos AS p2, sum(x.score * y.score) AS v FROM lod x JOIN lod y USING (aa) GROUP BY 1, 2),
win AS (SELECT p1 AS start1, p2 AS start2, sum(v) OVER d AS s, count(*) OVER d AS n FROM v WINDOW d AS (PARTITION BY p2 - p1 ORDER BY p1 ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING))
SELECT start1, max(start2) FILTER (WHERE r = 1) AS first, max(start2) FILTER (WHERE r = 2) AS second FROM (SELECT start1, start2, row_number() OVER (PARTITION BY start1 ORDER BY round(s, 5) DESC, start2) AS r FROM win WHERE n = 5) GROUP BY 1""")
def best_windows(spark, sf_dir):
    """The two best partners of every window, side by side."""
    lod = pssm_lod(spark, sf_dir)
    w = ps.window_products(lod, lod).withColumn("score", F.round("score", 5))
    return to.top_per_start(w, 2).select("start1", F.col("1_at").alias("first"), F.col("2_at").alias("second"))


@query("""SELECT o_orderkey AS pair, CAST(i AS INTEGER) AS i, round(o_totalprice - x, 4) AS difference FROM (SELECT o_orderkey, o_totalprice, unnest([o_totalprice / 2, o_totalprice / 4]) AS x, unnest([0, 1]) AS i FROM orders)""")
def null_differences(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pair"), F.col("o_totalprice").alias("observed"), F.array(F.col("o_totalprice") / 2, F.col("o_totalprice") / 4).alias("shuffled"))
    return to.null_rows(o)[1].select("pair", "i", F.round("difference", 4).alias("difference"))


@query(f"""SELECT CAST(count(DISTINCT grp) AS BIGINT) + 1 AS inner_nodes, count(*) AS leaves FROM {MEMBERS}""")
def group_polytomies(spark, sf_dir):
    """Groups as a tree text, read again: a node for every group, a leaf for every member."""
    from seqloom.operators.trees import newick

    g = _groups(spark, sf_dir).select(F.concat(F.lit("group_0_"), _s("grp")).alias("name"), "members")
    root = spark.createDataFrame([("group_0", [])], "name string, members array<string>")
    nodes = to.polytomies(root.unionByName(g)).withColumn("node", F.when(F.col("label") != "", F.concat("parent", F.lit("/"), "node")).otherwise(F.col("node")))
    texts = newick(nodes, "tree", "node", "parent", "label", "length")
    taxa = members(spark, sf_dir).select(F.lit(1).alias("tree"), F.col("member").alias("taxon"), F.lit(None).cast("string").alias("colour")).distinct()
    where = _place(spark, "nexus")
    to.nexus_text(texts, taxa).select("value").write.text(where)
    t = of.whole_text(spark, where).select("path", F.lit(0).alias("tree"), F.regexp_extract("value", r"tree tree_1 = \[&R\] ([^;]*);", 1).alias("value"))
    n = of.newick_nodes(t)
    return n.agg(F.count(F.when(F.col("label") == "", 1)).alias("inner_nodes"), F.count(F.when(F.col("label") != "", 1)).alias("leaves"))
