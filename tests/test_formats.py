import pytest
from pyspark.sql import functions as F

from seqloom import sinks, sources
from seqloom.streaming import history_stream, hourly_counts, newest_commands, refresh_pairs


def put(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text, encoding="utf-8")
    return str(p)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_fasta(spark, tmp_path):
    path = put(tmp_path, "a.fa", ">a-1 first one\nACD\nEF\n\n>b-2 x->y\nGH*I\n>c\n")
    got = rows(sources.fasta(spark, path).select("id", "description", "seq"))
    assert got == [("a-1", "first one", "ACDEF"), ("b-2", "x->y", "GH*I"), ("c", "", "")]
    out = str(tmp_path / "out")
    sinks.fasta(sources.fasta(spark, path), out, width=2)
    assert rows(sources.fasta(spark, out).select("id", "description", "seq")) == got
    sinks.fasta(sources.fasta(spark, path), out, mode="append")
    assert sources.fasta(spark, out).count() == 6
    with pytest.raises(Exception, match="repeated id"):
        sources.fasta_unique(spark, out).collect()
    assert sources.fasta_unique(spark, path).count() == 3


def test_ncbi_headers(spark, tmp_path):
    path = put(tmp_path, "n.fa", ">gi|12|ref|NP_001.1| protein x\nMA\n>gi|13|ref|XP_002.1| y\nMC\n")
    assert rows(sources.ncbi_fasta(spark, path)) == [("12", "ref", "NP_001.1", "protein x", "MA")]


@pytest.mark.parametrize(
    "format,text",
    [
        ("fasta", ">a\nAC-\n>b\nACD\n"),
        ("clustal", "CLUSTAL W\n\na   AC\nb   AC\n    **\n\na   - 3\nb   D 3\n"),
        ("stockholm", "# STOCKHOLM 1.0\n#=GF X\na  AC-\nb  ACD\n//\n"),
        ("phylip", " 2 3\na  AC-\nb  ACD\n"),
        ("nexus", "#NEXUS\nbegin data;\nmatrix\na AC-\nb ACD\n;\nend;\n"),
    ],
)
def test_alignments(spark, tmp_path, format, text):
    assert rows(sources.alignment(spark, put(tmp_path, "x.aln", text), format).select("id", "seq")) == [("a", "AC-"), ("b", "ACD")]


def test_ragged_alignment_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="different length"):
        sources.alignment(spark, put(tmp_path, "r.fa", ">a\nAC\n>b\nA\n")).collect()


def test_phylip_and_genbank_round_trip(spark, tmp_path):
    a = spark.createDataFrame([("long-id", "AC-"), ("b", "ACD")], "id string, seq string")
    sinks.phylip(a, str(tmp_path / "phy"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "phy").glob("part*")))
    assert text == " 2 3\nb        ACD\nlong-id  AC-\n"
    g = spark.createDataFrame([("g1", "some thing", "ACDEF" * 30, [("TMD1", 2, 9)])], "id string, description string, seq string, features array<struct<type string, start int, end int>>")
    sinks.genbank(g, str(tmp_path / "gb"))
    r = sources.genbank(spark, str(tmp_path / "gb")).head()
    assert (r.id, r.seq, [tuple(f) for f in r.features]) == ("g1", "ACDEF" * 30, [("TMD1", 2, 9)]) and r.description == "some thing"


def test_clusters_and_reports(spark, tmp_path):
    path = put(tmp_path, "g.txt", "a-1\tb-1\nc-1\n\n")
    assert rows(sources.clusters(spark, path).select("grp", "members")) == [(0, ["a-1", "b-1"]), (1, ["c-1"])]
    g = spark.createDataFrame([("0_1", 2.5, ["x"]), ("group_0_2", 1.0, ["y", "z"])], "name string, score double, members array<string>")
    sinks.group_report(g, str(tmp_path / "rep"))
    assert rows(sources.group_report(spark, str(tmp_path / "rep"))) == [("0_1", 2.5, ["x"]), ("0_2", 1.0, ["y", "z"])]
    sinks.clusters(g, str(tmp_path / "cl"))
    assert sources.clusters(spark, str(tmp_path / "cl")).count() == 2


def test_tables(spark, tmp_path):
    assert rows(sources.edges(spark, put(tmp_path, "e.csv", "seq1,seq2,score\na,b,0.5\n"))) == [("a", "b", 0.5)]
    assert rows(sources.edges(spark, put(tmp_path, "e.tsv", "a\tb\t0.5\n"), False, "\t")) == [("a", "b", 0.5)]
    assert rows(sources.support_groups(spark, put(tmp_path, "s.csv", "0.44,0_1\n0.45,0_2"))) == [(0.44, "0_1"), (0.45, "0_2")]
    assert rows(sources.id_dictionary(spark, put(tmp_path, "i.csv", "h1,a-1\n"))) == [("h1", "a-1")]
    h = sources.hits(spark, put(tmp_path, "h.tsv", "# c\n" + "\t".join(["q", "s", "99.5", "100", "1", "0", "1", "100", "1", "100", "0.0", "200", "100", "100", "99"]) + "\n")).head()
    assert (h.qacc, h.pident, h.nident) == ("q", 99.5, 99)
    m = rows(sources.matrix(spark, put(tmp_path, "m.csv", ",a,b\na,,0.5\nb,0.5,\n")))
    assert m == [("a", "b", 0.5), ("b", "a", 0.5)]
    p = rows(sources.profile(spark, put(tmp_path, "x.ss2", "# PSIPRED\n\n   1 M C   0.9  0.05  0.05\n")).select("indx", "aa", "coil_prob"))
    assert p == [(1, "M", 0.9)]
    assert rows(sources.numbers(spark, put(tmp_path, "n.txt", "# x\n1 2 3\n4 5 6\n"), 0, 2)) == [(1.0, 3.0), (4.0, 6.0)]
    assert sources.probability_matrix(spark, put(tmp_path, "pm", "A\t0.5\t1.0\nR\t0.2\t0.9\n"), "AR").count() == 4
    t = spark.createDataFrame([(1, 0.5, 2.0)], "gen int, x double, result double")
    sinks.delimited(t, str(tmp_path / "trace"))
    assert rows(sources.trace(spark, str(tmp_path / "trace"), ["x"])) == [(1, 0.5, 2.0)]


def test_xml_hits(spark, tmp_path):
    xml = (
        "<B><Iteration><Iteration_query-def>q1</Iteration_query-def><Iteration_hits><Hit><Hit_id>i</Hit_id><Hit_def>s1</Hit_def><Hit_hsps>"
        "<Hsp><Hsp_bit-score>50.5</Hsp_bit-score><Hsp_evalue>1e-5</Hsp_evalue><Hsp_identity>9</Hsp_identity><Hsp_align-len>10</Hsp_align-len></Hsp>"
        "<Hsp><Hsp_bit-score>1</Hsp_bit-score><Hsp_evalue>1</Hsp_evalue><Hsp_identity>1</Hsp_identity><Hsp_align-len>2</Hsp_align-len></Hsp>"
        "</Hit_hsps></Hit></Iteration_hits></Iteration></B>"
    )
    assert rows(sources.hits_xml(spark, put(tmp_path, "h.xml", xml))) == [("q1", "s1", 9, 10, 1e-5, 50.5)]


def test_long_xml_reports_are_split(spark, tmp_path):
    """A report of many queries is read in several tasks, each record whole, with entities; its writer makes a row a record."""
    hit = "<Hit><Hit_def>s &amp; {0}</Hit_def><Hit_hsps><Hsp><Hsp_bit-score>{0}.5</Hsp_bit-score><Hsp_evalue>0.1</Hsp_evalue><Hsp_identity>3</Hsp_identity><Hsp_align-len>9</Hsp_align-len></Hsp></Hit_hsps></Hit>"
    body = F.concat(F.lit("<Iteration>\n<Iteration_query-def>q"), F.col("id").cast("string"), F.lit("</Iteration_query-def>\n<Iteration_hits>\n" + "\n".join(hit.format(k) for k in range(40)) + "\n</Iteration_hits>\n</Iteration>"))
    sinks.by_group_in_order(spark.range(300).withColumn("file", F.lit(1)), where := f"{tmp_path}/xml", "file", body, "<Output>", "</Output>")
    text = "".join(p.read_text() for p in (tmp_path / "xml").glob("file=1/*.txt"))
    assert text.startswith("<Output>\n<Iteration>") and text.endswith("</Iteration>\n</Output>\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        got = sources.hits_xml(spark, f"{where}/file=*")
        assert got.rdd.getNumPartitions() > 4
        assert rows(got.select("query", "subject", "bits")) == sorted((f"q{i}", f"s & {k}", k + 0.5) for i in range(300) for k in range(40))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_newick(spark, tmp_path):
    n = sources.newick(spark, put(tmp_path, "t.nwk", "((a:1,b:2)x:0.5,'c d':3);\n(p,q);\n"))
    got = {(r.tree, r.label): (r.length, r.parent) for r in n.collect() if r.label}
    assert got[0, "c d"] == (3.0, 0) and got[0, "x"][0] == 0.5 and got[1, "p"] == (None, 0)
    assert n.where("tree = 0").orderBy("post_order").collect()[-1].parent is None
    from seqloom.operators.trees import newick

    assert newick(n.where("tree = 0"), "tree", "node", "parent", "label", "length").head().newick == "(c d:3,(a:1,b:2)x:0.5);"


def test_reports(spark, tmp_path):
    t = sources.tmhmm(spark, put(tmp_path, "tm", "p1\tlen=677\tExpAA=1\tFirst60=1\tPredHel=4\tTopology=o48-70i124-146o227-249i294-316o\n")).head()
    assert (t.id, t.len, t.helices, len(t.segments)) == ("p1", 677, 4, 9)
    assert tuple(t.segments[0]) == ("o", 0, 47) and tuple(t.segments[7]) == ("M", 293, 316) and tuple(t.segments[8]) == ("o", 316, 677)
    assert rows(sources.motifs(spark, put(tmp_path, "ps", ">s1 : PS00001 X\n   12 - 15  NASA\n   20 - 23  NASB\n"))) == [("s1", "PS00001", 11, 15), ("s1", "PS00001", 19, 23)]
    assert rows(sources.inference_log(spark, put(tmp_path, "log", "x\nInference[3] final GAMMA-based Likelihood: -12.5 tree written to file /a/b\n")).select("inference", "likelihood")) == [(3, -12.5)]
    assert rows(sources.support_values(spark, put(tmp_path, "sv", "((a,b)90:1,c)80:2;")).select("support")) == [(80.0,), (90.0,)]
    assert rows(sources.support_values(spark, put(tmp_path, "sw", "x[bootstrap=70]")).select("support")) == [(70.0,)]
    assert rows(sources.truncated_profile(spark, put(tmp_path, "np", "1 2\nEND\n3\nEND")).select("value")) == [("1 2\n",)]
    assert rows(sources.name_map(spark, put(tmp_path, "nm", "Sponge - Oscarella\nx\tid1\ny\tid2\n\nJelly - Mnemiopsis\nz\tid3\n"))) == [("Mnemiopsis", "id3"), ("Oscarella", "id1"), ("Oscarella", "id2")]
    b = rows(sources.blocks(spark, put(tmp_path, "bl", "f1.phy # c\nx,1,10\ny,11,20\n//\nf2.phy\nN-term,1,174\n")).select("set", "file", "name", "start", "end"))
    assert b == [(0, "f1.phy", "x", 1, 10), (0, "f1.phy", "y", 11, 20), (1, "f2.phy", "N-term", 1, 174)]
    assert rows(sources.provenance(spark, put(tmp_path, "pv", "id1\n1,2,3,\nid2\n4,\n")).select("id", "positions")) == [("id1", [1, 2, 3]), ("id2", [4])]
    a = sources.aligned_profile(spark, put(tmp_path, "prf", "# h\n1 0.1 0.2 0.3 0.4 ?0 ?0 ?0 ?0\n2 1 1 1 1 0 0 0 0\nlast\n")).orderBy("n").collect()
    assert len(a) == 2 and a[0].m1 == 0.1 and a[0].m2 is None and a[1].s2 == 0
    assert rows(sources.html_rows(spark, put(tmp_path, "h.html", "<table><tr><td>a &amp; b</td><th><b>c</b></th></tr></table>")).select("cells")) == [(["a & b", "c"],)]
    assert rows(sources.pssm_lines(spark, put(tmp_path, "pl", "A R\n 1.0 -2\n 3 4\n")).select("pos", "scores")) == [(0, [1.0, -2.0]), (1, [3.0, 4.0])]
    r = rows(sources.topology_report(spark, put(tmp_path, "tr", "Sequence name: s1\nTOPCONS predicted topology:\niiMMoo\nSCAMPI predicted topology:\nooMMii\n")))
    assert r == [("s1", "SCAMPI", "ooMMii"), ("s1", "TOPCONS", "iiMMoo")]
    assert rows(sources.topology(spark, put(tmp_path, "tp", ">s\nooM\nMii\n")).select("id", "topology")) == [("s", "ooMMii")]


def test_files_and_whole_text(spark, tmp_path):
    (tmp_path / "d" / "e").mkdir(parents=True)
    (tmp_path / "d" / "x.fa").write_bytes(b"a\rb\xff")
    (tmp_path / "d" / "e" / "y.txt").write_text("y")
    (tmp_path / "d" / ".z").write_text("z")
    assert [r.name for r in sources.files(spark, str(tmp_path / "d")).orderBy("name").collect()] == ["x.fa", "y.txt"]
    assert [r.name for r in sources.files(spark, str(tmp_path / "d"), depth=1).collect()] == ["x.fa"]
    assert [r.name for r in sources.files(spark, str(tmp_path / "d"), pattern="txt$").collect()] == ["y.txt"]
    assert sources.whole_text(spark, str(tmp_path / "d" / "x.fa")).head().value == "a\nb�"


def test_history_and_streams(spark, tmp_path):
    (tmp_path / "h").mkdir()
    put(tmp_path / "h", "bash_history-202401", ":12 Jan/05/24 10:15; ls -la\n:12 Jan/05/24 10:16; ls -la\nnoise\n")
    put(tmp_path / "h", "bash_history-202402", ":13 Feb/05/24 11:15; make\n")
    h = sources.history(spark, str(tmp_path / "h"))
    assert [(r.pid, r.command, r.month) for r in h.orderBy("ts").collect()] == [(12, "ls -la", "202401"), (12, "ls -la", "202401"), (13, "make", "202402")]
    sinks.monthly(h, str(tmp_path / "log"))
    kept = sinks.without_nth(spark.read.parquet(str(tmp_path / "log")), 1, F.col("command").contains("ls"), F.desc("ts"))
    assert kept.count() == 2 and kept.where("minute(ts) = 16").count() == 0
    s = history_stream(spark, str(tmp_path / "h"))
    for name, stream, want in (("unique", newest_commands(s), 2), ("counts", hourly_counts(s, "1 minute"), 1)):
        q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"ck-{name}")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert spark.table(name).count() >= want


def test_refresh_pairs_by_batches(spark, tmp_path):
    known, pairs = str(tmp_path / "known"), str(tmp_path / "pairs")
    run = refresh_pairs(spark, known, pairs)
    run(spark.createDataFrame([(1,), (2,)], "id int"), 0)
    run(spark.createDataFrame([(2,), (3,)], "id int"), 1)
    run(spark.createDataFrame([(2,), (3,)], "id int"), 1)
    assert sorted((r.id1, r.id2) for r in spark.read.parquet(pairs).collect()) == [(1, 2), (1, 3), (2, 3)]


def test_text_sinks(spark, tmp_path):
    g = spark.createDataFrame([("g", "a", 1.0), ("h", "b", 2.0)], "grp string, id string, v double")
    sinks.by_group(g, str(tmp_path / "bg"), "grp", F.col("id"))
    assert sorted(p.name for p in (tmp_path / "bg").iterdir() if p.is_dir()) == ["grp=g", "grp=h"]
    sinks.pair_values(g, str(tmp_path / "pv"), "grp", "id", "v")
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "pv")).collect()) == ["g->a\t1.0", "h->b\t2.0"]
    assert [r.value for r in sinks.from_template(g, "run {id} > {v}.out").collect()] == ["run a > 1.0.out", "run b > 2.0.out"]
    assert sinks.ascii_table(g.orderBy("id")).splitlines()[0].split() == ["grp", "id", "v"]
    n = spark.createDataFrame([("p", 2.0, [1.0, 3.0])], "pair string, observed double, shuffled array<double>")
    assert rows(sinks.null_rows(n)[1]) == [("p", 0, 1.0), ("p", 1, -1.0)]
    s = spark.createDataFrame([(0, "A", 1.5), (0, "X", 9.0), (1, "R", -2.0)], "pos int, aa string, score double")
    sinks.pssm(s, str(tmp_path / "ps"), "AR")
    assert rows(sources.pssm_lines(spark, str(tmp_path / "ps")).select(F.slice("scores", 2, 2).alias("s"))) == [([0.0, -2.0],), ([1.5, 0.0],)]
    t = sinks.polytomies(spark.createDataFrame([("group_0", ["a"]), ("group_0_1", ["b", "c"])], "name string, members array<string>"))
    from seqloom.operators.trees import newick

    assert newick(t, "tree", "node", "parent", "label", "length").head().newick == "((b:1,c:1):1,a:1):1;"
    c = sinks.codon_positions(spark.createDataFrame([("x", 1, 9)], "name string, start int, end int"))
    assert rows(c)[2] == ("x_pos3", 3, 9, 3)
