"""Scans of sequence, alignment, tree, cluster, hit, profile and log files.

Every reader takes a session and a path (a file, a folder or a pattern) and gives a DataFrame; files are read
by Spark's own text and CSV scans, split by records wherever the format has a separator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

EDGES = "seq1 string, seq2 string, score double"
HITS = (
    "qacc string, sacc string, pident double, length int, mismatch int, gapopen int, qstart int, qend int, sstart int, send int, "
    "evalue double, bitscore double, qlen int, slen int, nident int"
)
PROFILE = "indx int, aa string, ss string, coil_prob double, helix_prob double, sheet_prob double"


def _file(c: str = "path") -> Column:
    return F.col("_metadata.file_path").alias(c)


def text_records(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """``(path, value)``: the pieces between a separator; blank ones are left out."""
    return spark.read.option("lineSep", separator).text(path).select(_file(), "value").where(F.trim(F.regexp_replace("value", r"\s", "")) != "")


def whole_text(spark: SparkSession, path) -> DataFrame:
    """``(path, value)``: one row a file; invalid UTF-8 is replaced, a carriage return is a line end.

    ``path`` may be an open file of bytes or text, as standard input or a pipe is: it is read once, on the driver.
    """
    if hasattr(path, "read"):
        text = path.read()
        text = text.decode("utf-8", "replace") if isinstance(text, bytes) else text
        return spark.createDataFrame([("-", text.replace("\r", "\n"))], "path string, value string")
    raw = spark.read.format("binaryFile").load(path)
    return raw.select("path", F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "\r", "\n").alias("value"))


def lines(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """``(path, n, value)``: lines with their number in the file, from 1.

    Files are split for reading; their lines are put in order by block and place, a file in one task, which spills.
    """
    reader = spark.read if separator is None else spark.read.option("lineSep", separator)
    place = F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i")
    t = reader.text(path).select(_file(), *place, "value")
    return t.select("path", F.row_number().over(Window.partitionBy("path").orderBy("b", "i")).alias("n"), "value")


def _split_header(c: Column) -> tuple[Column, Column]:
    head = F.trim(F.regexp_replace(c, "\r", ""))
    return F.regexp_extract(head, r"^(\S*)", 1), F.trim(F.regexp_extract(head, r"^\S*\s+(.*)$", 1))


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """``(path, id, description, seq)``: a record a row, however its residues are wrapped."""
    records = spark.read.option("lineSep", "\n>").text(path).select(_file(), F.regexp_replace("value", "^>", "").alias("value")).where(F.trim("value") != "")
    head = F.substring_index("value", "\n", 1)
    ids, description = _split_header(head)
    body = F.when(F.instr("value", "\n") > 0, F.expr("substr(value, instr(value, '\\n') + 1)")).otherwise("")
    return records.select("path", ids.alias("id"), description.alias("description"), F.regexp_replace(body, r"\s+", "").alias("seq"))


def fasta_unique(spark: SparkSession, path: str, key: Column | None = None) -> DataFrame:
    """As :func:`fasta`, keyed by id or a function of it; a repeated key is an error when its row is read."""
    f = fasta(spark, path).withColumn("key", F.col("id") if key is None else key)
    n = F.count(F.lit(1)).over(Window.partitionBy("key"))
    checked = F.when(F.col("n") == 1, F.col("key")).otherwise(F.raise_error(F.concat(F.lit("repeated id "), F.col("key"))))
    return f.withColumn("n", n).withColumn("key", checked).drop("n")


def ncbi_fasta(spark: SparkSession, path: str, prefix: str = "NP") -> DataFrame:
    """``(gi, db, accession, description, seq)`` of pipe-delimited headers whose accession has a prefix."""
    f = fasta(spark, path)
    p = F.split(F.concat_ws(" ", "id", "description"), r"\|")
    return f.select(p[1].alias("gi"), p[2].alias("db"), p[3].alias("accession"), F.trim(p[4]).alias("description"), "seq").where(F.col("accession").startswith(prefix))


def _checked(alignment: DataFrame) -> DataFrame:
    w = Window.partitionBy("path")
    bad = F.min(F.length("seq")).over(w) != F.max(F.length("seq")).over(w)
    return alignment.withColumn("bad", bad).withColumn("seq", F.when(F.col("bad"), F.raise_error(F.lit("rows of different length"))).otherwise(F.col("seq"))).drop("bad")


def alignment(spark: SparkSession, path: str, format: str = "fasta") -> DataFrame:
    """``(path, id, seq)`` of an alignment in fasta, clustal, stockholm, phylip or nexus; its rows have one length."""
    if format == "fasta":
        return _checked(fasta(spark, path).select("path", "id", "seq"))
    text = lines(spark, path)
    if format == "clustal":
        rows = text.where(F.col("value").rlike(r"^\S+\s+[A-Za-z*.-]+(\s+\d+)?\s*$") & ~F.col("value").rlike("^CLUSTAL"))
    elif format == "stockholm":
        rows = text.where(F.col("value").rlike(r"^[^#/\s]\S*\s+\S+\s*$"))
    elif format == "phylip":
        rows = text.where((F.col("n") > 1) & F.col("value").rlike(r"^\S+\s+\S"))
    elif format == "nexus":
        start = F.min(F.when(F.lower("value").rlike(r"^\s*matrix\s*$"), F.col("n"))).over(Window.partitionBy("path"))
        stop = F.min(F.when((F.col("n") > F.col("start")) & F.col("value").rlike(r"^\s*;"), F.col("n"))).over(Window.partitionBy("path"))
        rows = text.withColumn("start", start).withColumn("stop", stop).where((F.col("n") > F.col("start")) & (F.col("n") < F.col("stop")) & F.col("value").rlike(r"\S+\s+\S"))
    else:
        raise ValueError("format must be fasta, clustal, stockholm, phylip or nexus")
    parts = rows.select("path", "n", F.regexp_extract("value", r"^\s*(\S+)", 1).alias("id"), F.regexp_replace(F.regexp_extract("value", r"^\s*\S+\s+(.*)$", 1), r"\s+\d+\s*$|\s", "").alias("part"))
    whole = parts.groupBy("path", "id").agg(F.array_sort(F.collect_list(F.struct("n", "part"))).alias("p"))
    return _checked(whole.select("path", "id", F.array_join(F.transform("p", lambda x: x["part"]), "").alias("seq")))


#: How the first line of a format begins.
FIRST_LINES = (("fasta", r"^>"), ("genbank", r"^LOCUS\b"), ("clustal", r"^CLUSTAL"), ("stockholm", r"^# STOCKHOLM"), ("nexus", r"(?i)^#NEXUS"), ("phylip", r"^\s*\d+\s+\d+\s*$"))


def guessed_format(spark: SparkSession, path: str) -> str:
    """The format of sequence files, by the first line that is not blank; an unknown one is an error.  All files of a call have one format."""
    import re

    head = spark.read.text(path).where("trim(value) <> ''").head(1)
    found = [name for name, pattern in FIRST_LINES if head and re.search(pattern, head[0].value)]
    if not found:
        raise ValueError(f"{path}: no known sequence format")
    return found[0]


def sequences(spark: SparkSession, path: str, format: str | None = None) -> DataFrame:
    """``(id, seq)`` of sequence or alignment files in a stated format, or a guessed one."""
    format = format or guessed_format(spark, path)
    reader = {"fasta": fasta, "genbank": genbank}.get(format)
    return (reader(spark, path) if reader else alignment(spark, path, format)).select("id", "seq")


def genbank(spark: SparkSession, path: str) -> DataFrame:
    """``(path, id, description, seq, features)``; features are ``(type, start, end)``, from 0, half-open."""
    t = text_records(spark, path, "\n//")
    feature = F.regexp_extract_all(F.regexp_extract("value", r"(?s)FEATURES[^\n]*\n(.*?)\nORIGIN", 1), F.lit(r"(?m)^ {5}(\S+ +\D*\d+\.\.\D*\d+)"), 1)
    spans = F.transform(
        feature,
        lambda x: F.struct(
            F.regexp_extract(x, r"^(\S+)", 1).alias("type"), (F.regexp_extract(x, r"(\d+)\.\.", 1).cast("int") - 1).alias("start"), F.regexp_extract(x, r"\.\.\D*(\d+)", 1).cast("int").alias("end")
        ),
    )
    seq = F.upper(F.regexp_replace(F.regexp_extract("value", r"(?s)ORIGIN[^\n]*\n(.*)$", 1), r"[^A-Za-z*-]", ""))
    description = F.regexp_replace(F.regexp_extract("value", r"(?s)DEFINITION\s+(.*?)\n\S", 1), r"\s+", " ")
    return t.select("path", F.regexp_extract("value", r"LOCUS\s+(\S+)", 1).alias("id"), description.alias("description"), seq.alias("seq"), spans.alias("features")).where("id <> ''")


def edges(spark: SparkSession, path: str, header: bool = True, separator: str = ",") -> DataFrame:
    """``(seq1, seq2, score)`` of an edge list."""
    return spark.read.schema(EDGES).option("header", header).option("sep", separator).csv(path)


def support_groups(spark: SparkSession, path: str) -> DataFrame:
    """``(support, grp)`` of a two-column file without header."""
    return spark.read.schema("support double, grp string").csv(path)


def id_dictionary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("hash string, name string").csv(path)


def hits(spark: SparkSession, path: str) -> DataFrame:
    """Tabular search hits, 15 columns; comment lines are skipped."""
    return spark.read.schema(HITS).option("sep", "\t").option("comment", "#").csv(path)


def hits_xml(spark: SparkSession, path: str) -> DataFrame:
    """``(query, subject, identity, length, evalue, bits)``: the first alignment of every hit of a search report in XML.

    Reports are split for reading at the ends of their queries, so a task holds one query's hits and not a file.
    """
    schema = (
        "`Iteration_query-def` string, Iteration_hits struct<Hit: array<struct<Hit_id: string, Hit_def: string, Hit_hsps: struct<Hsp: array<struct<"
        "`Hsp_bit-score`: double, Hsp_evalue: double, Hsp_identity: int, `Hsp_align-len`: int>>>>>>"
    )
    whole = spark.read.option("lineSep", end := "</Iteration>").text(path)
    # what stands before the record is the report's head, the blanks between two records, or the report's end
    one = F.regexp_extract("value", r"(?s)<Iteration(?:\s[^>]*)?>.*", 0)
    x = whole.select(one.alias("one")).where("one <> ''").select(F.from_xml(F.concat("one", F.lit(end)), schema).alias("r")).select("r.*")
    h = x.select(F.col("`Iteration_query-def`").alias("query"), F.explode("Iteration_hits.Hit").alias("h"))
    p = F.col("h.Hit_hsps.Hsp")[0]
    return h.select("query", F.col("h.Hit_def").alias("subject"), p["Hsp_identity"].alias("identity"), p["Hsp_align-len"].alias("length"), p["Hsp_evalue"].alias("evalue"), p["Hsp_bit-score"].alias("bits"))


def profile(spark: SparkSession, path: str) -> DataFrame:
    """``(path, indx, aa, ss, coil_prob, helix_prob, sheet_prob)`` of secondary-structure files."""
    t = spark.read.text(path).select(_file(), F.split(F.trim("value"), r"\s+").alias("v")).where(~F.col("v")[0].startswith("#") & (F.size("v") == 6))
    names = [f.name for f in T.StructType.fromDDL(PROFILE).fields]
    kinds = [f.dataType for f in T.StructType.fromDDL(PROFILE).fields]
    return t.select("path", *[F.col("v")[i].cast(k).alias(n) for i, (n, k) in enumerate(zip(names, kinds))])


def numbers(spark: SparkSession, path: str, *columns: int, separator: str = r"\s+") -> DataFrame:
    """Chosen columns of numeric text as doubles ``c0``, ``c1``, ...; comment lines are skipped."""
    t = spark.read.text(path).where(~F.trim("value").startswith("#") & (F.trim("value") != "")).select(F.split(F.trim("value"), separator).alias("v"))
    return t.select(*[F.get("v", F.lit(i)).cast("double").alias(f"c{i}") for i in columns])


def clusters(spark: SparkSession, path: str, group_split: str = "\n", member_split: str = "\t") -> DataFrame:
    """``(path, grp, members)``: a group a line, numbered from 0; blank ones are skipped."""
    t = lines(spark, path, None if group_split == "\n" else group_split).where(F.trim(F.regexp_replace("value", r"[\r\n]", "")) != "")
    grp = F.row_number().over(Window.partitionBy("path").orderBy("n")) - 1
    members = F.filter(F.split(F.regexp_replace("value", r"^[\r\n]+|[\r\n]+$", ""), member_split), lambda m: m != "")
    return t.select("path", grp.alias("grp"), members.alias("members"))


def group_report(spark: SparkSession, path: str) -> DataFrame:
    """``(name, score, members)`` of a report of groups, ``group_<name>``, score and members by tabs."""
    t = spark.read.text(path).where(F.col("value").startswith("group_")).select(F.split("value", "\t").alias("v"))
    return t.select(F.regexp_replace(F.col("v")[0], "^group_", "").alias("name"), F.col("v")[1].cast("double").alias("score"), F.slice("v", F.lit(3), F.size("v")).alias("members"))


def matrix(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """``(row, column, value)`` of a square labelled matrix; blanks are left out."""
    t = lines(spark, path).where("trim(value) <> ''").select("path", "n", F.split("value", separator, -1).alias("v"))
    head = t.where("n = 1").select("path", F.posexplode("v").alias("i", "name"))
    cells = t.where("n > 1").select("path", F.trim(F.col("v")[0]).alias("row"), F.posexplode("v").alias("i", "x")).where("i > 0 and trim(x) <> ''")
    return cells.join(head, ["path", "i"]).select("row", F.trim("name").alias("column"), F.expr("try_cast(trim(x) as double)").alias("value"))


def probability_matrix(spark: SparkSession, path: str, order: str = "ARNDCQEGHILKMFPSTWYV*") -> DataFrame:
    """``(aa, other, cumulative)``: a residue, then cumulative probabilities in a fixed order of residues, by tabs."""
    t = spark.read.text(path).where("trim(value) <> ''").select(F.split("value", "\t").alias("v"))
    cells = t.select(F.col("v")[0].alias("aa"), F.posexplode(F.slice("v", F.lit(2), F.lit(len(order)))).alias("i", "x"))
    return cells.select("aa", F.substr(F.lit(order), F.col("i") + 1, F.lit(1)).alias("other"), F.expr("try_cast(x as double)").alias("cumulative")).where("cumulative is not null")


def newick(spark: SparkSession, path: str) -> DataFrame:
    """``(path, tree, node, parent, label, length, post_order)``: a node a row, of every tree of a file."""
    text = whole_text(spark, path).select("path", F.posexplode(F.filter(F.split("value", ";"), lambda x: F.regexp_replace(x, r"\s", "") != "")).alias("tree", "value"))
    return newick_nodes(text)


def newick_nodes(trees: DataFrame) -> DataFrame:
    """The nodes of trees given as ``(path, tree, value)``; nodes are numbered as they are opened."""

    def run(batches):
        import re

        import pandas as pd

        token = re.compile(r"\s*(\(|\)|,|:|;|'(?:[^']|'')*'|\[[^\]]*\]|[^\s(),:;\[\]']+)")
        for batch in batches:
            out = []
            for path, tree, value in batch[["path", "tree", "value"]].itertuples(index=False):
                nodes = [[None, "", None, -1]]  # parent, label, length, post-order place
                at, done, number = 0, 0, False
                for t in token.findall(value):
                    if t == "(":
                        nodes.append([at, "", None, -1])
                        at = len(nodes) - 1
                    elif t in ",)":
                        nodes[at][3], done = done, done + 1
                        parent = nodes[at][0]
                        if t == ",":
                            nodes.append([parent, "", None, -1])
                            at = len(nodes) - 1
                        else:
                            at = parent
                    elif t == ":":
                        number = True
                        continue
                    elif t[0] == "[" or t == ";":
                        pass
                    elif number:
                        nodes[at][2] = float(t)
                    else:
                        nodes[at][1] = t.strip("'").replace("''", "'")
                    number = False
                nodes[at][3] = done
                out.extend((path, tree, i, p, label, size, place) for i, (p, label, size, place) in enumerate(nodes))
            frame = pd.DataFrame(out, columns=["path", "tree", "node", "parent", "label", "length", "post_order"])
            yield frame.astype({"parent": "Int64"})

    return trees.select("path", "tree", "value").mapInPandas(run, "path string, tree int, node long, parent long, label string, length double, post_order int")


def support_values(spark: SparkSession, path: str) -> DataFrame:
    """``(path, support)`` of annotated tree texts: ``)NN:``, else ``bootstrap=NN``."""
    t = whole_text(spark, path)
    plain, named = (F.regexp_extract_all("value", F.lit(p), 1) for p in (r"\)(\d+(?:\.\d+)?):", r"bootstrap=(\d+(?:\.\d+)?)"))
    return t.select("path", F.explode(F.when(F.size(plain) > 0, plain).otherwise(named)).alias("s")).select("path", F.col("s").cast("double").alias("support"))


def inference_log(spark: SparkSession, path: str) -> DataFrame:
    """``(inference, likelihood, file)`` of the final lines of a tree inference log."""
    t = spark.read.text(path).where(F.col("value").rlike(r"^Inference\[\d+\] final")).select("value", F.split("value", " ").alias("v"))
    number = F.regexp_extract("value", r"\[(\d+)\]", 1).cast("int")
    return t.select(number.alias("inference"), F.expr("try_cast(get(v, 4) as double)").alias("likelihood"), F.get("v", F.lit(9)).alias("file"))


def aligned_profile(spark: SparkSession, path: str) -> DataFrame:
    """``(path, n, m1, c1, h1, s1, m2, c2, h2, s2)``: paired profiles, ``?0`` and the like as null; the last line is no row."""
    t = lines(spark, path).where("trim(value) <> '' and value not like '#%'")
    last = F.max("n").over(Window.partitionBy("path"))
    v = t.withColumn("last", last).where("n < last").select("path", "n", F.split(F.trim("value"), r"\s+").alias("v"))
    names = ["m1", "c1", "h1", "s1", "m2", "c2", "h2", "s2"]
    return v.select("path", "n", *[F.expr(f"try_cast(get(v, {i + 1}) as double)").alias(c) for i, c in enumerate(names)])


def truncated_profile(spark: SparkSession, path: str) -> DataFrame:
    """``(path, value)``: what stands before the first END."""
    return whole_text(spark, path).select("path", F.regexp_extract("value", r"(?s)^(.+?)(?=END)", 1).alias("value"))


def topology(spark: SparkSession, path: str) -> DataFrame:
    """``(path, id, topology)``: one symbol a residue, header dropped and lines joined."""
    return fasta(spark, path).select("path", "id", F.col("seq").alias("topology"))


def tmhmm(spark: SparkSession, path: str) -> DataFrame:
    """``(id, len, helices, segments)`` of one-line reports; segments are ``(symbol, start, end)`` along the sequence, M between the stated sides."""
    t = spark.read.text(path).where(F.col("value").contains("Topology="))
    text = F.regexp_extract("value", r"Topology=(\S+)", 1)
    sides = F.regexp_extract_all(text, F.lit("([io])"), 1)
    places = F.transform(F.regexp_extract_all(text, F.lit("([0-9]+)"), 1), lambda x: x.cast("int"))
    size = F.regexp_extract("value", r"len=(\d+)", 1).cast("int")
    base = t.select(F.regexp_extract("value", r"^(\S+)", 1).alias("id"), size.alias("len"), F.regexp_extract("value", r"PredHel=(\d+)", 1).cast("int").alias("helices"), sides.alias("s"), places.alias("p"))
    k = F.size("p")
    segment = lambda i: F.struct(
        F.when(i % 2 == 0, F.get("s", (i / 2).cast("int"))).otherwise("M").alias("symbol"),
        F.when(i == 0, F.lit(0)).otherwise(F.get("p", i - 1) - F.when(i % 2 == 1, 1).otherwise(0)).alias("start"),
        F.when(i == k, F.col("len")).otherwise(F.get("p", i) - F.when(i % 2 == 0, 1).otherwise(0)).alias("end"),
    )
    return base.select("id", "len", "helices", F.transform(F.sequence(F.lit(0), k), segment).alias("segments"))


def pssm_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(path, pos, scores)``: a position a line, numbers by blanks; lines that do not begin with one are skipped."""
    t = lines(spark, path).where(F.col("value").rlike(r"^\s*-?\d"))
    pos = F.row_number().over(Window.partitionBy("path").orderBy("n")) - 1
    return t.select("path", pos.alias("pos"), F.transform(F.split(F.trim("value"), r"\s+"), lambda x: x.cast("double")).alias("scores"))


def motifs(spark: SparkSession, path: str) -> DataFrame:
    """``(id, motif, start, end)`` of a motif scan report, from 0, half-open."""
    t = spark.read.option("lineSep", ">").text(path).where("trim(value) <> ''")
    head = F.substring_index("value", "\n", 1)
    found = F.regexp_extract_all("value", F.lit("([0-9]+ - [0-9]+)"), 1)
    x = t.select(F.regexp_extract(head, r"^(\S+)", 1).alias("id"), F.regexp_extract(head, r"(PS\d+)", 1).alias("motif"), F.explode(found).alias("f"))
    return x.select("id", "motif", (F.regexp_extract("f", r"^(\d+)", 1).cast("int") - 1).alias("start"), F.regexp_extract("f", r"(\d+)$", 1).cast("int").alias("end"))


def zipped_texts(spark: SparkSession, path: str, pattern: str = "") -> DataFrame:
    """``(path, name, value)``: the members of zip archives whose names match, as text; invalid UTF-8 is replaced."""

    def run(batches):
        import io
        import re
        import zipfile

        import pandas as pd

        for batch in batches:
            for where, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in z.namelist():  # a member at a time
                        if re.search(pattern, name) and not name.endswith("/"):
                            yield pd.DataFrame({"path": [where], "name": [name], "value": [z.read(name).decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n")]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, name string, value string")


def topology_report(spark: SparkSession, path: str, zipped: bool = False, pattern: str = "") -> DataFrame:
    """``(id, method, topology)`` of a report of several predictors, plain or in zip archives."""
    t = zipped_texts(spark, path, pattern) if zipped else whole_text(spark, path)
    block = F.explode(F.regexp_extract_all("value", F.lit(r"(?s)(Sequence name:.*?)(?=Sequence name:|\z)"), 1)).alias("b")
    b = t.select(block).select(F.regexp_extract("b", r"Sequence name: *(\S+)", 1).alias("id"), F.explode(F.regexp_extract_all("b", F.lit(r"(\S+) predicted topology:\s*\n[ioM]+"), 0)).alias("m"))
    return b.select("id", F.regexp_extract("m", r"^(\S+)", 1).alias("method"), F.regexp_extract("m", r"([ioM]+)\s*$", 1).alias("topology"))


def name_map(spark: SparkSession, path: str) -> DataFrame:
    """``(species, id)``: blocks between blank lines, the first line ends in ``- species``, then a tabbed line an id."""
    t = whole_text(spark, path).select(F.explode(F.split("value", r"\n\s*\n")).alias("b")).where("trim(b) <> ''")
    s = t.select(F.trim(F.regexp_extract("b", r"^\s*[^\n]*- *([^\n]*)", 1)).alias("species"), F.explode(F.slice(F.split(F.trim("b"), "\n"), F.lit(2), F.size(F.split("b", "\n")))).alias("l"))
    return s.select("species", F.trim(F.element_at(F.split("l", "\t"), -1)).alias("id")).where("id <> ''")


def blocks(spark: SparkSession, path: str) -> DataFrame:
    """``(path, set, file, name, start, end)`` of data blocks: sets between ``//``, comments after ``#``; 1-based, inclusive."""
    t = whole_text(spark, path).select("path", F.posexplode(F.split(F.regexp_replace("value", "#[^\n]*", ""), "//")).alias("set", "b"))
    v = t.select("path", "set", F.filter(F.split("b", "\n"), lambda x: F.trim(x) != "").alias("l")).where("size(l) > 1")
    r = v.select("path", "set", F.trim(F.col("l")[0]).alias("file"), F.explode(F.slice("l", F.lit(2), F.size("l"))).alias("x")).withColumn("x", F.split("x", ","))
    return r.select("path", "set", "file", F.trim(F.col("x")[0]).alias("name"), F.trim(F.col("x")[1]).cast("int").alias("start"), F.trim(F.col("x")[2]).cast("int").alias("end"))


def provenance(spark: SparkSession, path: str) -> DataFrame:
    """``(path, id, positions)``: an id line, then a line of comma-separated position ids."""
    t = lines(spark, path).where("trim(value) <> ''")
    w = Window.partitionBy("path").orderBy("n")
    two = t.withColumn("k", F.row_number().over(w)).withColumn("list", F.lead("value").over(w)).where("k % 2 = 1")
    return two.select("path", F.trim("value").alias("id"), F.transform(F.filter(F.split("list", ","), lambda x: F.trim(x) != ""), lambda x: F.trim(x).cast("int")).alias("positions"))


def history(spark: SparkSession, path: str) -> DataFrame:
    """``(pid, ts, command, month)`` of shell histories; the month is that of the file's name, or of the time."""
    t = spark.read.text(path).select(F.col("_metadata.file_name").alias("f"), "value")
    return history_lines(t, F.regexp_extract("f", r"(\d{6})", 1))


def history_lines(t: DataFrame, month: Column) -> DataFrame:
    """Parses a column ``value`` of lines ``:<pid> <Mon/dd/yy HH:MM>; <command>``; others are left out."""
    part = lambda i: F.regexp_extract("value", r"^:(\d+) (\w{3}/\d{2}/\d{2} \d{2}:\d{2}); (.*)$", i)
    ts = F.to_timestamp(part(2), "MMM/dd/yy HH:mm")
    return t.where(F.col("value").rlike(r"^:\d+ \w{3}/\d{2}/\d{2} \d{2}:\d{2}; ")).select(
        part(1).cast("int").alias("pid"), ts.alias("ts"), part(3).alias("command"), F.when(month != "", month).otherwise(F.date_format(ts, "yyyyMM")).alias("month")
    )


def html_rows(spark: SparkSession, path: str) -> DataFrame:
    """``(path, row, cells)``: the cells of all table rows of pages, without mark-up, entities resolved."""
    t = whole_text(spark, path).select("path", F.posexplode(F.regexp_extract_all("value", F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), 1)).alias("row", "r"))
    cells = F.transform(F.regexp_extract_all("r", F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), 1), lambda c: F.trim(F.regexp_replace(c, "<[^>]*>", "")))
    return t.select("path", "row", F.transform(cells, _entities).alias("cells"))


def _entities(c: Column) -> Column:
    for name, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(plain))
    return c


@F.pandas_udf(T.StringType())
def unescaped(c):  # type: ignore[no-untyped-def]
    """A text with all its HTML entities resolved."""
    import html

    return c.map(html.unescape, na_action="ignore")


def files(spark: SparkSession, path: str, pattern: str | None = None, depth: int | None = None, hidden: bool = False) -> DataFrame:
    """``(path, name, depth, size, modified)`` of the files below a folder; contents are not read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    clean = F.regexp_replace("path", "^file:/+", "/")
    base = path.removeprefix("file://").rstrip("/")
    below = F.expr(f"substr(p, {len(base) + 2})")
    out = f.withColumn("p", clean).select("p", F.element_at(F.split("p", "/"), -1).alias("name"), (F.size(F.split(below, "/"))).alias("depth"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    if not hidden:
        out = out.where(~F.col("name").startswith("."))
    if pattern:
        out = out.where(F.col("name").rlike(pattern))
    if depth is not None:
        out = out.where(F.col("depth") <= depth)
    return out.withColumnRenamed("p", "path")


def trace(spark: SparkSession, path: str, variables: list[str]) -> DataFrame:
    """``(gen, variables..., result)`` of a sampler's trace."""
    schema = ", ".join(["gen int", *[f"`{v}` double" for v in variables], "result double"])
    return spark.read.schema(schema).option("header", True).option("sep", "\t").csv(path)
