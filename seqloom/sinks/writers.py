"""Writers.  Each turns a table into lines of text and lets Spark write them; folders, not single files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _write(lines: DataFrame, path: str, mode: str = "error", separator: str = "\n") -> None:
    lines.select("value").write.mode(mode).option("lineSep", separator).text(path)


def _one_file(lines: DataFrame, path: str, mode: str, *order: str) -> None:
    """For formats whose head speaks for a whole file: one task sorts (and spills) all lines."""
    _write(lines.repartition(1).sortWithinPartitions(*order), path, mode)


def wrapped(seq: Column, width: int) -> Column:
    """A sequence in lines of a width."""
    return F.when(F.length(seq) > 0, F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n")).otherwise(F.lit(""))


def fasta_text(id_: Column, description: Column | None, seq: Column, width: int = 60) -> Column:
    head = F.concat(F.lit(">"), id_) if description is None else F.concat(F.lit(">"), F.concat_ws(" ", id_, F.when(description != "", description)))
    return F.concat(head, F.lit("\n"), wrapped(F.coalesce(seq, F.lit("")), width))


def fasta(records: DataFrame, path: str, id_: str = "id", description: str | None = "description", seq: str = "seq", width: int = 60, mode: str = "error", records_per_file: int = 0) -> None:
    """One FASTA record a row; ``mode="append"`` adds files to a folder that others add to at the same time."""
    text = fasta_text(F.col(id_), F.col(description) if description else None, F.col(seq), width)
    out = records.select(text.alias("value"))
    w = out.write.mode(mode)
    if records_per_file:
        w = w.option("maxRecordsPerFile", records_per_file)
    w.text(path)


def genbank_text(id_: Column, description: Column, seq: Column, features: Column) -> Column:
    """A flat record with its features, from 1, inclusive."""
    spans = F.array_join(F.transform(features, lambda f: F.concat(F.lit("     "), F.rpad(f["type"], 16, " "), (f["start"] + 1).cast("string"), F.lit(".."), f["end"].cast("string"))), "\n")
    numbered = F.array_join(
        F.transform(F.sequence(F.lit(0), F.floor((F.length(seq) - 1) / 60).cast("int")), lambda i: F.concat(F.lpad((i * 60 + 1).cast("string"), 9, " "), F.lit(" "), F.lower(F.substr(seq, i * 60 + 1, F.lit(60))))), "\n"
    )
    return F.concat(
        F.lit("LOCUS       "), F.rpad(id_, 24, " "), F.length(seq).cast("string"), F.lit(" aa\nDEFINITION  "), F.coalesce(description, F.lit("")),
        F.lit("\nFEATURES             Location/Qualifiers\n"), spans, F.lit("\nORIGIN\n"), F.when(F.length(seq) > 0, numbered).otherwise(""), F.lit("\n//"),
    )


def genbank(records: DataFrame, path: str, mode: str = "error") -> None:
    _write(records.select(genbank_text(F.col("id"), F.col("description"), F.col("seq"), F.col("features")).alias("value")), path, mode)


def phylip(alignment: DataFrame, path: str, id_: str = "id", seq: str = "seq", mode: str = "error") -> None:
    """`` n len``, then ids padded to the longest one, two blanks and the row, by id."""
    size = alignment.agg(F.count(F.lit(1)).alias("n"), F.max(F.length(seq)).alias("len"), F.max(F.length(id_)).alias("w"))
    rows = alignment.crossJoin(F.broadcast(size)).select(F.lit(1).alias("o"), F.col(id_).alias("k"), F.concat(F.rpad(F.col(id_), F.col("w"), F.lit(" ")), F.lit("  "), F.col(seq)).alias("value"))
    head = size.select(F.lit(0).alias("o"), F.lit("").alias("k"), F.concat(F.lit(" "), F.col("n").cast("string"), F.lit(" "), F.coalesce("len", F.lit(0)).cast("string")).alias("value"))
    _one_file(head.unionByName(rows), path, mode, "o", "k")


def pssm(scores: DataFrame, path: str, order: str = "ARNDCQEGHILKMFPSTWYV", mode: str = "error") -> None:
    """A position a line, scores with two decimals in one fixed order of residues; X and gaps are left out."""
    wide = scores.where(F.col("aa").isin(list(order))).groupBy("pos").pivot("aa", list(order)).agg(F.first("score"))
    numbers = [F.lpad(F.format_string("%.2f", F.coalesce(F.col(a), F.lit(0.0))), 7, " ") for a in order]
    head = wide.sparkSession.createDataFrame([(-1, "#pos" + "".join(a.rjust(7) for a in order))], "pos int, value string")
    rows = wide.select("pos", F.concat(F.rpad(F.col("pos").cast("string"), 4, " "), *numbers).alias("value"))
    _one_file(head.unionByName(rows), path, mode, "pos")


def delimited(table: DataFrame, path: str, separator: str = "\t", header: bool = True, mode: str = "error") -> None:
    """A table as delimited text: scores, edges, traces."""
    table.write.mode(mode).option("sep", separator).option("header", header).csv(path)


def clusters(groups: DataFrame, path: str, members: str = "members", mode: str = "error") -> None:
    """A group a line, members by tabs."""
    _write(groups.select(F.array_join(members, "\t").alias("value")), path, mode)


def group_report(groups: DataFrame, path: str, mode: str = "error") -> None:
    """``group_<name>``, score and members by tabs; larger groups first, then by name.  Groups are ``(name, score, members)``."""
    line = F.concat_ws("\t", F.concat(F.lit("group_"), F.regexp_replace("name", "^group_", "")), F.col("score").cast("string"), F.array_join("members", "\t"))
    _write(groups.orderBy(F.size("members").desc(), "name").select(line.alias("value")), path, mode)


def pair_values(pairs: DataFrame, path: str, a: str, b: str, value: str, mode: str = "error") -> None:
    """``a->b`` and a value, by a tab."""
    _write(pairs.select(F.concat(F.col(a), F.lit("->"), F.col(b), F.lit("\t"), F.col(value).cast("string")).alias("value")), path, mode)


def by_group(records: DataFrame, path: str, group: str, text: Column, mode: str = "error") -> None:
    """One folder for each group, ``group=<value>``."""
    records.select(F.col(group), text.alias("value")).repartition(group).write.mode(mode).partitionBy(group).text(path)


def by_group_in_order(records: DataFrame, path: str, group: str, text: Column, head: str, end: str, mode: str = "error", compression: str = "none") -> None:
    """As :func:`by_group`, a row for each record: every group's file has a first line, its records and a last line; no task holds a group.

    Texts are made where they are written, after the shuffle of the records.
    """
    body = records.withColumn("__place", F.lit(1))
    ends = records.select(group).distinct().withColumn("__place", F.explode(F.array(F.lit(0), F.lit(2))))
    placed = body.unionByName(ends, allowMissingColumns=True).repartition(group).sortWithinPartitions(group, "__place")
    value = F.when(F.col("__place") == 0, head).when(F.col("__place") == 2, end).otherwise(text)
    placed.select(group, value.alias("value")).write.mode(mode).option("compression", compression).partitionBy(group).text(path)


def monthly(log: DataFrame, path: str, month: str = "month") -> None:
    """Appends to a log that is kept by month."""
    log.write.mode("append").partitionBy(month).parquet(path)


def without_nth(log: DataFrame, n: int, matches: Column, *newest_first: Column) -> DataFrame:
    """The log without the n-th newest matching entry (from 1); it is written over the months it touches."""
    w = Window.partitionBy(F.lit(0)).orderBy(*newest_first)
    hit = log.where(matches).withColumn("__r", F.row_number().over(w)).where(F.col("__r") == n).drop("__r").withColumn("__gone", F.lit(True))
    joined = log.join(F.broadcast(hit), [*log.columns], "left")
    return joined.where("__gone is null").drop("__gone")


def nexus_text(trees: DataFrame, taxa: DataFrame, tree: str = "tree") -> DataFrame:
    """``(tree, value)``: a NEXUS text of each tree; taxa are ``(tree, taxon, colour)``, in order of their names."""
    t = taxa.groupBy(tree).agg(F.array_sort(F.collect_list(F.struct("taxon", "colour"))).alias("t"))
    labels = F.transform("t", lambda x: F.concat(F.lit("\t'"), x["taxon"], F.lit("'"), F.when(x["colour"].isNotNull(), F.concat(F.lit("[&!color=#"), x["colour"], F.lit("]"))).otherwise("")))
    head = F.concat(F.lit("#NEXUS\nbegin taxa;\n\tdimensions ntax="), F.size("t").cast("string"), F.lit(";\n\ttaxlabels\n"), F.array_join(labels, "\n"), F.lit("\n;\nend;\n\nbegin trees;\n\ttree tree_1 = [&R] "))
    return trees.join(t, tree).select(tree, F.concat(head, F.col("newick"), F.lit("\nend;")).alias("value"))


def polytomies(groups: DataFrame, root: str = "group_0") -> DataFrame:
    """``(tree, node, parent, label, length)`` of nested groups ``(name, members)``: a group hangs on the group its name extends, members hang on it."""
    g = groups.select(F.col("name").alias("node"), F.when(F.col("name") != root, F.regexp_replace("name", "_[^_]*$", "")).alias("parent"), "members")
    inner = g.select(F.lit(1).alias("tree"), "node", "parent", F.lit("").alias("label"), F.lit(1.0).alias("length"))
    leaves = g.select(F.lit(1).alias("tree"), F.explode("members").alias("m"), F.col("node").alias("parent")).select("tree", F.col("m").alias("node"), "parent", F.col("m").alias("label"), F.lit(1.0).alias("length"))
    return inner.unionByName(leaves)


def top_per_start(windows: DataFrame, k: int) -> DataFrame:
    """The ``k`` best (score, start) pairs of each window start, side by side; ties: the smaller index."""
    w = Window.partitionBy("start1").orderBy(F.desc("score"), "start2")
    top = windows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    return top.groupBy("start1").pivot("r", list(range(1, k + 1))).agg(F.first("score").alias("score"), F.first("start2").alias("at"))


def null_rows(nulls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(observed beside each shuffled score, their differences) of ``(pair, observed, shuffled)``."""
    x = nulls.select("pair", "observed", F.posexplode("shuffled").alias("i", "score"))
    return x, x.select("pair", "i", (F.col("observed") - F.col("score")).alias("difference"))


def repaired_alignment(text: Column) -> Column:
    """Alignment output in FASTA form: header marks at line starts, no blanks, no empty lines."""
    t = F.regexp_replace(text, r"(?m)^\s*>\s*", ">")
    return F.regexp_replace(F.regexp_replace(t, r"(?m)^([^>].*)$", "$1"), r"\n\s*\n+", "\n")


def from_template(rows: DataFrame, template: str) -> DataFrame:
    """``value``: a text with ``{column}`` filled in for each row: job scripts, configurations, definitions."""
    import re

    parts = re.split(r"\{(\w+)\}", template)
    cells = [F.lit(p) if i % 2 == 0 else F.coalesce(F.col(p).cast("string"), F.lit("")) for i, p in enumerate(parts)]
    return rows.select(F.concat(*cells).alias("value"))


def codon_positions(blocks: DataFrame) -> DataFrame:
    """Each block ``(name, start, end)`` as three, one for every codon position, with step 3."""
    return blocks.select(F.col("name"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"), "start", "end").select(
        F.concat(F.col("name"), F.lit("_pos"), (F.col("k") + 1).cast("string")).alias("name"), (F.col("start") + F.col("k")).alias("start"), "end", F.lit(3).alias("step")
    )


def zip_files(spark, folder: str, pattern: str, archive: str) -> int:
    """Puts the files of a folder whose names match into one zip archive; how many.  Bytes are copied, no row is read."""
    import re

    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place, target = jvm.org.apache.hadoop.fs.Path(folder), jvm.org.apache.hadoop.fs.Path(archive)
    fs = place.getFileSystem(conf)
    out = jvm.java.util.zip.ZipOutputStream(target.getFileSystem(conf).create(target, True))
    n = 0
    try:
        for f in sorted(fs.listStatus(place), key=lambda f: f.getPath().getName()):
            if f.isFile() and re.search(pattern, f.getPath().getName()):
                out.putNextEntry(jvm.java.util.zip.ZipEntry(f.getPath().getName()))
                source = fs.open(f.getPath())
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 65536, False)
                source.close()
                out.closeEntry()
                n += 1
    finally:
        out.close()
    return n


def similarity_definitions(profiles: DataFrame) -> DataFrame:
    """``value``: a line of an aligner's definition for each row ``(weight, column, profile1, profile2)``."""
    return from_template(profiles, "WEIGHT: {weight} TYPE: UniversalProfileSimilarity COLUMN: {column} HEADERLINES: 3 PROFILE1: {profile1} PROFILE2: {profile2}")


def ascii_table(table: DataFrame, width: int = 110, rows: int = 1000) -> str:
    """The first rows as a text table, cells wrapped to share the width.  Meant for screens: beyond ``rows`` its last line says that there are more."""
    import textwrap

    found = table.limit(rows + 1).collect()
    data = [[("" if v is None else str(v)) for v in r] for r in found[:rows]]
    head = list(table.columns)
    longest = [max(map(len, [h, *(r[i] for r in data)])) for i, h in enumerate(head)]
    spare = width - 2 * len(head)
    sizes = longest if sum(longest) <= spare else [max(4, n * spare // max(1, sum(longest))) for n in longest]
    out = []
    for k, row in enumerate([head, *data]):
        cells = [textwrap.wrap(c, n) or [""] for c, n in zip(row, sizes)]
        for j in range(max(map(len, cells), default=0)):
            out.append("  ".join((c[j] if j < len(c) else "").ljust(n) for c, n in zip(cells, sizes)).rstrip())
        if k == 0:
            out.append("  ".join("-" * n for n in sizes))
    if len(found) > rows:
        out.append(f"... more than {rows} rows")
    return "\n".join(out)
