"""Operators on the columns of alignments: spans, runs, gap states, indices, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions.stats import bit_score


def long_form(rows: DataFrame, id_: str, seq: str) -> DataFrame:
    """``(id, pos, aa)``, positions from 0; an empty sequence has no row."""
    return rows.where(F.col(seq) != "").select(F.col(id_).alias("id"), F.posexplode(F.split(F.col(seq), "")).alias("pos", "aa"))


def runs(symbols: DataFrame, key: str, pos: str, symbol: str) -> DataFrame:
    """``(key, symbol, start, end)``: maximal runs of one symbol, half-open."""
    w = Window.partitionBy(key).orderBy(pos)
    new = (F.lag(symbol).over(w).isNull() | (F.lag(symbol).over(w) != F.col(symbol))).cast("int")
    island = symbols.select(key, pos, symbol, new.alias("new")).withColumn("island", F.sum("new").over(w))
    return island.groupBy(key, "island").agg(F.first(symbol).alias("symbol"), F.min(pos).alias("start"), (F.max(pos) + 1).alias("end")).drop("island")


def spans(symbols: DataFrame, key: str, pos: str, symbol: str, wanted: str, prefix: str = "TMD") -> DataFrame:
    """``(key, name, start, end)``: the runs of one symbol, numbered by place."""
    found = runs(symbols, key, pos, symbol).where(F.col("symbol") == wanted)
    number = F.row_number().over(Window.partitionBy(key).orderBy("start"))
    return found.select(key, F.concat(F.lit(prefix), number.cast("string")).alias("name"), "start", "end")


def cut_at_span(rows: DataFrame, found: DataFrame, key: str, seq: str, n: int, extra: int = 0, exactly: bool = False) -> DataFrame:
    """The rows with at least (or ``exactly``) ``n`` spans, each cut ``extra`` behind the end of its n-th span, within its length."""
    from seqloom.functions.residues import cut_behind

    listed = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("__s"))
    fit = F.size("__s") == n if exactly else F.size("__s") >= n
    return rows.join(listed.where(fit), key).withColumn(seq, cut_behind(F.col(seq), F.col("__s"), n, extra)).drop("__s")


def complement(features: DataFrame, lengths: DataFrame, key: str, length: str) -> DataFrame:
    """``(key, start, end)``: what lies between, before and after the features of each sequence; none of length 0."""
    w = Window.partitionBy(key).orderBy("start")
    inner = features.select(key, F.coalesce(F.lag("end").over(w), F.lit(0)).alias("start"), F.col("start").alias("end"))
    last = features.groupBy(key).agg(F.max("end").alias("last"))
    tail = lengths.join(last, key, "left").select(key, F.coalesce("last", F.lit(0)).alias("start"), F.col(length).alias("end"))
    return inner.unionByName(tail).where("end > start")


def smoothed(symbols: DataFrame, key: str, pos: str, symbol: str, shortest: int = 3) -> DataFrame:
    """``(key, symbol, start, end)``: runs shorter than ``shortest`` take the symbol of the run before them; then equal neighbours merge.

    The first run keeps its symbol.
    """
    r = runs(symbols, key, pos, symbol)
    w = Window.partitionBy(key).orderBy("start")
    first = F.row_number().over(w) == 1
    kept = F.when(first | (F.col("end") - F.col("start") >= shortest), F.col("symbol"))
    filled = r.withColumn("kept", kept).withColumn("symbol", F.last("kept", ignorenulls=True).over(w)).drop("kept")
    new = (F.lag("symbol").over(w).isNull() | (F.lag("symbol").over(w) != F.col("symbol"))).cast("int")
    marked = filled.withColumn("new", new).withColumn("island", F.sum("new").over(w))
    return marked.groupBy(key, "island").agg(F.first("symbol").alias("symbol"), F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def ungapped_index(columns: DataFrame, key: str, pos: str, aa: str, gap: str = "-") -> DataFrame:
    """Adds ``residue``: the index of each residue without gaps, null at gaps."""
    w = Window.partitionBy(key).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    count = F.sum((F.col(aa) != gap).cast("int")).over(w) - 1
    return columns.withColumn("residue", F.when(F.col(aa) != gap, count))


def aligned_columns(columns: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(id1, id2, pos, aa1, aa2)`` of stated pairs of aligned rows."""
    x = columns.select(F.col("id").alias("id1"), "pos", F.col("aa").alias("aa1"))
    y = columns.select(F.col("id").alias("id2"), "pos", F.col("aa").alias("aa2"))
    return pairs.select("id1", "id2").join(x, "id1").join(y, ["id2", "pos"])


def affine_scores(aligned: DataFrame, matrix: DataFrame, gap_open: float = -5.0, gap_extend: float = 0.0) -> DataFrame:
    """``(id1, id2, raw, self1, self2, score)`` with affine gaps, normalised by the mean over both self scores.

    A column with a gap extends where the column before has a gap in either row, or is missing, else opens.
    """
    w = Window.partitionBy("id1", "id2").orderBy("pos")
    gapped = (F.col("aa1") == "-") | (F.col("aa2") == "-")
    before = F.coalesce(F.lag(gapped).over(w), F.lit(True))
    m = matrix.select("aa1", "aa2", F.col("score").alias("m"))
    own = matrix.where("aa1 = aa2").select(F.col("aa1").alias("aa"), F.col("score").alias("s"))
    base = aligned.withColumn("gapped", gapped).withColumn("before", before)
    scored = (
        base.join(F.broadcast(m), ["aa1", "aa2"], "left")
        .join(F.broadcast(own.select(F.col("aa").alias("aa1"), F.col("s").alias("s1"))), "aa1", "left")
        .join(F.broadcast(own.select(F.col("aa").alias("aa2"), F.col("s").alias("s2"))), "aa2", "left")
    )
    value = F.when(F.col("gapped"), F.when(F.col("before"), gap_extend).otherwise(gap_open)).otherwise(F.coalesce("m", F.lit(0)))
    sums = scored.groupBy("id1", "id2").agg(F.sum(value).alias("raw"), F.coalesce(F.sum("s1"), F.lit(0)).alias("self1"), F.coalesce(F.sum("s2"), F.lit(0)).alias("self2"))
    return sums.withColumn("score", (F.try_divide(F.col("raw"), F.col("self1")) + F.try_divide(F.col("raw"), F.col("self2"))) / 2)


def alignment_bits(aligned: DataFrame, matrix: DataFrame, inner: DataFrame | None = None, topology: DataFrame | None = None) -> DataFrame:
    """``(id1, id2, matches, gaps, bits)``: substitution score with a bonus for gaps, in bits a column.

    With ``topology`` ``(id, residue, symbol)`` and a second matrix ``inner``, columns whose residues both
    lie in a membrane are scored by it.
    """
    base = aligned
    if topology is not None:
        for side in ("1", "2"):
            aa, idc = f"aa{side}", f"id{side}"
            w = Window.partitionBy("id1", "id2").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
            base = base.withColumn(f"r{side}", F.when(F.col(aa) != "-", F.sum((F.col(aa) != "-").cast("int")).over(w) - 1))
            t = topology.select(F.col("id").alias(idc), F.col("residue").alias(f"r{side}"), F.col("symbol").alias(f"t{side}"))
            base = base.join(t, [idc, f"r{side}"], "left")
    m = matrix.select("aa1", "aa2", F.col("score").alias("m"))
    base = base.join(F.broadcast(m), ["aa1", "aa2"], "left")
    value = F.col("m")
    if topology is not None and inner is not None:
        base = base.join(F.broadcast(inner.select("aa1", "aa2", F.col("score").alias("mi"))), ["aa1", "aa2"], "left")
        value = F.when((F.col("t1") == "M") & (F.col("t2") == "M"), F.col("mi")).otherwise(F.col("m"))
    one, two = F.col("aa1") != "-", F.col("aa2") != "-"
    sums = base.groupBy("id1", "id2").agg(
        F.coalesce(F.sum(F.when(one & two, value)), F.lit(0)).cast("double").alias("total"),
        F.count(F.when(one & two, 1)).alias("matches"),
        F.count(F.when(~(one & two), 1)).alias("gaps"),
        (F.count(F.when(one, 1)) + F.count(F.when(two, 1))).alias("residues"),
    )
    return bits_of(sums).select("id1", "id2", "matches", "gaps", "bits")


def bits_of(sums: DataFrame) -> DataFrame:
    """Adds ``bits`` to ``(total, matches, gaps, residues)`` of pairs."""
    t, n, g = F.col("total"), F.col("matches"), F.col("gaps")
    full = t + F.try_divide(t, n) * (1 - F.try_divide(g, F.col("residues"))) * g
    return sums.withColumn("bits", bit_score(full) / (n + g))


def profile_similarity(left: DataFrame, right: DataFrame, keys: list[str], pos: str, values: list[str]) -> DataFrame:
    """Mean over matched positions of ``1 - |difference|`` averaged over the values, with unmatched left rows and
    the right rows as the length: ``sum / (rows of right + unmatched rows of left)``."""
    r = right.select(*keys, pos, *[F.col(v).alias(f"{v}_r") for v in values], F.lit(1).alias("hit"))
    diff = sum((1 - F.abs(F.col(v) - F.col(f"{v}_r")) for v in values), F.lit(0.0)) / len(values)
    joined = left.join(r, [*keys, pos], "left").groupBy(*keys).agg(F.sum(diff).alias("total"), F.count(F.when(F.col("hit").isNull(), 1)).alias("unmatched"))
    size = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"))
    return joined.join(size, keys).select(*keys, (F.col("total") / (F.col("size") + F.col("unmatched"))).alias("similarity"))


def gap_bonus_similarity(aligned: DataFrame, keys: list[str], left: list[str], right: list[str]) -> DataFrame:
    """``(keys, similarity)`` of paired profile columns; a value that is null is a gap.

    Matched columns give ``1 - |difference|`` a value.  Gaps give the mean of the matched ones, less their share of
    the residues of both sides; then the mean over columns and values, to five decimals.  Null without a match.
    """
    one, two = F.col(left[0]).isNotNull(), F.col(right[0]).isNotNull()
    value = sum((1 - F.abs(F.col(a) - F.col(b)) for a, b in zip(left, right)), F.lit(0.0))
    s = aligned.groupBy(*keys).agg(
        F.sum(F.when(one & two, value)).alias("t"), F.count(F.when(one & two, 1)).alias("n"), F.count(F.when(~(one & two), 1)).alias("g"), (F.count(left[0]) + F.count(right[0])).alias("r")
    )
    t, n, g = F.col("t"), F.col("n"), F.col("g")
    full = t + F.try_divide(t, n) * (1 - F.try_divide(g, F.col("r"))) * g
    return s.select(*keys, F.round(F.try_divide(full, n + g) / len(left), 5).alias("similarity"))


def first_segment(positions: DataFrame, segments: DataFrame, pos: str, start: str, end: str, width: int = 1024) -> DataFrame:
    """Each position with the segments that hold it: a join on stretches of ``width`` positions, then on the bounds."""
    cut = segments.withColumn("__b", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    found = positions.withColumn("__b", F.floor(F.col(pos) / width)).join(cut, "__b")
    return found.where((F.col(pos) >= F.col(start)) & (F.col(pos) <= F.col(end))).drop("__b")


def contiguous(blocks: DataFrame, key: str, start: str, end: str) -> Column:
    """A window column: true where a block begins right after the one before it in its set, or is the first."""
    w = Window.partitionBy(key).orderBy(start)
    return F.coalesce(F.lag(end).over(w) + 1 == F.col(start), F.lit(True))


def consensus(votes: DataFrame, keys: list[str], pos: str, symbol: str) -> DataFrame:
    """``(keys, pos, symbol, votes)``: the most frequent symbol of each position; ties: the smallest one."""
    n = votes.groupBy(*keys, pos, symbol).agg(F.count(F.lit(1)).alias("votes"))
    w = Window.partitionBy(*keys, pos).orderBy(F.desc("votes"), symbol)
    return n.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def residue_scores(scores: DataFrame, columns: DataFrame) -> DataFrame:
    """``(id, pos, aa, score)``: a profile ``(pos, aa, score)`` for each row's own residues, gap columns left out and renumbered."""
    own = ungapped_index(columns, "id", "pos", "aa").where("residue is not null").select("id", F.col("pos").alias("column"), "residue")
    return own.join(scores.withColumnRenamed("pos", "column"), "column").select("id", F.col("residue").alias("pos"), "aa", "score")


def leading_alphabet(records: DataFrame, seq: str, order: str, letters: int = 1000, least: float = 0.9) -> DataFrame:
    """One row ``alphabet`` for a file: the guess from its first records that hold at least so many letters.

    Records are taken in order until they do; lengths before a record are running sums over range partitions.
    """
    from seqloom.operators.statistics import cumulative

    clean = records.select(F.col(order).alias("o"), F.regexp_replace(F.col(seq), "[^A-Za-z]", "").alias("s")).where("s <> ''").withColumn("n", F.length("s"))
    before = cumulative(clean, "n", "o")
    total = clean.agg(F.sum("n").alias("total"))
    head = before.crossJoin(F.broadcast(total)).where(F.round(F.col("cumulative") * F.col("total")) - F.col("n") < letters)
    count = lambda p: F.sum(F.length(F.regexp_replace(F.upper("s"), p, "")))
    share = head.agg((count("[^ACGT]") / F.sum("n")).alias("share"))
    return share.select(F.when(F.col("share") > least, "nucl").when(F.col("share").isNotNull(), "prot").alias("alphabet"))


def zipped(left: DataFrame, right: DataFrame, place: str, key: str) -> DataFrame:
    """Two tables side by side by place; a place whose keys differ is an error when its row is read."""
    r = right.select([F.col(c).alias(c if c == place else f"{c}_right") for c in right.columns])
    out = left.join(r, place)
    wrong = F.raise_error(F.concat(F.lit("different records at place "), F.col(place).cast("string")))
    return out.withColumn(key, F.when(F.col(key).eqNullSafe(F.col(f"{key}_right")), F.col(key)).otherwise(wrong)).drop(f"{key}_right")
