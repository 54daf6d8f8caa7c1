"""Consensus of reads: votes, plurality, medoids, alignment scripts and reconstruction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions.strands import BASES
from strandlake.operators.editing import edit_operations, edit_script  # noqa: F401  the script of one pair, beside its rows
from strandlake.sources.scratch import discard, written


def votes(reads: DataFrame) -> DataFrame:
    """(strand_id, pos, symbol, n) of reads (strand_id, read_no, read) that are aligned by position."""
    p = reads.select("strand_id", F.posexplode(F.split("read", "")).alias("p", "symbol"))
    return p.groupBy("strand_id", (F.col("p") + 1).alias("pos"), "symbol").agg(F.count("*").alias("n"))


def plurality(votes_: DataFrame, drafts: DataFrame | None = None) -> DataFrame:
    """(strand_id, consensus): the symbol with most votes in each position. A tie keeps the draft's letter (drafts: strand_id, draft), else goes by letter."""
    v = votes_ if drafts is None else votes_.join(drafts.select("strand_id", "draft"), "strand_id", "left")
    other = F.lit(False) if drafts is None else ~F.col("symbol").eqNullSafe(F.substring("draft", F.col("pos"), F.lit(1)))
    top = v.groupBy("strand_id", "pos").agg(F.min(F.struct((-F.col("n")).alias("n"), other.alias("other"), "symbol")).alias("t"))
    return top.groupBy("strand_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "t.symbol"))), lambda x: x.symbol), "").alias("consensus"))


def evenly(reads: DataFrame, most: int = 16) -> DataFrame:
    """reads (strand_id, read_no, ...) with at most so many of each strand, evenly spaced in the order of read_no (the first and last among them), with their place i and the number n of all."""
    w = Window.partitionBy("strand_id")
    r = reads.withColumn("i", F.row_number().over(w.orderBy("read_no")) - 1).withColumn("n", F.count("*").over(w))
    taken = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: F.rint(k * (F.col("n") - 1) / F.lit(most - 1)).cast("int"))
    return r.where((F.col("n") <= most) | F.array_contains(taken, F.col("i")))


def medoids(reads: DataFrame, length: int | DataFrame) -> DataFrame:
    """(strand_id, read_no, read) of the read with the least total distance to the others; ties by nearness to the designed length (one for all, or a table strand_id, length), then order.
    Clusters of one or two reads go by length only. A cluster's reads are compared with each other, so take a bounded number of each first (evenly())."""
    a = reads.select("strand_id", "read_no", "read")
    b = reads.select("strand_id", F.col("read_no").alias("other_no"), F.col("read").alias("other"))
    d = a.join(b, "strand_id").groupBy("strand_id", "read_no", "read").agg(F.sum(F.levenshtein("read", "other")).alias("d"), F.count("*").alias("n"))
    d = d.withColumn("length", F.lit(length)) if isinstance(length, int) else d.join(length.select("strand_id", "length"), "strand_id")
    best = F.min(F.struct(F.when(F.col("n") > 2, F.col("d")).otherwise(0).alias("d"), F.abs(F.length("read") - F.col("length")).alias("off"), "read_no", "read")).alias("b")
    return d.groupBy("strand_id").agg(best).select("strand_id", "b.read_no", "b.read")


def vote_table(drafts: DataFrame, ops: DataFrame) -> DataFrame:
    """(strand_id, pos, gap, symbol, n): what reads say of every place and gap of their draft.

    drafts (strand_id, draft, n_reads), ops (strand_id, read_no, tag, src_pos, dest_pos, letter) from drafts to reads. Places have gap false and votes for A, C, G, T or - (the read lacks
    it); a read without an edit there votes for the draft's letter. Gap pos stands before place pos (the last after the end) and has gap true and, for each read with more letters
    there, a vote for the first of them. Symbols without votes have no row.
    """
    said = _said(ops)
    away = said.where("not gap").groupBy("strand_id", "pos").agg(F.sum("n").alias("away"))
    places = drafts.select("strand_id", "n_reads", F.posexplode(F.split("draft", "")).alias("pos", "symbol")).where("symbol <> ''")
    stay = places.join(away, ["strand_id", "pos"], "left").select("strand_id", "pos", F.lit(False).alias("gap"), "symbol", (F.col("n_reads") - F.coalesce("away", F.lit(0))).cast("long").alias("n"))
    return stay.where("n > 0").unionByName(said)


def _said(ops: DataFrame) -> DataFrame:
    """(strand_id, pos, gap, symbol, n): the votes that edits are; of the letters that a read has more in one gap the first."""
    letter = F.when(F.col("tag") == "delete", F.lit("-")).otherwise(F.col("letter"))
    each = ops.groupBy("strand_id", "read_no", F.col("src_pos").cast("int").alias("pos"), (F.col("tag") == "insert").alias("gap")).agg(F.min_by(letter, "dest_pos").alias("symbol"))
    return each.groupBy("strand_id", "pos", "gap", "symbol").agg(F.count("*").alias("n"))


def _cells(drafts: DataFrame, ops: DataFrame) -> DataFrame:
    """(strand_id, pos, n_A, ..., n_del, i_A, ...), a row for each place or gap of drafts with edits, and the draft's own letter with its votes among them."""
    count = lambda gap, s: F.coalesce(F.sum(F.when((F.col("gap") == gap) & (F.col("symbol") == s), F.col("n"))), F.lit(0))
    votes_ = _said(ops).groupBy("strand_id", "pos").agg(*(count(False, s).alias(f"n_{s}") for s in BASES), count(False, "-").alias("n_del"), *(count(True, s).alias(f"i_{s}") for s in BASES))
    cells = votes_.join(drafts.select("strand_id", "draft", "n_reads"), "strand_id").withColumn("own", F.substring("draft", F.col("pos") + 1, F.lit(1)))
    stay = F.col("n_reads") - sum((F.col(f"n_{s}") for s in BASES), F.col("n_del"))
    return cells.select("strand_id", "pos", "own", "n_reads", *((F.col(f"n_{s}") + F.when(F.col("own") == s, stay).otherwise(0)).alias(f"n_{s}") for s in BASES), "n_del", *(f"i_{s}" for s in BASES))


def _most(prefix: str, first: Column | None = None) -> Column:
    """The letter with most votes; ties go to first where it is one of them, else by letter."""
    top = F.greatest(*(F.col(f"{prefix}{s}") for s in BASES))
    out = F.when(F.coalesce(F.element_at(F.create_map(*(x for s in BASES for x in (F.lit(s), F.col(f"{prefix}{s}")))), first) == top, F.lit(False)), first) if first is not None else F.when(F.lit(False), "")
    for s in BASES:
        out = out.when(F.col(f"{prefix}{s}") == top, s)
    return out


def rebuilt(drafts: DataFrame, ops: DataFrame) -> DataFrame:
    """(strand_id, rebuilt) of drafts that edits of their reads change.

    A place takes the letter with most votes (a tie keeps the draft's) and goes if more reads lack it than have that letter; a gap takes its most frequent first letter if more than half
    of the reads have letters there.
    """
    best = F.greatest(*(F.col(f"n_{s}") for s in BASES))
    place = F.when(F.col("own") == "", "").when(F.col("n_del") > best, "").otherwise(_most("n_", F.col("own")))
    more = F.when(2 * sum((F.col(f"i_{s}") for s in BASES), F.lit(0)) > F.col("n_reads"), _most("i_")).otherwise("")
    cells = _cells(drafts, ops).select("strand_id", "pos", F.concat(more, place).alias("now"), "own").where(F.col("now") != F.col("own"))
    changes = cells.groupBy("strand_id").agg(F.map_from_entries(F.collect_list(F.struct("pos", "now"))).alias("changes"))
    letters = F.transform(F.sequence(F.lit(0), F.length("draft")), lambda i: F.coalesce(F.element_at("changes", i), F.substring("draft", i + 1, F.lit(1))))
    return changes.join(drafts.select("strand_id", "draft"), "strand_id").select("strand_id", F.array_join(letters, "").alias("rebuilt"))


def fixed_lengths(drafts: DataFrame, ops: DataFrame) -> DataFrame:
    """(strand_id, fixed) of drafts (strand_id, draft, n_reads, length) that aren't as long as designed, by the votes of ops.

    Too long: the places that most reads lack go (then those with the least support, then the last). Too short: the gaps in which most reads have letters take their most frequent
    first letter (A where none has one; then the last gap), and the rest is filled with A. A row for each place of such a draft, which is as long as a strand.
    """
    off = drafts.where(F.length("draft") != F.col("length"))
    cells = _cells(off, ops).drop("own", "n_reads").withColumn("inserted", _most("i_"))
    counts = [f"{p}{s}" for p in ("n_", "i_") for s in BASES] + ["n_del"]
    at = off.withColumn("pos", F.explode(F.sequence(F.lit(0), F.length("draft")))).join(cells, ["strand_id", "pos"], "left").fillna(0, counts)
    own = F.substring("draft", F.col("pos") + 1, F.lit(1))
    edited = F.col("inserted").isNotNull()
    support = F.when(edited, F.greatest(*(F.col(f"n_{s}") for s in BASES))).otherwise(F.col("n_reads"))
    long_ = F.length("draft") > F.col("length")
    over = F.abs(F.length("draft") - F.col("length"))
    rank = F.row_number().over(Window.partitionBy("strand_id").orderBy(F.when(long_, -F.col("n_del")).otherwise(-(F.col("i_A") + F.col("i_C") + F.col("i_G") + F.col("i_T"))), F.when(long_, F.when(own == "", F.lit(1 << 40)).otherwise(support)).otherwise(0), F.desc("pos")))
    piece = F.when(long_, F.when((rank <= over) & (own != ""), "").otherwise(own)).otherwise(F.concat(F.when(rank <= over, F.coalesce("inserted", F.lit("A"))).otherwise(""), own))
    pieces = at.select("strand_id", "length", "pos", piece.alias("piece"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece"))), lambda x: x.piece), "")
    whole = pieces.groupBy("strand_id").agg(joined.alias("s"), F.first("length").alias("length"))
    return whole.select("strand_id", F.rpad("s", F.col("length"), F.lit("A")).alias("fixed"))


def _edits(drafts: DataFrame, reads: DataFrame) -> DataFrame:
    """Edits from drafts to those of their reads that differ from them, with the letter each brings."""
    pairs = drafts.select("strand_id", "draft").join(reads.select("strand_id", "read_no", "read"), "strand_id").where("draft <> read")
    letter = F.when(F.col("tag") != "delete", F.substring("read", F.col("dest_pos") + 1, F.lit(1)))
    return edit_operations(pairs, "draft", "read").select("strand_id", "read_no", "tag", "src_pos", "dest_pos", letter.alias("letter"))


def decode(strands: DataFrame, reads: DataFrame, rounds: int = 3, most: int = 16) -> DataFrame:
    """(strand_id, decoded, n_reads) for every one of strands (strand_id, length as designed); decoded is null where no read came. A staged table.

    Of each strand's reads at most so many, evenly spaced in their order, take part. The draft is their medoid; each round aligns the reads to it and rebuilds it by votes. Only
    strands whose draft a round has changed enter the next one; tables between rounds are written to the shared folder. What is settled is brought to its length by its last votes.
    """
    # few bytes of reads are much work to align, so they aren't gathered into few tasks by their size
    tasks = int(reads.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    r = written(evenly(reads.select("strand_id", "read_no", "read"), most).select(F.col("strand_id").cast("long"), "read_no", "read", "n").repartition(tasks, "strand_id"), "reads")
    counts = r.groupBy("strand_id").agg(F.max("n").alias("n_reads"), F.count("*").alias("used"))
    lengths = strands.select(F.col("strand_id").cast("long"), "length")
    first = medoids(r, lengths).join(counts, "strand_id").join(lengths, "strand_id")
    active = written(first.select("strand_id", F.col("read").alias("draft"), F.col("used").alias("n_reads"), "length"), "drafts")
    tables, settled, last = [r, active], [], []
    for k in range(rounds + 1):
        wanted = active if k < rounds else active.where(F.length("draft") != F.col("length"))  # votes of a last draft are for its length only
        ops = written(_edits(wanted, r), "edits")
        tables.append(ops)
        if k == rounds:
            settled.append(active)
            last.append(ops)
            break
        after = written(active.join(rebuilt(active, ops), "strand_id", "left").withColumn("changed", F.coalesce(F.col("rebuilt") != F.col("draft"), F.lit(False))), "rebuilt")
        tables.append(after)
        done = after.where("not changed").drop("rebuilt", "changed")
        settled.append(done)
        last.append(ops.join(done.where(F.length("draft") != F.col("length")).select("strand_id"), "strand_id", "left_semi"))
        active = after.where("changed").select("strand_id", F.col("rebuilt").alias("draft"), "n_reads", "length")
        if active.isEmpty():
            break
    drafts, ops = reduce(DataFrame.union, settled), reduce(DataFrame.unionByName, last)
    final = drafts.join(fixed_lengths(drafts, ops), "strand_id", "left").select("strand_id", F.coalesce("fixed", "draft").alias("decoded"))
    out = lengths.select("strand_id").join(final, "strand_id", "left").join(counts.select("strand_id", F.col("n_reads").cast("long").alias("n_reads")), "strand_id", "left")
    out = written(out.select("strand_id", "decoded", F.coalesce("n_reads", F.lit(0)).cast("long").alias("n_reads")), "decoded")
    for t in tables:
        discard(t)
    return out


def position_errors(pairs: DataFrame, by: list[str]) -> DataFrame:
    """(by, pos, rate): errors at each place (from 0) of the longest reference of a group, zeros among them, divided by the group's decoded strands; added up they are the mean distance.

    pairs (by, reference, decoded); a null decoded doesn't count. An insertion counts for the base it is before, one after the last base for that.
    """
    given = pairs.where(F.col("decoded").isNotNull())
    groups = given.groupBy(*by).agg(F.count("*").alias("n"), F.max(F.length("reference")).alias("longest"))
    ops = edit_operations(given.where("reference <> decoded").select(*by, "reference", "decoded"), "reference", "decoded")
    at = ops.groupBy(*by, F.greatest(F.lit(0), F.least("src_pos", F.length("reference") - 1)).alias("pos")).agg(F.count("*").alias("e"))
    places = groups.withColumn("pos", F.explode(F.sequence(F.lit(0), F.greatest(F.col("longest") - 1, F.lit(0)))))
    return places.join(at, [*by, "pos"], "left").select(*by, "pos", (F.coalesce("e", F.lit(0)) / F.col("n")).alias("rate"))


def evaluate(decoded: DataFrame, by: list[str]) -> DataFrame:
    """Metrics of decoded (by, reference, decoded, n_reads): no decoded strand, or no read, counts as wrong; distances are over decoded strands only."""
    right = F.coalesce((F.col("decoded") == F.col("reference")) & (F.col("n_reads") > 0), F.lit(False))
    return decoded.groupBy(*by).agg(
        F.count("*").alias("n"), F.round(F.avg(right.cast("double")), 9).alias("accuracy"), F.round(F.avg(F.levenshtein("reference", "decoded")), 9).alias("mean_distance"),
        F.round(F.avg((F.col("n_reads") == 0).cast("double")), 9).alias("dropout_rate"), F.round(F.avg("n_reads"), 9).alias("reads_per_strand"), F.round(F.avg(F.col("decoded").isNotNull().cast("double")), 9).alias("decoded_fraction"),
    )
