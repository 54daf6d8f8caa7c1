"""Queries on the channel and on consensus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators import channel as X
from strandlake.operators import consensus as C
from strandlake.operators.editing import dense_classes
from strandlake.operators.errors import shared_errors
from strandlake.operators.ordering import numbered
from strandlake.plans.base import SQL_BENCH, SQL_GC, benchmark_strands, query, sql_uniform

SEED, MEAN, LENGTH = 7, 6.0, 112


def _u(*keys: str) -> str:
    return sql_uniform(*keys)


SQL_READS = f"""{SQL_BENCH}, counted AS (SELECT strand_id, strand, CASE WHEN {_u("strand_id", "'lost'", "7")} < least(0.99, greatest(0, 0.02 + 0.05 * abs({SQL_GC} - 0.5) / 0.1)) THEN 0
ELSE floor(ln(1 - {_u("strand_id", "'reads'", "7")}) / ln({1 - 1 / 7.0!r}))::INT END AS n_reads FROM strands),
reads AS (SELECT strand_id, strand, unnest(range(1, n_reads + 1)) AS read_no FROM counted)"""


def _mutated(sub: float, ins: float, dele: float) -> str:
    return f"""sites AS (SELECT strand_id, read_no, i, substr(strand, i, 1) AS b, {_u("strand_id", "read_no", "i", "7")} AS u, {_u("strand_id", "read_no", "i", "'base'", "7")} AS v
FROM (SELECT *, unnest(range(1, length(strand) + 1)) AS i FROM reads)),
mutated AS (SELECT strand_id, read_no, string_agg(CASE WHEN u < {dele} THEN '' WHEN u < {dele} + {ins} THEN substr('ACGT', floor(v * 4)::INT + 1, 1) || b
WHEN u < {dele} + {ins} + {sub} THEN substr('ACGT', (strpos('ACGT', b) - 1 + 1 + floor(v * 3)::INT) % 4 + 1, 1) ELSE b END, '' ORDER BY i) AS read FROM sites GROUP BY 1, 2)"""


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.reads_of(benchmark_strands(spark, sf_dir).select("strand_id", "strand"), MEAN, SEED, 0.02, 0.05)


@query("x1_x2_j2_coverage", f"WITH {SQL_READS} SELECT strand_id, count(*) AS n_reads, max(read_no)::INT AS last_read FROM reads GROUP BY 1")
def read_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads(spark, sf_dir).groupBy("strand_id").agg(F.count("*").alias("n_reads"), F.max("read_no").alias("last_read"))


@query("x4_x5_simulate", f"WITH {SQL_READS}, {_mutated(0.02, 0.01, 0.015)} SELECT strand_id, read_no::INT AS read_no, read FROM mutated")
def simulated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.mutate(reads(spark, sf_dir), 0.02, 0.01, 0.015, SEED).select("strand_id", "read_no", "read")


@query("x8_simulate_sized", f"WITH {SQL_BENCH}, reads AS (SELECT strand_id, strand, unnest(range(1, 4 + strand_id % 3)) AS read_no FROM strands), {_mutated(0.05, 0.0, 0.0)} SELECT strand_id, count(*) AS n, sum(length(read))::BIGINT AS bases FROM mutated GROUP BY 1")
def sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact cluster sizes."""
    s = benchmark_strands(spark, sf_dir).select("strand_id", "strand", F.explode(F.sequence(F.lit(1), (3 + F.col("strand_id") % 3).cast("int"))).alias("read_no"))
    return X.mutate(s, 0.05, 0.0, 0.0, SEED).groupBy("strand_id").agg(F.count("*").alias("n"), F.sum(F.length("read")).alias("bases"))


@query("x11_first_reads", f"""WITH {SQL_READS}, r AS (SELECT strand_id, read_no, row_number() OVER (PARTITION BY strand_id ORDER BY {_u("strand_id", "read_no", "'pick'", "7")}, read_no) AS k FROM reads) SELECT strand_id, read_no::INT AS read_no FROM r WHERE k <= 4""")
def picked_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.first_reads(reads(spark, sf_dir), 4, SEED).select("strand_id", "read_no")


_DENSE = f"dense AS (SELECT row_number() OVER (ORDER BY strand_id) - 1 AS strand_id, strand FROM strands), n AS (SELECT count(*) AS n FROM dense), reads AS (SELECT strand_id, strand, unnest(range(1, 4)) AS read_no FROM dense)"


@query("j3_misassigned_reads", f"""WITH {SQL_BENCH}, {_DENSE}, s AS (SELECT strand_id, read_no, CASE WHEN {_u("strand_id", "read_no", "'wrong'", "7")} < 0.1 THEN (strand_id + 1 + floor({_u("strand_id", "read_no", "'shift'", "7")} * (n - 1))::BIGINT) % n ELSE strand_id END AS source_id FROM reads, n)
SELECT s.strand_id, read_no::INT AS read_no, source_id::BIGINT AS source_id, d.strand FROM s JOIN dense d ON d.strand_id = s.source_id""")
def misassigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    dense = numbered(benchmark_strands(spark, sf_dir).select("strand_id", "strand"), ["strand_id"]).select(F.col("i").cast("long").alias("strand_id"), "strand")
    r = dense.withColumn("read_no", F.explode(F.sequence(F.lit(1), F.lit(3))))
    return X.misassigned(r, dense, 0.1, SEED).select("strand_id", "read_no", F.col("source_id").cast("long").alias("source_id"), "strand")


@query("j4_chimeras", f"""WITH {SQL_BENCH}, {_DENSE}, c AS (SELECT strand_id, strand, (strand_id + 1) % n AS other, floor({_u("strand_id", "'cut'", "7")} * length(strand))::INT AS cut FROM dense, n)
SELECT c.strand_id, substr(c.strand, 1, cut) || substr(o.strand, cut + 1) AS strand FROM c JOIN dense o ON o.strand_id = c.other""")
def chimeras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A strand's own prefix with the suffix of the next one, cut at the same place."""
    from strandlake.functions.strands import uniform

    dense = numbered(benchmark_strands(spark, sf_dir).select("strand_id", "strand"), ["strand_id"]).select(F.col("i").cast("long").alias("strand_id"), "strand")
    n = dense.agg(F.count("*").alias("n"))
    c = dense.crossJoin(F.broadcast(n)).withColumn("other", (F.col("strand_id") + 1) % F.col("n")).withColumn("cut", F.floor(uniform(F.col("strand_id"), "cut", SEED) * F.length("strand")).cast("int"))  # n is one row
    o = dense.select(F.col("strand_id").alias("other"), F.col("strand").alias("suffix"))
    return c.join(o, "other").select("strand_id", F.concat(F.substring("strand", F.lit(1), F.col("cut")), F.substring("suffix", F.col("cut") + 1, F.length("suffix"))).alias("strand"))


_SUBSTITUTED = f"{SQL_READS}, {_mutated(0.08, 0.0, 0.0)}"


def substituted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.mutate(reads(spark, sf_dir), 0.08, 0.0, 0.0, SEED)


_VOTES = "votes AS (SELECT strand_id, pos, substr(read, pos, 1) AS symbol, count(*) AS n FROM (SELECT *, unnest(range(1, length(read) + 1)) AS pos FROM mutated) GROUP BY 1, 2, 3)"


@query("a8_votes", f"WITH {_SUBSTITUTED}, {_VOTES} SELECT strand_id, pos::INT AS pos, symbol, n FROM votes")
def vote_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.votes(substituted(spark, sf_dir))


@query("a9_d3_plurality", f"""WITH {_SUBSTITUTED}, {_VOTES}, drafts AS (SELECT strand_id, arg_min(read, read_no) AS draft FROM mutated GROUP BY 1), best AS (SELECT v.*, row_number() OVER (PARTITION BY v.strand_id, pos ORDER BY n DESC, (symbol = substr(draft, pos, 1)) DESC, symbol) AS k FROM votes v JOIN drafts USING (strand_id))
SELECT strand_id, string_agg(symbol, '' ORDER BY pos) AS consensus FROM best WHERE k = 1 GROUP BY 1""")
def consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plurality of the reads of each strand; a tie keeps the letter of the first read."""
    r = substituted(spark, sf_dir)
    return C.plurality(C.votes(r), r.groupBy("strand_id").agg(F.min_by("read", "read_no").alias("draft")))


def _sql_ops(sub: float, ins: float, dele: float) -> str:
    return f"""{SQL_READS}, sites AS (SELECT strand_id, read_no, i, substr(strand, i, 1) AS b, {_u("strand_id", "read_no", "i", "7")} AS u, {_u("strand_id", "read_no", "i", "'base'", "7")} AS v
FROM (SELECT *, unnest(range(1, length(strand) + 1)) AS i FROM reads)),
ops AS (SELECT strand_id, read_no, CASE WHEN u < {dele} THEN 'delete' WHEN u < {dele} + {ins} THEN 'insert' ELSE 'replace' END AS tag, i - 1 AS pos, i - 1 AS dest,
CASE WHEN u < {dele} THEN '-' WHEN u < {dele} + {ins} THEN substr('ACGT', floor(v * 4)::INT + 1, 1) ELSE substr('ACGT', (strpos('ACGT', b) + floor(v * 3)::INT) % 4 + 1, 1) END AS letter FROM sites WHERE u < {dele} + {ins} + {sub}
UNION ALL SELECT strand_id, read_no, 'insert', i - 1, i, substr('ACGT', floor(v * 16)::INT + 1, 1) FROM sites WHERE u >= {dele} AND u < {dele} + {ins} AND v < 0.25)"""


_SUB, _INS, _DEL = 0.1, 0.2, 0.2
_EDITED = f"""{_sql_ops(_SUB, _INS, _DEL)},
drafts AS (SELECT strand_id, any_value(strand) AS draft, count(*) AS n_reads FROM reads GROUP BY 1),
said AS (SELECT strand_id, pos, gap, symbol, count(*) AS n FROM (SELECT strand_id, read_no, pos, tag = 'insert' AS gap, arg_min(letter, dest) AS symbol FROM ops GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3, 4),
stay AS (SELECT p.strand_id, p.pos, substr(p.draft, p.pos::INT + 1, 1) AS symbol, n_reads - coalesce(away, 0) AS n FROM (SELECT *, unnest(range(length(draft))) AS pos FROM drafts) p LEFT JOIN (SELECT strand_id, pos, sum(n) AS away FROM said WHERE NOT gap GROUP BY 1, 2) a ON a.strand_id = p.strand_id AND a.pos = p.pos)"""
_ALL_VOTES = f"{_EDITED}, votes AS (SELECT strand_id, pos, false AS gap, symbol, n FROM stay WHERE n > 0 UNION ALL SELECT * FROM said)"
_LETTERS = ", ".join(f"coalesce(sum(n) FILTER (symbol = '{s}' AND {'' if g else 'NOT '}gap), 0) AS {'i' if g else 'n'}_{s}" for g in (False, True) for s in "ACGT")
_MOST = "CASE greatest(i_A, i_C, i_G, i_T) WHEN i_A THEN 'A' WHEN i_C THEN 'C' WHEN i_G THEN 'G' ELSE 'T' END"
_CELLS = f"""{_ALL_VOTES}, cells AS (SELECT p.strand_id, p.pos, p.draft, p.n_reads, substr(p.draft, p.pos::INT + 1, 1) AS own, {_LETTERS}, coalesce(sum(n) FILTER (symbol = '-'), 0) AS n_del
FROM (SELECT *, unnest(range(length(draft) + 1)) AS pos FROM drafts) p LEFT JOIN votes v ON v.strand_id = p.strand_id AND v.pos = p.pos GROUP BY ALL)"""


def _drafts_and_edits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Strands as drafts, with the numbers of their reads, and the edits that lead from them to the reads, insertions of two letters among them."""
    r = reads(spark, sf_dir)
    return r.groupBy("strand_id").agg(F.first("strand").alias("draft"), F.count("*").alias("n_reads")), X.edits(r, _SUB, _INS, _DEL, SEED)


@query("a8_indel_votes", f"WITH {_ALL_VOTES} SELECT strand_id, pos::INT AS pos, gap, symbol, n FROM votes")
def indel_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes of aligned reads: five symbols a place, and the first letter that is more in a gap."""
    return C.vote_table(*_drafts_and_edits(spark, sf_dir))


@query("a9_rebuilt", f"""WITH {_CELLS}, pieces AS (SELECT strand_id, pos, draft, CASE WHEN 2 * (i_A + i_C + i_G + i_T) > n_reads THEN {_MOST} ELSE '' END || CASE WHEN own = '' OR n_del > greatest(n_A, n_C, n_G, n_T) THEN ''
WHEN greatest(n_A, n_C, n_G, n_T) = CASE own WHEN 'A' THEN n_A WHEN 'C' THEN n_C WHEN 'G' THEN n_G ELSE n_T END THEN own ELSE CASE greatest(n_A, n_C, n_G, n_T) WHEN n_A THEN 'A' WHEN n_C THEN 'C' WHEN n_G THEN 'G' ELSE 'T' END END AS piece FROM cells)
SELECT strand_id, string_agg(piece, '' ORDER BY pos) AS rebuilt FROM pieces GROUP BY strand_id, draft""")
def rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every draft after one round of votes: a tie keeps its letter, a place goes if more reads lack it than have the best letter, a gap needs more than half of the reads."""
    drafts, ops = _drafts_and_edits(spark, sf_dir)
    return drafts.join(C.rebuilt(drafts, ops), "strand_id", "left").select("strand_id", F.coalesce("rebuilt", "draft").alias("rebuilt"))


@query("t5_fixed_lengths", f"""WITH {_CELLS}, off AS (SELECT *, length(draft) + strand_id % 5 - 2 AS designed, length(draft) > designed AS long FROM cells WHERE strand_id % 5 <> 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY strand_id ORDER BY CASE WHEN long THEN -n_del ELSE -(i_A + i_C + i_G + i_T) END, CASE WHEN NOT long THEN 0 WHEN own = '' THEN 1000000 ELSE greatest(n_A, n_C, n_G, n_T) END, pos DESC) AS k FROM off),
pieces AS (SELECT strand_id, pos, designed, CASE WHEN long THEN CASE WHEN k <= length(draft) - designed AND own <> '' THEN '' ELSE own END ELSE CASE WHEN k > designed - length(draft) THEN '' WHEN i_A + i_C + i_G + i_T = 0 THEN 'A' ELSE {_MOST} END || own END AS piece FROM ranked)
SELECT strand_id, rpad(string_agg(piece, '' ORDER BY pos), any_value(designed)::INT, 'A') AS fixed FROM pieces GROUP BY 1""")
def fixed_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts brought to designed lengths up to two letters off, by the votes of their reads."""
    drafts, ops = _drafts_and_edits(spark, sf_dir)
    return C.fixed_lengths(drafts.withColumn("length", (F.length("draft") + F.col("strand_id") % 5 - 2).cast("int")), ops)


@query("a1_evaluate", f"""WITH {_SUBSTITUTED}, {_VOTES}, best AS (SELECT *, row_number() OVER (PARTITION BY strand_id, pos ORDER BY n DESC, symbol) AS k FROM votes),
d AS (SELECT strand_id, string_agg(symbol, '' ORDER BY pos) AS decoded FROM best WHERE k = 1 GROUP BY 1), e AS (SELECT item_id % 4 AS part, s.strand AS reference, d.decoded, c.n_reads FROM strands s JOIN counted c USING (strand_id) LEFT JOIN d USING (strand_id))
SELECT part, count(*) AS n, round(avg(CASE WHEN decoded = reference AND n_reads > 0 THEN 1.0 ELSE 0 END), 9) AS accuracy, round(avg(levenshtein(reference, decoded)), 9) AS mean_distance, round(avg(CASE WHEN n_reads = 0 THEN 1.0 ELSE 0 END), 9) AS dropout_rate,
round(avg(n_reads), 9) AS reads_per_strand, round(avg(CASE WHEN decoded IS NOT NULL THEN 1.0 ELSE 0 END), 9) AS decoded_fraction FROM e GROUP BY 1""")
def evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of the plurality consensus; strands that no read covers count as wrong."""
    s = benchmark_strands(spark, sf_dir).select("strand_id", (F.col("item_id") % 4).alias("part"), F.col("strand").alias("reference"))
    n = reads(spark, sf_dir).groupBy("strand_id").agg(F.count("*").alias("n_reads"))
    d = C.plurality(C.votes(substituted(spark, sf_dir))).withColumnRenamed("consensus", "decoded")
    return C.evaluate(s.join(n, "strand_id", "left").join(d, "strand_id", "left").withColumn("n_reads", F.coalesce("n_reads", F.lit(0))), ["part"])


_NOISY = f"{SQL_READS}, {_mutated(0.02, 0.01, 0.015)}"


@query("t3_j6_medoids", f"""WITH {_NOISY}, placed AS (SELECT *, row_number() OVER (PARTITION BY strand_id ORDER BY read_no) - 1 AS i, count(*) OVER (PARTITION BY strand_id) AS all_reads FROM mutated),
few AS (SELECT strand_id, read_no, read FROM placed WHERE all_reads <= 16 OR list_contains(list_transform(range(16), lambda k: round_even(k * (all_reads - 1) / 15.0::DOUBLE, 0)::BIGINT), i)), d AS (SELECT a.strand_id, a.read_no, a.read, sum(levenshtein(a.read, b.read)) AS d, count(*) AS n FROM few a JOIN few b USING (strand_id) GROUP BY 1, 2, 3),
k AS (SELECT *, row_number() OVER (PARTITION BY strand_id ORDER BY CASE WHEN n > 2 THEN d ELSE 0 END, abs(length(read) - 112), read_no) AS k FROM d) SELECT strand_id, read_no::INT AS read_no, read FROM k WHERE k = 1""")
def medoid_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The medoid of each strand's reads, of which at most sixteen, evenly spaced, are compared."""
    few = C.evenly(X.mutate(reads(spark, sf_dir), 0.02, 0.01, 0.015, SEED).select("strand_id", "read_no", "read"))
    return C.medoids(few, LENGTH)


@query("f14_a2_edit_operations", f"WITH {_NOISY} SELECT strand_id, read_no::INT AS read_no, levenshtein(strand, read)::BIGINT AS n_edits FROM mutated JOIN strands USING (strand_id) WHERE levenshtein(strand, read) > 0")
def edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of edits in the script from each strand to its reads; it is the edit distance."""
    pairs = X.mutate(reads(spark, sf_dir), 0.02, 0.01, 0.015, SEED).select("strand_id", "read_no", "strand", "read")
    return C.edit_operations(pairs, "strand", "read").groupBy("strand_id", "read_no").agg(F.count("*").alias("n_edits"))


@query("a2_position_errors")
def position_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors at each position of the reference by kind, for all reads; an insertion after the end counts for the last base."""
    pairs = X.mutate(reads(spark, sf_dir), 0.02, 0.01, 0.015, SEED).select("strand", "read")
    ops = C.edit_operations(pairs, "strand", "read")
    pos = F.least(F.col("src_pos"), F.length("strand") - 1) + 1
    return ops.groupBy(pos.alias("pos"), "tag").agg(F.count("*").alias("n"))


@query("d1_d2_reconstruct")
def reconstructed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strands rebuilt from noisy reads by alignment and majority, each to its own length."""
    s = benchmark_strands(spark, sf_dir)
    spread = s.select("strand_id", "strand").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "strand_id")
    noisy = X.mutate(X.reads_of(spread, MEAN, SEED, 0.02, 0.05), 0.02, 0.01, 0.015, SEED)
    d = C.decode(s.select("strand_id", F.length("strand").alias("length")), noisy)
    return C.evaluate(d.join(s.select("strand_id", F.col("strand").alias("reference"), (F.col("item_id") % 4).alias("part")), "strand_id"), ["part"])


@query("a2_dense_errors", f"""WITH {_NOISY}, d AS (SELECT item_id % 4 AS part, s.strand, levenshtein(s.strand, m.read) AS d FROM mutated m JOIN strands s USING (strand_id))
SELECT part, max(length(strand))::BIGINT AS positions, count(*)::BIGINT AS decoded, round(sum(d)::DOUBLE / count(*), 6) AS mean_distance, round(sum(d)::DOUBLE / count(*), 6) AS total FROM d GROUP BY 1""")
def dense_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors by position of every read, zeros among them, divided by the number of reads: added up they are the mean distance."""
    s = benchmark_strands(spark, sf_dir).select("strand_id", (F.col("item_id") % 4).alias("part"))
    pairs = X.mutate(reads(spark, sf_dir), 0.02, 0.01, 0.015, SEED).join(s, "strand_id").select("part", F.col("strand").alias("reference"), F.col("read").alias("decoded"))
    p = C.position_errors(pairs, ["part"])
    d = pairs.groupBy("part").agg(F.count("*").alias("decoded"), F.round(F.avg(F.levenshtein("reference", "decoded")), 6).alias("mean_distance"))
    return p.groupBy("part").agg(F.count("*").alias("positions"), F.round(F.sum("rate"), 6).alias("total")).join(d, "part")


@query("d5_edit_classes", f"""WITH {_sql_ops(_SUB, _INS, _DEL)}, met AS (SELECT strand_id, read_no, pos, max(CASE WHEN tag <> 'insert' THEN letter END) AS said, arg_min(letter, dest) FILTER (tag = 'insert') AS before FROM ops GROUP BY 1, 2, 3),
places AS (SELECT strand_id, read_no, length(strand) AS n, unnest(range(length(strand) + 1)) AS pos FROM reads)
SELECT CASE WHEN p.pos < n THEN coalesce(said, '=') ELSE 'end' END AS class, coalesce(before, '') AS before, count(*) AS n FROM places p LEFT JOIN met m ON m.strand_id = p.strand_id AND m.read_no = p.read_no AND m.pos = p.pos GROUP BY 1, 2""")
def edit_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A class for every place of every strand, by what the channel did to each of its reads: kept, another letter, or gone; and what came in before it."""
    r = reads(spark, sf_dir)
    dense = dense_classes(r.select("strand_id", "read_no", "strand"), X.edits(r, _SUB, _INS, _DEL, SEED), ["strand_id", "read_no"], "strand")
    return dense.groupBy(F.coalesce("class", F.lit("end")).alias("class"), F.coalesce("before", F.lit("")).alias("before")).agg(F.count("*").alias("n"))


@query("p12_a39_shared_by_kind", f"""WITH {_sql_ops(0.04, 0.03, 0.04)}, e AS (SELECT strand_id, read_no, length(strand) AS len, (SELECT count(*) FROM ops o WHERE o.strand_id = r.strand_id AND o.read_no = r.read_no) AS n FROM reads r),
used AS (SELECT strand_id, read_no, len FROM e WHERE n <= floor(0.3 * len)), s AS (SELECT strand_id, any_value(len) AS len, count(*) AS reads FROM used GROUP BY 1 HAVING count(*) >= 10),
hits AS (SELECT tag, o.strand_id, least(o.pos, len - 1) AS pos, count(DISTINCT read_no) AS n FROM ops o JOIN used u USING (strand_id, read_no) GROUP BY 1, 2, 3),
hot AS (SELECT tag, count(*) FILTER (n >= 0.2 * reads) AS hot, sum(n) AS errors, sum(CASE WHEN n >= 0.2 * reads THEN n ELSE 0 END) AS shared FROM hits JOIN s USING (strand_id) GROUP BY 1)
SELECT tag, hot, (SELECT sum(len) FROM s)::BIGINT AS places, round(hot / (SELECT sum(len) FROM s), 9) AS share, round(shared / errors, 9) AS of_errors FROM hot""")
def shared_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places at which a fifth of at least ten reads have the same kind of error, and the share of that kind's errors that are there."""
    r = reads(spark, sf_dir)
    return shared_errors(r.select("strand_id", "read_no", "strand"), X.edits(r, 0.04, 0.03, 0.04, SEED))
