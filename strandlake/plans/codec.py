"""Queries on the codec."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions import frames as R
from strandlake.functions.strands import max_run_length, uniform
from strandlake.operators import fountain as L
from strandlake.plans.base import query, sql_uniform, table


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("file_id"), F.encode("text", "UTF-8").alias("content"))


@query("c1_w8_soliton", """WITH k AS (SELECT n_regionkey AS r, count(*) * 20.0 AS k FROM nation GROUP BY 1), p AS (SELECT r, k, 0.1 * ln(k / 0.5) * sqrt(k) AS s FROM k), d AS (SELECT r, k, s, least(k, greatest(1, round_even(k / s, 0))) AS peak, unnest(range(1, k::BIGINT + 1)) AS d FROM p),
w AS (SELECT r, d, CASE WHEN d = 1 THEN 1 / k ELSE 1.0::DOUBLE / (d * (d - 1)) END + CASE WHEN d < peak THEN s / (d * k) WHEN d = peak THEN greatest(0, s * ln(s / 0.5) / k) ELSE 0 END AS w FROM d)
SELECT r, d::INT AS d, round(sum(w) OVER (PARTITION BY r ORDER BY d) / sum(w) OVER (PARTITION BY r), 9) AS cdf FROM w""")
def soliton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative degree distribution for as many chunks as each region has nations, times twenty."""
    k = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("r")).agg((F.count("*") * 20).cast("int").alias("n"))
    cdf = L.soliton_table(k.select("n").distinct())
    return k.join(cdf, "n").select("r", F.posexplode("cdf").alias("d", "cdf")).select("r", (F.col("d") + 1).alias("d"), "cdf")


@query("j7_chunk_xor", """SELECT l_orderkey, bit_xor(s_suppkey * 2654435761 + l_partkey) AS value, count(*) AS degree FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1""")
def chunk_xor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exclusive or of the chunks that each seed joins, on the graph of orders and their lines."""
    e = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return e.groupBy("l_orderkey").agg(F.bit_xor(F.col("s_suppkey") * 2654435761 + F.col("l_partkey")).alias("value"), F.count("*").alias("degree"))


@query("a35_droplet_degrees", """WITH e AS (SELECT l_orderkey, count(DISTINCT l_partkey) AS degree FROM lineitem GROUP BY 1), c AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1)
SELECT (SELECT round(avg(degree), 9) FROM e) AS mean_degree, (SELECT min(n) FROM c) AS least_cover, (SELECT count(*) FROM c) AS chunks""")
def degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    e = rows.groupBy("l_orderkey").agg(F.count_distinct("l_partkey").alias("degree")).agg(F.round(F.avg("degree"), 9).alias("mean_degree"))
    return e.crossJoin(F.broadcast(rows.groupBy("l_partkey").agg(F.count("*").alias("n")).agg(F.min("n").alias("least_cover"), F.count("*").alias("chunks"))))  # one row each


@query("c6_peel", """WITH RECURSIVE e0 AS (SELECT DISTINCT l_orderkey AS eq, l_partkey AS chunk FROM lineitem),
s AS (SELECT 1 AS round, (SELECT list({'eq': eq, 'chunk': chunk}) FROM e0) AS edges, (SELECT coalesce(list(DISTINCT chunk), []) FROM (SELECT min(chunk) AS chunk FROM e0 GROUP BY eq HAVING count(*) = 1)) AS found
UNION ALL SELECT round + 1, list_filter(edges, lambda e: NOT list_contains(found, e.chunk)), (SELECT coalesce(list(DISTINCT chunk), []) FROM (SELECT min(x.e.chunk) AS chunk FROM (SELECT unnest(list_filter(edges, lambda e: NOT list_contains(found, e.chunk))) AS e) x GROUP BY x.e.eq HAVING count(*) = 1))
FROM s WHERE len(found) > 0) SELECT unnest(found) AS chunk, round::INT AS round FROM s""")
def peeled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peeling until nothing comes free: equations are orders, chunks the parts of their lines."""
    return L.peel(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("eq"), F.col("l_partkey").alias("chunk")))


@query("u2_first_valid_copy", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS k FROM lineitem WHERE l_discount > 0) SELECT l_partkey, l_orderkey, l_linenumber FROM r WHERE k = 1""")
def first_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first valid copy of each seed."""
    t = table(spark, sf_dir, "lineitem").where("l_discount > 0").groupBy("l_partkey").agg(F.min(F.struct("l_orderkey", "l_linenumber")).alias("m"))
    return t.select("l_partkey", "m.l_orderkey", "m.l_linenumber")


@query("c3_encode")
def encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strands of every benchmark text; all keep the rules, and together they give it back."""
    s = L.encode(_files(spark, sf_dir), max_homopolymer=3, gc_min=0.4, gc_max=0.6)
    return s.select("file_id", "slot", "seed", "strand", max_run_length(F.col("strand")).alias("max_run"))


@query("c5_e1_recover", "SELECT item_id AS file_id, true AS exact FROM benchmark")
def recovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each text is had back exactly, when it is encoded and a tenth of its strands is lost: it isn't where those left, or none, don't determine its chunks."""
    files = _files(spark, sf_dir)
    s = L.encode(files, redundancy=1.5)
    kept = s.where(uniform(F.col("file_id"), F.col("slot"), "lost", 3) >= 0.1)
    return files.withColumnRenamed("content", "original").join(L.recover(kept), "file_id", "left").select("file_id", F.coalesce(F.col("content") == F.col("original"), F.lit(False)).alias("exact"))


_CDF = """d AS (SELECT k, 0.1 * ln(k / 0.5) * sqrt(k) AS s, least(k, greatest(1, round_even(k / s, 0))) AS peak, unnest(range(1, k::BIGINT + 1)) AS d FROM (SELECT unnest([20.0::DOUBLE, 30, 40, 50]) AS k)),
w AS (SELECT k, d, CASE WHEN d = 1 THEN 1 / k ELSE 1.0::DOUBLE / (d * (d - 1)) END + CASE WHEN d < peak THEN s / (d * k) WHEN d = peak THEN greatest(0, s * ln(s / 0.5) / k) ELSE 0 END AS w FROM d),
cdf AS (SELECT k::INT AS n, list(c ORDER BY d) AS cdf FROM (SELECT k, d, round(sum(w) OVER (PARTITION BY k ORDER BY d) / sum(w) OVER (PARTITION BY k), 9) AS c FROM w) GROUP BY 1)"""


@query("c2_neighbours", f"""WITH RECURSIVE {_CDF}, seeds AS (SELECT l_orderkey * 8 + l_linenumber AS seed, 20 + 10 * (l_linenumber % 4) AS n FROM lineitem),
degrees AS (SELECT seed, s.n::INT AS n, least(s.n, len(list_filter(cdf, lambda x: x < {sql_uniform("seed", "s.n", "'degree'")})) + 1)::INT AS degree FROM seeds s JOIN cdf USING (n)),
drawn AS (SELECT seed, n, degree, n - degree AS j, []::INT[] AS chosen FROM degrees
UNION ALL SELECT seed, n, degree, j + 1, list_append(chosen, CASE WHEN list_contains(chosen, t) THEN j ELSE t END) FROM (SELECT *, floor({sql_uniform("seed", "n", "j")} * (j + 1))::INT AS t FROM drawn WHERE j < n))
SELECT seed, degree, array_to_string(list_sort(chosen), ',') AS chunks FROM drawn WHERE j = n""")
def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks that every line's seed joins, in files of 20 to 50 chunks."""
    sizes = L.soliton_table(spark.createDataFrame([(n,) for n in (20, 30, 40, 50)], "n int"))
    seeds = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seed"), (20 + 10 * (F.col("l_linenumber") % 4)).alias("n"))
    s = seeds.join(F.broadcast(sizes), "n")  # four rows
    s = s.select("seed", R.neighbours(F.col("seed"), F.col("n"), F.col("cdf")).alias("chunks"))
    return s.select("seed", F.size("chunks").alias("degree"), F.array_join(F.col("chunks").cast("array<string>"), ",").alias("chunks"))


_CRC16 = """crc16 AS MATERIALIZED (SELECT list(v ORDER BY b) AS t FROM (SELECT b, list_reduce(list_prepend(b << 8, range(8)), lambda r, i: xor((r << 1) & 65535, CASE WHEN r & 32768 > 0 THEN 4129 ELSE 0 END)) AS v FROM (SELECT unnest(range(256)) AS b)))"""
_CRC32 = """crc32 AS MATERIALIZED (SELECT list(v ORDER BY b) AS t FROM (SELECT b, list_reduce(list_prepend(b, range(8)), lambda r, i: xor(r >> 1, CASE WHEN r & 1 > 0 THEN 3988292384 ELSE 0 END)) AS v FROM (SELECT unnest(range(256)) AS b)))"""


def _sql_bytes(hex_: str) -> str:
    return f"list_transform(range(length({hex_}) // 2), lambda i: ('0x' || substr({hex_}, (2 * i + 1)::INT, 2))::BIGINT)"


def _sql_crc16(hex_: str) -> str:
    return f"list_reduce(list_prepend(65535, {_sql_bytes(hex_)}), lambda c, b: xor((c << 8) & 65535, crc16.t[xor(c >> 8, b) + 1]))"


@query("f9_f10_checksums", f"""WITH {_CRC16}, {_CRC32}, h AS (SELECT conv_id, turn, hex(encode(coalesce(text, ''))) AS h FROM conversations)
SELECT conv_id, turn, ({_sql_crc16("h")})::INT AS crc16, xor(list_reduce(list_prepend(4294967295, {_sql_bytes("h")}), lambda c, b: xor(c >> 8, crc32.t[xor(c & 255, b) + 1])), 4294967295)::BIGINT AS crc32 FROM h, crc16, crc32""")
def checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both checksums of every turn of a conversation, whole."""
    data = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", R.crc16(data).alias("crc16"), F.crc32(data).alias("crc32"))


_SIZE, _SEEDS = 16, 1 << 20


def _sql_hex_of(bases: str) -> str:
    return f"array_to_string(list_transform(range(length({bases}) // 2), lambda i: substr('0123456789abcdef', (strpos('ACGT', substr({bases}, (2 * i + 1)::INT, 1)) - 1) * 4 + strpos('ACGT', substr({bases}, (2 * i + 2)::INT, 1)), 1)), '')"


def _sql_bases_of(hex_: str) -> str:
    return f"array_to_string(list_transform(range(length({hex_})), lambda i: substr('ACGT', (('0x' || substr({hex_}, (i + 1)::INT, 1))::INT >> 2) + 1, 1) || substr('ACGT', (('0x' || substr({hex_}, (i + 1)::INT, 1))::INT & 3) + 1, 1)), '')"


def _sql_xor(a: str, b: str) -> str:
    return f"array_to_string(list_transform(range(length({a})), lambda i: printf('%x', xor(('0x' || substr({a}, (i + 1)::INT, 1))::INT, ('0x' || substr({b}, (i + 1)::INT, 1))::INT))), '')"


@query("f8_p8_parse_reasons", f"""WITH {_CRC16}, k AS (SELECT l_orderkey * 8 + l_linenumber AS seed, md5(l_orderkey || '|' || l_partkey || '|' || l_linenumber) AS value, printf('%08x', l_orderkey * 8 + l_linenumber) AS head FROM lineitem),
m AS (SELECT *, printf('%04x', {_sql_crc16("(head || value)")}) || value AS rest, substr(md5(seed || '|0') || md5(seed || '|1'), 1, 36) AS mask FROM k, crc16),
s AS (SELECT seed, {_sql_bases_of("head")} || {_sql_bases_of("x")} AS strand FROM (SELECT *, {_sql_xor("rest", "mask")} AS x FROM m)),
v AS (SELECT seed, strand, {sql_uniform("seed", "'damage'")} AS u, 1 + floor({sql_uniform("seed", "'place'")} * 88)::INT AS i FROM s),
g AS (SELECT seed, CASE WHEN u < 0.1 THEN substr(strand, 1, length(strand) - 1) WHEN u < 0.2 THEN substr(strand, 1, i - 1) || 'N' || substr(strand, i + 1) WHEN u < 0.5 THEN substr(strand, 1, i - 1) || translate(substr(strand, i, 1), 'ACGT', 'CGTA') || substr(strand, i + 1) ELSE strand END AS strand FROM v),
p AS (SELECT seed, strand, length(strand) = 88 AND translate(strand, 'ACGT', '') = '' AS fine, {_sql_hex_of("strand")} AS h FROM g),
q AS (SELECT *, CASE WHEN fine THEN ('0x' || substr(h, 1, 8))::BIGINT END AS found FROM p), r AS (SELECT *, CASE WHEN fine THEN {_sql_xor("substr(h, 9)", "substr(md5(found || '|0') || md5(found || '|1'), 1, 36)")} END AS x FROM q),
t AS (SELECT seed, found, x, CASE WHEN length(strand) <> 88 THEN 'length' WHEN NOT fine THEN 'letter' WHEN found >= {_SEEDS} THEN 'seed' WHEN {_sql_crc16("(substr(h, 1, 8) || substr(x, 5))")} <> ('0x' || substr(x, 1, 4))::BIGINT THEN 'checksum' ELSE 'none' END AS reason FROM r, crc16)
SELECT reason, count(*) AS n, coalesce(sum(CASE WHEN reason = 'none' THEN found END), 0)::BIGINT AS seeds, coalesce(max(CASE WHEN reason = 'none' THEN substr(x, 5) END), '') AS greatest_value, count(*) FILTER (reason = 'none' AND found <> seed) AS wrong FROM t GROUP BY 1""")
def parse_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line as a strand (its seed and a value of sixteen bytes), half of them damaged, and parsed: why strands are rejected."""
    value = F.md5(F.concat_ws("|", "l_orderkey", "l_partkey", "l_linenumber").cast("binary"))
    s = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seed"), value.alias("value"))
    s = s.select("seed", R.framed(F.col("seed"), F.col("value"), _SIZE).alias("strand"))
    u, i = uniform(F.col("seed"), "damage"), (1 + F.floor(uniform(F.col("seed"), "place") * 88)).cast("int")
    put = lambda c: F.concat(F.substring("strand", F.lit(1), i - 1), c, F.substring("strand", i + 1, F.length("strand")))
    damaged = F.when(u < 0.1, F.substring("strand", F.lit(1), F.length("strand") - 1)).when(u < 0.2, put(F.lit("N"))).when(u < 0.5, put(F.translate(F.substring("strand", i, F.lit(1)), "ACGT", "CGTA"))).otherwise(F.col("strand"))
    p = s.select("seed", damaged.alias("strand")).select("seed", R.parsed(F.col("strand"), _SIZE, _SEEDS).alias("p")).select("seed", F.coalesce("p.reason", F.lit("none")).alias("reason"), F.col("p.seed").alias("found"), "p.value")
    return p.groupBy("reason").agg(F.count("*").alias("n"), F.coalesce(F.sum("found"), F.lit(0)).alias("seeds"), F.coalesce(F.max("value"), F.lit("")).alias("greatest_value"), F.count_if(F.col("found") != F.col("seed")).alias("wrong"))
