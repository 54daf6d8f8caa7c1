"""Queries whose result is wording: settings and what changed, effects of rules, trades, findings, steps of a search; splits and features that need no table of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.functions import strands as S
from strandlake.functions import wording as W
from strandlake.operators import experiments as E
from strandlake.plans.base import ORACLES, SQL_BENCH, benchmark_strands, query, table
from strandlake.plans.codec import _CRC32, _sql_bytes
from strandlake.plans.relational import _RATES, _TARGETS, rates
from strandlake.plans.statistics import paired_bootstrap

_SMALL = "CASE WHEN {0} >= 0.01 OR {0} = 0 THEN format('{{:.2f}}', {0}) ELSE format('{{:.2g}}', {0}) END"


@query("f30_setting_changes", f"""WITH s AS (SELECT p_partkey, p_size / 50.0::DOUBLE AS spare, CASE WHEN p_size % 5 > 0 THEN p_size % 4 + 2 END AS run, CASE WHEN p_partkey % 3 > 0 THEN 0.3::DOUBLE + (p_partkey % 4) * 0.05::DOUBLE END AS low,
CASE WHEN p_partkey % 6 <> 0 THEN 0.6::DOUBLE END AS high, CASE WHEN p_partkey % 10 > 0 THEN p_retailprice::DOUBLE / pow(10, p_partkey % 10) END AS risk FROM part),
t AS (SELECT p_partkey, format('{{:.0f}}%', spare * 100) AS spare, coalesce('risk ≤ ' || {_SMALL.format("risk")}, 'off') AS risk, coalesce(run::VARCHAR, 'off') AS run,
CASE WHEN low IS NULL AND high IS NULL THEN 'off' ELSE coalesce(format('{{:.0f}}', low * 100), '0') || ' to ' || coalesce(format('{{:.0f}}', high * 100), '100') || '%' END AS gc FROM s)
SELECT p_partkey, spare, risk, run, gc, concat_ws('; ', CASE WHEN spare <> '30%' THEN 'spare strands 30% → ' || spare END, CASE WHEN risk <> 'off' THEN 'learned risk filter on (' || risk || ')' END,
CASE WHEN run = 'off' THEN 'longest allowed letter run switched off' WHEN run <> '3' THEN 'longest allowed letter run 3 → ' || run END,
CASE WHEN gc = 'off' THEN 'allowed g+c share switched off' WHEN gc <> '40 to 60%' THEN 'allowed g+c share 40 to 60% → ' || gc END) AS changed FROM t""")
def setting_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings of each codec as text, and what differs from the default ones."""
    k, n = F.col("p_partkey"), F.col("p_size")
    low = F.when(k % 3 > 0, 0.3 + (k % 4) * 0.05)
    high = F.when(k % 6 != 0, 0.6)
    risk = F.when(k % 10 > 0, F.col("p_retailprice").cast("double") / F.pow(F.lit(10.0), k % 10))
    s = table(spark, sf_dir, "part").select(k, W.share_setting(n / 50.0).alias("spare"), W.risk_setting(risk).alias("risk"), W.whole_setting(F.when(n % 5 > 0, n % 4 + 2)).alias("run"), W.gc_setting(low, high).alias("gc"))
    old = {"spare": ("spare strands", W.share_setting(F.lit(0.3))), "risk": ("learned risk filter", F.lit("off")), "run": ("longest allowed letter run", F.lit("3")), "gc": ("allowed g+c share", W.gc_setting(F.lit(0.4), F.lit(0.6)))}
    return s.withColumn("changed", F.array_join(W.changes([(label, was, F.col(c)) for c, (label, was) in old.items()]), "; "))


#: A rule for each codec, one of each form.
_RULES = {"AUTOMOBILE": "max_homopolymer=3", "BUILDING": "gc 0.4-0.6", "FURNITURE": "redundancy 0.3 vs tuned", "HOUSEHOLD": "tuned codec vs default", "MACHINERY": "seed order"}
_READS = "CASE WHEN {0} IS NULL THEN 'target not met' ELSE format('{{:.1f}}', {0}) END"


@query("f30_rule_effects", f"""WITH {_RATES}, m AS (SELECT codec, min(CASE WHEN rate >= 0.34 AND coverage % 2 = 1 THEN coverage + 0.5 END) AS a, min(CASE WHEN rate >= 0.34 AND coverage % 2 = 0 THEN coverage END) AS b,
avg(CASE WHEN coverage % 2 = 1 THEN rate END) AS x, avg(CASE WHEN coverage % 2 = 0 THEN rate END) AS y FROM rates GROUP BY 1)
SELECT codec, CASE codec WHEN 'AUTOMOBILE' THEN 'No run of more than 3 identical letters' WHEN 'BUILDING' THEN 'G+C share between 40% and 60%' WHEN 'FURNITURE' THEN 'Fixed 30% spare strands' WHEN 'HOUSEHOLD' THEN 'Tuned codec vs default' ELSE 'seed order' END AS rule,
CASE WHEN codec = 'HOUSEHOLD' THEN 'Reads needed at ' || format('{{:.2f}}', x) || ' bits per base: default rules ' || {_READS.format("a")} || ', tuned codec ' || {_READS.format("b")} ELSE
CASE WHEN codec = 'FURNITURE' THEN 'With the tuned value instead: ' ELSE 'Switching this rule off: ' END || CASE WHEN abs(a - b) < 0.05 THEN 'reads needed stay at ' || format('{{:.1f}}', a) ELSE 'reads needed ' || {_READS.format("a")} || ' to ' || {_READS.format("b")} END
|| CASE WHEN abs(x - y) >= 0.005 THEN ', bits per base ' || format('{{:.2f}}', x) || ' to ' || format('{{:.2f}}', y) ELSE '' END END AS effect FROM m""")
def rule_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule costs and brings, in words."""
    met, odd = F.when(F.col("rate") >= 0.34, F.col("coverage")), F.col("coverage") % 2 == 1
    m = rates(spark, sf_dir).groupBy("codec").agg(F.min(F.when(odd, met + 0.5)).alias("a"), F.min(F.when(~odd, met)).alias("b"), F.avg(F.when(odd, F.col("rate"))).alias("x"), F.avg(F.when(~odd, F.col("rate"))).alias("y"))
    rule = F.element_at(F.create_map(*(F.lit(v) for pair in _RULES.items() for v in pair)), F.col("codec"))
    return m.select("codec", W.rule_name(rule).alias("rule"), W.rule_effect(rule, F.col("a"), F.col("b"), F.col("x"), F.col("y")).alias("effect"))


@query("e20_trades", f"""WITH {_RATES}, c AS (SELECT codec, target, min(CASE WHEN rate >= target THEN coverage END) AS reads, avg(rate) AS bits FROM rates, (SELECT unnest({_TARGETS}::DOUBLE[]) AS target) GROUP BY 1, 2),
j AS (SELECT c.codec, c.target, c.reads AS r, b.reads AS q, c.bits AS x, b.bits AS y, c.bits / b.bits - 1 AS rel FROM c JOIN c b ON b.codec = 'BUILDING' AND b.target = c.target WHERE c.codec <> 'BUILDING'),
k AS (SELECT *, CASE WHEN r IS NULL THEN false WHEN q IS NULL THEN true WHEN abs(r - q) >= 0.05 THEN r < q END AS fewer, CASE WHEN abs(rel) >= 0.01 THEN rel > 0 END AS denser FROM j)
SELECT codec, target, 'On target ' || format('{{:.2f}}', target) || ', ' || codec || ' ' || CASE WHEN r IS NULL THEN 'never reaches the recovery target' WHEN q IS NULL THEN 'reaches the target at ' || format('{{:.1f}}', r) || ' reads where BUILDING never does'
WHEN abs(r - q) < 0.05 THEN 'needs the same ' || format('{{:.1f}}', r) || ' reads as BUILDING' ELSE 'needs ' || format('{{:.1f}}', r) || ' reads instead of ' || format('{{:.1f}}', q) END
|| CASE WHEN coalesce(fewer <> denser, false) THEN ' but ' ELSE ' and ' END || CASE WHEN denser IS NULL THEN 'at the same density' ELSE 'stores ' || format('{{:.0f}}', abs(rel) * 100) || CASE WHEN denser THEN '% more' ELSE '% less' END
|| ' per letter (' || format('{{:.2f}}', x) || ' vs ' || format('{{:.2f}}', y) || ' bits per base)' END || '.' AS sentence FROM k""")
def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each codec against the default one at several targets, reads and density in one sentence."""
    r = rates(spark, sf_dir).withColumn("target", F.explode(F.array(*map(F.lit, _TARGETS))))
    c = r.groupBy("codec", "target").agg(F.min(F.when(F.col("rate") >= F.col("target"), F.col("coverage"))).alias("reads"), F.avg("rate").alias("bits"))
    b = c.where("codec = 'BUILDING'").select("target", F.col("reads").alias("q"), F.col("bits").alias("y"))
    channel = F.concat(F.lit("target "), W.fixed(F.col("target"), 2))
    sentence = W.trade(channel, F.col("codec"), F.col("reads"), F.col("bits"), F.lit("BUILDING"), F.col("q"), F.col("y"))
    return c.where("codec <> 'BUILDING'").join(b, "target").select("codec", "target", sentence.alias("sentence"))


@query("e11_paired_finding", f"""SELECT mean, low, high, CASE WHEN low <= 0 AND high >= 0 THEN 'No measurable difference in strand failures (95% CI ' || format('{{:+.2f}}', low * 100) || ' to ' || format('{{:+.2f}}', high * 100) || ' points).'
WHEN high < 0 THEN 'The learned scorer cuts strand failures by ' || format('{{:.2f}}', -mean * 100) || ' points (95% CI ' || format('{{:.2f}}', -high * 100) || ' to ' || format('{{:.2f}}', -low * 100) || ' points).'
ELSE 'The learned scorer raises strand failures by ' || format('{{:.2f}}', mean * 100) || ' points (95% CI ' || format('{{:.2f}}', low * 100) || ' to ' || format('{{:.2f}}', high * 100) || ' points).' END AS finding FROM ({ORACLES["a27_paired_bootstrap"]})""")
def paired_finding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The difference of trials paired by seed, its interval, and what they say."""
    return paired_bootstrap(spark, sf_dir).withColumn("finding", W.paired_finding(F.col("mean"), F.col("low"), F.col("high")))


@query("e20_steps", """WITH s AS (SELECT o_custkey, o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN ' tier1' WHEN 1 THEN 'alternation 0' WHEN 2 THEN 'alternation ' || (1 + o_orderkey % 3) WHEN 3 THEN '' ELSE o_orderpriority END AS stage FROM orders),
n AS (SELECT *, count(*) FILTER (WHERE regexp_full_match(trim(stage), 'alternation\\s*[1-9]\\d*')) OVER (PARTITION BY o_custkey) AS later FROM s)
SELECT o_orderkey, CASE WHEN trim(stage) = '' THEN NULL WHEN trim(stage) = 'tier1' THEN 'C: rules audited' WHEN stage = 'alternation 0' THEN 'D: + learned' WHEN stage LIKE 'alternation %' THEN CASE WHEN later <= 1 THEN 'E: loop' ELSE 'E: loop ' || substr(stage, 13) END ELSE stage END AS step FROM n""")
def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the steps of each run; later alternations are numbered where a run has several."""
    k = F.col("o_orderkey")
    stage = F.when(k % 5 == 0, " tier1").when(k % 5 == 1, "alternation 0").when(k % 5 == 2, F.concat(F.lit("alternation "), 1 + k % 3)).when(k % 5 == 3, "").otherwise(F.col("o_orderpriority"))
    s = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", stage.alias("stage"))
    later = F.count_if(F.trim("stage").rlike(r"^alternation\s*[1-9]\d*$")).over(Window.partitionBy("o_custkey"))
    return s.withColumn("later", later).select("o_orderkey", W.stage_name(F.col("stage"), F.col("later")).alias("step"))


_WIDTH = 100


@query("f33_masked_channels", f"""WITH {SQL_BENCH}, p AS (SELECT strand_id, strand, length(strand) AS n, unnest(range(0, {_WIDTH})) AS pos FROM strands)
SELECT strand_id, pos::INT AS pos, (substr(strand, (pos + 1)::INT, 1) = 'A')::INT AS a, (substr(strand, (pos + 1)::INT, 1) = 'C')::INT AS c, (substr(strand, (pos + 1)::INT, 1) = 'G')::INT AS g, (substr(strand, (pos + 1)::INT, 1) = 'T')::INT AS t,
(pos < n)::INT AS mask, round(CASE WHEN pos < n THEN pos / greatest(1, n - 1)::DOUBLE ELSE 0 END, 9) AS place FROM p""")
def masked_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six channels of each place of a fixed width: the letter, whether the strand reaches there, and the place along it; longer strands are cut, shorter ones end in zeros."""
    x = benchmark_strands(spark, sf_dir).select("strand_id", F.explode(S.channels(F.col("strand"), _WIDTH)).alias("x"))
    return x.select("strand_id", "x.pos", "x.a", "x.c", "x.g", "x.t", "x.mask", F.round("x.place", 9).alias("place"))


@query("f13_levenshtein_cutoff", f"""WITH {SQL_BENCH} SELECT a.strand_id, least(levenshtein(a.strand, b.strand), floor(0.6::DOUBLE * length(a.strand)) + 1)::INT AS distance FROM strands a JOIN strands b ON b.item_id = a.item_id AND b.chunk = a.chunk + 1""")
def levenshtein_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edit distance between neighbouring strands of a text up to six tenths of the length; anything above counts as one more."""
    b = benchmark_strands(spark, sf_dir)
    n = b.select("item_id", (F.col("chunk") - 1).alias("chunk"), F.col("strand").alias("other"))
    return b.join(n, ["item_id", "chunk"]).select("strand_id", S.distance_within(F.col("strand"), F.col("other"), F.floor(0.6 * F.length("strand")).cast("int")).alias("distance"))


@query("p6_reference_split", f"""WITH {SQL_BENCH}, {_CRC32}, h AS (SELECT item_id, hex(encode(strand)) AS h FROM strands),
c AS (SELECT item_id, xor(list_reduce(list_prepend(4294967295, {_sql_bytes("h")}), lambda c, b: xor(c >> 8, crc32.t[xor(c & 255, b) + 1])), 4294967295)::BIGINT AS crc FROM h, crc32)
SELECT item_id, count(*) FILTER (WHERE crc % 5 = 0) AS held_out, count(*) FILTER (WHERE crc % 5 <> 0) AS train FROM c GROUP BY 1""")
def reference_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strands held out by themselves, so that a strand is on one side in every file that has it."""
    held = E.held_out_strand(F.col("strand"))
    return benchmark_strands(spark, sf_dir).groupBy("item_id").agg(F.count_if(held).alias("held_out"), F.count_if(~held).alias("train"))
