import random
import tempfile

from pyspark.sql import functions as F

from strandlake.functions import strands as S
from strandlake.operators import consensus as C
from strandlake.operators import fountain as L
from strandlake.sources import payloads as P


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def test_strand_functions(spark):
    lit = lambda s: F.lit(s).cast("string")
    assert one(spark, S.max_run_length(lit("ACGTTTTA"))) == 4
    assert one(spark, S.max_run_length(lit(""))) == 0 and one(spark, S.max_run_length(lit(None))) is None
    assert one(spark, S.gc_fraction(lit("GGCA"))) == 0.75 and one(spark, S.gc_fraction(lit(""))) == 0
    assert one(spark, S.reverse_complement(lit("AACG"))) == "CGTT"
    assert one(spark, S.codes(lit("ACGTN"))) == [0, 1, 2, 3, -1]
    assert one(spark, S.bases_to_hex(S.hex_to_bases(lit("0fa9")))) == "0fa9"
    rules = [one(spark, S.passes_rules(lit(s))) for s in ("ACGTACGTAC", "AAAAACGCGC", "ATATATATAT", "")]
    assert rules == [True, False, False, True]
    assert one(spark, S.pack_marks(F.array(F.struct(F.lit(11).alias("pos"), F.lit("e").alias("kind")), F.struct(F.lit(3).alias("pos"), F.lit("x").alias("kind"))))) == "3x11e"
    assert one(spark, S.subsample(F.sequence(F.lit(0), F.lit(9)), 4)) == [0, 3, 6, 9]


def test_edit_scripts_are_shortest(spark):
    rng = random.Random(1)
    rows = [("".join(rng.choice("ACGT") for _ in range(rng.randint(0, 12))), "".join(rng.choice("ACGT") for _ in range(rng.randint(0, 12)))) for _ in range(200)]
    df = spark.createDataFrame([(i, a, b, len(C.edit_script(a, b))) for i, (a, b) in enumerate(rows)], "i long, a string, b string, n int")
    assert df.where("levenshtein(a, b) <> n").count() == 0
    assert C.edit_script("ACGT", "ACTGT") == [("insert", 2, 2)]


def test_decode_to_each_strands_length(spark):
    rng = random.Random(5)
    right = ["".join(rng.choice("ACGT") for _ in range(n)) for n in (112, 40, 2)]
    strands = spark.createDataFrame([(i, len(x)) for i, x in enumerate(right)] + [(3, 8)], "strand_id long, length int")
    reads = spark.createDataFrame([(i, k, x) for i, x in enumerate(right) for k in range(1, 4)] + [(1, 4, right[1][:-1])], "strand_id long, read_no int, read string")
    got = {r.strand_id: (r.decoded, r.n_reads) for r in C.decode(strands, reads).collect()}
    assert got == {0: (right[0], 3), 1: (right[1], 4), 2: (right[2], 3), 3: (None, 0)}


def test_reconstruct_covers_every_strand(spark, sf_dir):
    from strandlake.plans import channel
    from strandlake.plans.base import benchmark_strands

    few = spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").limit(4)
    folder = tempfile.mkdtemp(prefix="strandlake-tests-")
    few.write.parquet(f"{folder}/benchmark.parquet")
    assert sum(r.n for r in channel.reconstructed(spark, folder).collect()) == benchmark_strands(spark, folder).count()


def test_evaluate(spark):
    df = spark.createDataFrame([(0, "ACGT", "ACGT", 1), (0, "TTGA", "TTGA", 2), (1, "ACGT", None, 0), (1, "AAAA", "AAAT", 3)], "part int, reference string, decoded string, n_reads int")
    r = {x.part: x for x in C.evaluate(df, ["part"]).collect()}
    assert r[0].accuracy == 1 and r[0].reads_per_strand == 1.5
    assert r[1].accuracy == 0 and r[1].dropout_rate == 0.5 and r[1].mean_distance == 1 and r[1].decoded_fraction == 0.5


def test_fountain_round_trip(spark):
    rng = random.Random(3)
    files = [(i, bytes(rng.randbytes(n))) for i, n in enumerate((0, 1, 7, 21, 300, 2000))]
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in files], "file_id int, content binary")
    strands = L.encode(df, redundancy=1.5).cache()
    got = {r.file_id: bytes(r.content) for r in L.recover(strands).collect()}
    assert got == dict(files)
    few = strands.where(F.col("slot") < 2)
    assert all(r.content is None for r in L.recover(few).where("file_id = 5").collect())
    s = strands.first().strand
    assert L.from_strand(s, 20) is not None
    assert L.from_strand(("A" if s[9] != "A" else "C").join((s[:9], s[10:])), 20) is None
    assert L.from_strand("N" * len(s), 20) is None and L.from_strand(None, 20) is None


def test_fountain_strands_keep_the_rules(spark):
    rng = random.Random(4)
    files = [(i, bytes(rng.randbytes(n))) for i, n in enumerate((0, 21, 900, 3000))]
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in files], "file_id int, content binary")
    strands = L.encode(df, redundancy=1.5, max_homopolymer=3, gc_min=0.4, gc_max=0.6).cache()
    bad = strands.where(~S.passes_rules(F.col("strand")))
    n = strands.count()
    assert bad.count() == 0
    assert n == strands.select("file_id", "n_chunks").distinct().agg(F.sum(F.ceil(F.col("n_chunks") * 2.5))).first()[0] == strands.select("file_id", "slot").distinct().count() == strands.select("file_id", "seed").distinct().count()
    assert {r.file_id: bytes(r.content) for r in L.recover(strands).collect()} == dict(files)
    assert L.redundant([s for s in range(4000) if L.chunks_of_seed(s, 3) == [1]][:5], 3) == [1, 2]
    most = L.MOST_TRIES
    try:
        L.MOST_TRIES = 20
        L.encode(df.where("file_id = 1"), max_homopolymer=0)
    except ValueError as e:
        assert "too strict" in str(e)
    else:
        raise AssertionError("rules that no strand keeps were taken")
    finally:
        L.MOST_TRIES = most


def test_soliton_ends_at_one():
    w = L.soliton_weights(50)
    assert w[-1] == 1 and all(a <= b for a, b in zip(w, w[1:]))


def test_cluster_readers(spark, tmp_path):
    (tmp_path / "centers.txt").write_text("ACGT\nTTTT\nGGGG\n")
    (tmp_path / "clusters.txt").write_text("=====\nACG\nACGT\n=====\n=====\nGGG\n")
    r = P.read_delimited_clusters(spark, str(tmp_path / "centers.txt"), str(tmp_path / "clusters.txt")).orderBy("cluster", "read_no").collect()
    assert [(x.cluster, x.reference, x.read) for x in r] == [(0, "ACGT", "ACG"), (0, "ACGT", "ACGT"), (1, "TTTT", None), (2, "GGGG", "GGG")]
    (tmp_path / "d.txt").write_text("ACGT\n****\nACG\nACGT\n\n\nTTTT\n****\n\n\n")
    r = P.read_starred_clusters(spark, str(tmp_path / "d.txt")).orderBy("reference", "read_no").collect()
    assert [(x.reference, x.read) for x in r] == [("ACGT", "ACG"), ("ACGT", "ACGT"), ("TTTT", None)]


def test_profiles(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"name": "a", "sub_rate": 0.01}')
    assert P.read_profiles(spark, str(tmp_path / "a.json")).first().sub_rate == 0.01
    (tmp_path / "b.json").write_text('{"name": "b", "colour": 1}')
    try:
        P.read_profiles(spark, str(tmp_path / "b.json"))
    except ValueError as e:
        assert "colour" in str(e)
    else:
        raise AssertionError("an unknown field was taken")


def test_sniff_kind(spark):
    rows = [(bytearray(b"\x89PNG\r\n"), "png"), (bytearray(b"\xff\xd8\xff\xe0"), "jpeg"), (bytearray(b"hello"), "text"), (bytearray(b"\xff\x00\xfe"), "binary")]
    df = spark.createDataFrame(rows, "c binary, kind string")
    assert df.where(P.sniff_kind(F.col("c")) != F.col("kind")).count() == 0
