"""Consensus against a plain version of the same rules, strand by strand."""

import random

from pyspark.sql import functions as F

from strandlake.operators import consensus as C
from strandlake.operators import editing as E


def script(a, b):
    """Fewest edits, one table at a time."""
    n, m = len(a), len(b)
    cost = [[i + j if not i or not j else 0 for j in range(m + 1)] for i in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            cost[i][j] = min(cost[i - 1][j] + 1, cost[i][j - 1] + 1, cost[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
    out, i, j = [], n, m
    while i or j:
        if i and j and cost[i][j] == cost[i - 1][j - 1] + (a[i - 1] != b[j - 1]):
            i, j = i - 1, j - 1
            out += [("replace", i, j)] if a[i] != b[j] else []
        elif i and cost[i][j] == cost[i - 1][j] + 1:
            i -= 1
            out.append(("delete", i, j))
        else:
            j -= 1
            out.append(("insert", i, j))
    return out[::-1]


def tally(draft, reads):
    at, before = [dict.fromkeys("ACGT-", 0) for _ in draft], [dict.fromkeys("ACGT", 0) for _ in range(len(draft) + 1)]
    for r in reads:
        said, came = list(draft), {}
        for tag, s, d in script(draft, r):
            if tag == "insert":
                came.setdefault(s, r[d])
            else:
                said[s] = r[d] if tag == "replace" else "-"
        for i, c in enumerate(said):
            at[i][c] += 1
        for s, c in came.items():
            before[s][c] += 1
    return at, before


def most(v):
    return max("ACGT", key=lambda c: (v[c], -ord(c)))


def plain(reads, length, rounds=3, limit=16):
    if not reads:
        return None
    if len(reads) > limit:
        reads = [reads[round(i * (len(reads) - 1) / (limit - 1))] for i in range(limit)]
    total = [sum(len(script(x, y)) for y in reads) if len(reads) > 2 else 0 for x in reads]
    draft = reads[min(range(len(reads)), key=lambda i: (total[i], abs(len(reads[i]) - length), i))]
    at, before = tally(draft, reads)
    for _ in range(rounds):
        out = []
        for g in range(len(draft) + 1):
            if 2 * sum(before[g].values()) > len(reads):
                out.append(most(before[g]))
            if g < len(draft):
                best = max(at[g][c] for c in "ACGT")
                if at[g]["-"] <= best:
                    out.append(draft[g] if at[g][draft[g]] == best else most(at[g]))
        if "".join(out) == draft:
            break
        draft = "".join(out)
        at, before = tally(draft, reads)
    if len(draft) > length:
        gone = sorted(range(len(draft)), key=lambda i: (-at[i]["-"], max(at[i][c] for c in "ACGT"), -i))[: len(draft) - length]
        return "".join(c for i, c in enumerate(draft) if i not in gone)
    gaps = sorted(range(len(draft) + 1), key=lambda g: (-sum(before[g].values()), -g))[: length - len(draft)]
    return "".join((most(before[g]) if g in gaps else "") + draft[g : g + 1] for g in range(len(draft) + 1)).ljust(length, "A")[:length]


def noisy(rng, s, rate):
    out = []
    for c in s:
        u = rng.random()
        if u < rate:
            continue
        out.append(rng.choice("ACGT") + c if u < 2 * rate else rng.choice("ACGT") if u < 3 * rate else c)
    return "".join(out)


def test_scripts_of_many_pairs_equal_one_table_at_a_time():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("ACGT") for _ in range(rng.randint(0, 12)))
    a, b = [word() for _ in range(1500)], [word() for _ in range(1500)]
    got = [[] for _ in a]
    for row, tag, s, d in zip(*E.edit_scripts(a, b)):
        got[row].append((E.TAGS[tag], s, d))
    assert got == [script(x, y) for x, y in zip(a, b)] and len(E.edit_scripts([], [])[0]) == 0


def test_decode_equals_plain(spark):
    rng = random.Random(7)
    right = ["".join(rng.choice("ACGT") for _ in range(rng.choice((30, 30, 12, 3)))) for _ in range(120)]
    reads = [[noisy(rng, s, rng.choice((0.02, 0.1, 0.25))) for _ in range(rng.choice((0, 1, 2, 3, 5, 8, 20)))] for s in right]
    strands = spark.createDataFrame([(i, len(s) + rng.choice((0, 0, 0, -1, 2))) for i, s in enumerate(right)], "strand_id long, length int")
    length = {r.strand_id: r.length for r in strands.collect()}
    rows = spark.createDataFrame([(i, k, x) for i, r in enumerate(reads) for k, x in enumerate(r)], "strand_id long, read_no int, read string").repartition(5)
    got = {r.strand_id: r for r in C.decode(strands, rows).collect()}
    for i, r in enumerate(reads):
        assert got[i].decoded == plain(r, length[i]) and got[i].n_reads == len(r), (i, r, got[i])


def test_indels_of_few_reads_are_outvoted(spark):
    rng = random.Random(2)
    right = "".join(rng.choice("ACGT") for _ in range(110))
    swap = lambda i, c, d: right[:i] + (c if right[i] != c else d) + right[i + 1 :]
    lacks, more = right[:50] + right[51:], right[:20] + ("A" if right[20] != "A" else "C") + right[20:]
    reads = [lacks, more, right, swap(80, "G", "T"), lacks, more, swap(80, "G", "T")]
    df = spark.createDataFrame([(1, k, x) for k, x in enumerate(reads)] + [(2, 0, ""), (3, 0, "ACGTAC")], "strand_id long, read_no int, read string")
    got = {r.strand_id: r.decoded for r in C.decode(spark.createDataFrame([(1, 110), (2, 3), (3, 4)], "strand_id long, length int"), df).collect()}
    assert got[1] == right and got[2] == "AAA" and len(got[3]) == 4


def test_dense_classes_cover_every_place(spark):
    pairs = spark.createDataFrame([(1, "ACGT", "AGGTT"), (2, "ACGT", "ACGT"), (3, "AC", "TTAC"), (4, "", "G")], "id int, a string, b string")
    letter = F.when(F.col("tag") != "delete", F.substring("b", F.col("dest_pos") + 1, F.lit(1)))
    rows = E.dense_classes(pairs, E.edit_operations(pairs, "a", "b").withColumn("letter", letter), ["id"], "a").orderBy("id", "pos").collect()
    got = {i: ["".join(r["class"] or "" for r in rows if r.id == i), [r.before for r in rows if r.id == i]] for i in (1, 2, 3, 4)}
    assert got[1][0] == "=G==" and got[1][1].count("T") == 1 and got[2] == ["====", [None] * 5] and got[3] == ["==", ["T", None, None]] and got[4] == ["", ["G"]]
