"""Near-duplicate documents by bottom-k sketches of one hash function.

Every text becomes the set of its word shingles, hashed once to 64 bits. A sketch is the k smallest hashes of a set. Inverted lists
of retained hashes give overlaps between sketches; the share of the union's sketch that both hold estimates the Jaccard similarity;
pairs that pass are confirmed on their whole sets.

Equal sets are one class, so copies never make pairs. Lists of up to SHORT_LIST classes give all their pairs. Longer lists (a passage
that many documents share, or a family of thousands of near copies) don't: classes of which too few retained hashes are on long
lists cannot link through those alone and leave them; the others are compared with a few leaders of their lists, round by round,
until most of a list is one component, and what is left outside then meets all members of long lists that the prefix and position bounds allow. Links inside
a component that is already known need no check, so a family costs a number of checks that grows with its size and not with its square.

Misses: two sets of similarity 0.8 share fewer than NEEDED of POSTED retained hashes with a probability of about 1e-7, and have an
estimate below LEAST from SKETCH retained hashes with one of about 1e-6.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import connected_components, stage, unstage
from strandlake.llm.shingles import set_digest, shingle_sets

#: Retained hashes of a sketch; of these, the smallest that go to inverted lists; the share of these that linked sets have in common at
#: least; and the least estimate of a similarity of 0.8. For other thresholds the last two scale with it.
SKETCH, POSTED, NEEDED, LEAST = 64, 32, 0.4, 0.55
#: Lists up to this length give all pairs.
SHORT_LIST = 40
#: Rounds of leaders for long lists, at most; leaders of a list in each; and how many members of long lists hold a rare hash at most.
ROUNDS, TRIES, FEW = 2, 3, 64


def _marks(docs: DataFrame, words: int, k: int) -> DataFrame:
    """doc_id, n_shingles, the set's digest and its sketch, for each row."""

    def run(batches):
        from strandlake.llm.common import slices

        for whole in batches:
            for b in slices(whole, "text"):
                sets = shingle_sets(b.column("text").to_pylist(), words)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_digest(s) for s in sets], pa.binary()), pa.array([s[:k] for s in sets], pa.list_(pa.int64()))],
                    names=["doc_id", "n_shingles", "digest", "sketch"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, digest binary, sketch array<long>")


def _sets(docs: DataFrame, needed: DataFrame, words: int) -> DataFrame:
    """digest and whole set of the classes in needed (digest, rep), hashed anew from their texts."""

    def run(batches):
        from strandlake.llm.common import slices

        for whole in batches:
            for b in slices(whole, "text"):
                for wanted, s in zip(b.column("digest").to_pylist(), shingle_sets(b.column("text").to_pylist(), words)):
                    if set_digest(s) == wanted:  # a doc_id may stand on several rows
                        yield pa.RecordBatch.from_arrays([pa.array([wanted], pa.binary()), pa.array([s], pa.list_(pa.int64()))], names=["digest", "members"])

    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(needed, "rep")
    return texts.mapInArrow(run, "digest binary, members array<long>")


def _possible(n: Column, u: Column, m: Column, w: Column, percent: int) -> Column:
    """Whether sets of n and m hashes, u and w of them nobody else's, can be as similar as asked."""
    return 100 * F.least(n - u, m - w) >= percent * (u + w + F.greatest(n - u, m - w))


def _estimate(x: Column, y: Column, k: int) -> Column:
    """Similarity by two sketches: the share of the union's sketch that both hold."""
    union = F.slice(F.array_sort(F.array_union(x, y)), 1, k)
    return F.size(F.array_intersect(F.array_intersect(x, y), union)) / F.size(union)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int, k: int) -> DataFrame:
    """Links among pairs (a_digest, b_digest and others): estimate from the sketches first, then the whole sets."""
    kept = [c for c in pairs.columns if not c.endswith("_digest")]
    left = sets.select(F.col("digest").alias("a_digest"), F.col("members").alias("x"))
    right = sets.select(F.col("digest").alias("b_digest"), F.col("members").alias("y"))
    both = pairs.join(left, "a_digest").join(right, "b_digest")
    inter = F.size(F.array_intersect("x", "y"))
    return both.where(_estimate(F.slice("x", 1, k), F.slice("y", 1, k), k) >= LEAST * percent / 80).select(*kept, F.size("x").alias("nx"), F.size("y").alias("ny"), inter.alias("i")).where(100 * F.col("i") >= percent * (F.col("nx") + F.col("ny") - F.col("i"))).select(*kept)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, sketch: int = SKETCH) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text; other columns are not read).

    Links: similarity of at least percent / 100. component_id is the smallest doc_id reachable, kept marks it. Null and empty texts
    have no shingles and link with nothing; equal texts link, however many there are; long texts count whole; a doc_id on several rows is one node that has all
    their links (each row is returned); a null doc_id links with nothing, has a null component_id and is kept. An empty table gives no rows. The result is a staged table.
    """
    temporary = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        temporary.append(stage(df, name))
        return temporary[-1]

    marks = keep(_marks(docs, words, sketch), "marks")
    of_sets = marks.where("n_shingles > 0 and doc_id is not null").groupBy("digest")
    classes = keep(of_sets.agg(F.min("doc_id").alias("rep"), F.any_value("n_shingles").alias("n"), F.any_value("sketch").alias("sketch")), "classes")
    reps = classes.select("digest", "rep")
    least = F.lit(NEEDED * percent / 80)
    kept = F.slice("sketch", 1, POSTED)
    posts = classes.select("digest", "rep", "n", F.size(kept).alias("k"), F.explode(kept).alias("v"))
    # the counts are a table of their own, so that Spark can split a list of very many classes in the join
    counts = keep(posts.groupBy("v").agg(F.count("*").alias("c")).where("c > 1"), "counts")
    listed = posts.join(counts, "v").groupBy("digest", "rep", "n", "k").agg(F.sort_array(F.collect_list(F.struct("v", "c"))).alias("l"))  # at most POSTED
    listed = listed.withColumn("vs", F.transform(F.filter("l", lambda x: x.c > SHORT_LIST), lambda x: x.v)).withColumn("n_long", F.size("vs"))
    listed = keep(listed, "listed")

    # pairs that short lists give, with what they share there and may share on long ones
    short = listed.select("digest", "rep", "n", "k", "n_long", F.explode(F.filter("l", lambda x: x.c <= SHORT_LIST)).alias("x")).select("x.v", "digest", "rep", "n", "k", "n_long")
    a, b = (short.select("v", *(F.col(c).alias(f"{s}_{c}") for c in ("digest", "rep", "n", "k", "n_long"))) for s in "ab")
    fits = (100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n")) & (F.col("a_digest") < F.col("b_digest"))
    pairs = a.join(b, "v").where(fits).groupBy("a_digest", "b_digest", "a_rep", "b_rep", F.least("a_k", "b_k").alias("k"), F.least("a_n_long", "b_n_long").alias("more")).agg(F.count("*").alias("shared"))
    pairs = pairs.where(F.col("shared") + F.col("more") >= least * F.col("k"))
    pairs = keep(pairs.select("a_digest", "b_digest", F.col("a_rep").alias("a"), F.col("b_rep").alias("b")), "pairs")

    # members of long lists that can link through those alone, a row for each class
    lists = keep(listed.where((F.col("n_long") > 0) & (F.col("n_long") >= least * F.col("k"))).select("digest", "rep", "n", "vs"), "lists")
    needed = pairs.select(F.col("a_digest").alias("digest"), F.col("a").alias("rep")).union(pairs.select("b_digest", "b")).union(lists.select("digest", "rep")).distinct()
    sets = keep(_sets(docs, needed, words).groupBy("digest").agg(F.any_value("members").alias("members")), "sets")

    # first: each class with the smallest of those it is paired with
    firsts = pairs.groupBy("b_digest", "b").agg(F.min(F.struct("a_digest", "a")).alias("f")).select("f.a_digest", "b_digest", "f.a", "b")
    links = _confirmed(firsts, sets, percent, sketch)
    parts = connected_components(links.select("a", "b"))
    temporary.append(parts)

    many = lists.limit(1).count() > 0
    if many:
        # Members of long lists with their hashes in one order: those that few members hold first, rarest first, then the others. Two sets that are similar
        # enough share one of the first n - ceil(n * percent / 100) + 1, and what stands before their first common hash is in one of them only: an
        # exact bound for each pair. A class's own hashes are known from the counts; only those of a few members are joined with them, so no key of that join is hot.
        inside = sets.join(lists.select("digest"), "digest")
        held = inside.select("digest", F.explode("members").alias("x"))
        counts = keep(held.groupBy("x").agg(F.count("*").alias("c"), F.min("digest").alias("one")).where(F.col("c") <= FEW), "rare")
        own = counts.where("c = 1").groupBy(F.col("one").alias("digest")).agg(F.sort_array(F.collect_list("x")).alias("own"))
        few = held.join(counts.where("c > 1"), "x").groupBy("digest").agg(F.transform(F.sort_array(F.collect_list(F.struct("c", "x"))), lambda e: e.x).alias("few"))
        none = F.array().cast("array<long>")
        ordered = inside.join(own, "digest", "left").join(few, "digest", "left").select("digest", "members", F.coalesce("own", none).alias("own"), F.coalesce("few", none).alias("few"))
        ordered = ordered.select("digest", F.size("own").alias("u"), "members", F.concat("own", "few").alias("rare"))
        ordered = ordered.select("digest", "u", (F.size("rare") / F.size("members")).alias("odd"), F.concat("rare", F.array_except("members", "rare")).alias("o"))
        first_ones = F.slice("o", 1, (F.size("o") - F.ceil(F.size("o") * percent / 100) + 1).cast("int"))
        lists = keep(lists.join(ordered.withColumn("o", first_ones), "digest"), "members")

    before = 0
    for turn in range(ROUNDS if many else 0):
        # then: other leaders, and other two of a class's smallest long lists, each time; first the one with the least share of hashes that few hold, then any
        mine = None
        for n in range(turn * TRIES, (turn + 1) * TRIES):
            h = F.pmod(F.xxhash64("digest", F.lit(n)), F.lit(2**32)) + (F.floor(1000 * F.col("odd")) * 2**32 if n % TRIES == 0 else F.lit(0))
            two = F.slice("vs", 2 * n % POSTED + 1, 2)
            row = lists.select(F.lit(n).alias("i"), F.explode(two).alias("v"), h.cast("long").alias("h"), "digest", "rep", "n", "u")
            mine = row if mine is None else mine.union(row)
        leaders = keep(mine.groupBy("i", "v").agg(F.min(F.struct("h", "digest", "rep", "n", "u")).alias("l")), "leaders")
        led = mine.join(leaders, ["i", "v"]).where((F.col("digest") != F.col("l.digest")) & _possible(F.col("n"), F.col("u"), F.col("l.n"), F.col("l.u"), percent))
        tries = led.select(F.col("l.digest").alias("a_digest"), F.col("digest").alias("b_digest"), F.col("l.rep").alias("a"), F.col("rep").alias("b")).distinct()
        parts = keep(_joined(_confirmed(_apart(tries, parts), sets, percent, sketch), parts, temporary), "parts")
        # a class is outside a list where its component is not the list's largest
        of = _sizes(_components(lists.select("digest", "rep", "n", F.slice("vs", 1, 2).alias("vs")), parts)).groupBy("v").agg(F.sum("m").alias("all"), F.max("m").alias("most"))
        left, of = of.agg(F.coalesce(F.sum(F.col("all") - F.col("most")), F.lit(0)), F.coalesce(F.sum("all"), F.lit(0))).first()
        if left <= of / 100 or (turn and left > 0.8 * before):
            break
        before = left

    # last: every pair whose two sides are in different components still, and what long lists have left outside
    rest = _apart(pairs, parts)
    if many:
        placed = _components(lists, parts)
        sizes = keep(_sizes(placed), "sizes")
        largest = sizes.groupBy("v").agg(F.max(F.struct("m", "component")).alias("top"))
        small = keep(sizes.join(largest, "v").where(F.col("component") != F.col("top.component")).select("v", "component"), "small")
        outside = keep(_on_lists(placed, "component").join(small, ["v", "component"]).select("digest").distinct(), "outside")
        if outside.limit(1).count():
            told = placed.join(outside.withColumn("outside", F.lit(True)), "digest", "left").withColumn("outside", F.coalesce("outside", F.lit(False)))
            # a class's own hashes come first and lead to nobody
            posts = told.select("digest", "rep", "n", "component", "outside", "u", "o", F.posexplode("o").alias("p", "x")).where("p >= u").drop("u")
            a, b = (posts.select(*(F.col(c).alias(f"{s}_{c}") for c in posts.columns)) for s in "ab")
            # each pair at its first common hash only; what follows it bounds the overlap, which must be percent / (100 + percent) of both sizes
            most = 1 + F.least(F.col("a_n") - F.col("a_p") - 1, F.col("b_n") - F.col("b_p") - 1)
            fits = (F.col("a_x") == F.col("b_x")) & (F.col("a_component") != F.col("b_component")) & ((100 + percent) * most >= percent * (F.col("a_n") + F.col("b_n")))
            met = a.where("a_outside").join(b, fits & (F.element_at(F.array_intersect("a_o", "b_o"), 1) == F.col("a_x")))
            met = met.select("a_digest", "b_digest", F.col("a_rep").alias("a"), F.col("b_rep").alias("b"), F.col("a_component").alias("ca"), F.col("b_component").alias("cb"))
            rest = rest.union(met)
    parts = keep(_joined(_confirmed(rest.distinct(), sets, percent, sketch), parts, temporary), "parts")
    twice = marks.where("n_shingles > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("digest").alias("d"), F.max("digest").alias("e")).where("d <> e").select("doc_id")
    same = marks.join(twice, "doc_id").join(reps, "digest").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    parts = keep(_joined(_apart(same, parts), parts, temporary), "parts")
    whole = reps.join(parts, reps.rep == parts.node, "left").select("digest", F.coalesce("component", "rep").alias("component"))
    out = marks.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("digest")).alias("digest")).join(whole, "digest", "left")
    component = F.coalesce("component", "doc_id")
    out = out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
    out = stage(out, "near")
    for t in temporary:
        unstage(t)
    return out


def _apart(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """pairs (a, b and others) whose sides are not yet in one component, with these (ca, cb)."""
    x = parts.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    y = parts.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    ca, cb = F.coalesce("ca", "a"), F.coalesce("cb", "b")
    return pairs.join(x, "a", "left").join(y, "b", "left").where(ca != cb).select(*pairs.columns, ca.alias("ca"), cb.alias("cb"))


def _joined(links: DataFrame, parts: DataFrame, kept: list) -> DataFrame:
    """parts (node, component) with the components that links (ca, cb) join as one; only components are walked, not their nodes. kept: gets what was staged."""
    step = connected_components(links.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    kept.append(step)
    step = step.select(F.col("node").alias("old"), F.col("component").alias("new"))
    nodes = parts.union(step.select("old", "old")).distinct()
    return nodes.join(step, nodes.component == step.old, "left").select("node", F.coalesce("new", "component").alias("component"))


def _components(lists: DataFrame, parts: DataFrame) -> DataFrame:
    """Members of long lists, a row for each class, with their component."""
    return lists.join(parts.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))


def _on_lists(placed: DataFrame, *more: str) -> DataFrame:
    """A row for each class and long list of it; dealt out by class, as a family of copies makes very many."""
    return placed.select("digest", "vs", *more).repartition("digest").select("digest", *more, F.explode("vs").alias("v"))


def _sizes(placed: DataFrame) -> DataFrame:
    """(v, component, m): classes of each component on each long list."""
    return _on_lists(placed, "component").groupBy("v", "component").agg(F.count("*").alias("m"))
