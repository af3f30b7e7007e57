"""Iterative graph operators over edge tables. Each round cuts its lineage in the shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.sources.shared import settled, stored


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component), component being the least node; least labels spread and then jump to their own label."""
    e = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
    e = settled(e.union(e.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    labels = settled(e.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("l")))
    while True:
        near = e.join(labels.select(F.col("x").alias("y"), "l"), "y").groupBy("x").agg(F.min("l").alias("m"))
        step = labels.join(near, "x").select("x", F.col("l").alias("old"), F.least("l", "m").alias("n"))
        jump = step.select(F.col("x").alias("n"), F.col("n").alias("j"))
        nxt = settled(step.join(jump, "n", "left").select("x", "old", F.least("n", F.coalesce("j", "n")).alias("l")))
        if nxt.where("l <> old").isEmpty():
            return nxt.select(F.col("x").alias("node"), F.col("l").alias("component"))
        labels = nxt.select("x", "l")


def spanning_forest(edges: DataFrame) -> DataFrame:
    """(a, b, w) with a < b: the spanning forest of most weight of undirected edges (a, b, w). Equal weights are ordered by
    (a, b), so the forest is one; of edges of one pair the heaviest counts, loops do not.

    Boruvka rounds: every component takes the best edge that leaves it (a partial aggregate, so a hub is no group), and
    components merge over what was taken; the number of components at least halves each time."""
    e = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w").where("a < b")
    left = settled(e.groupBy("a", "b").agg(F.max("w").alias("w")).select("a", "b", "w", F.col("a").alias("ca"), F.col("b").alias("cb")))
    forest = left.select("a", "b", "w").where("false")
    while not left.isEmpty():
        order = F.struct((-F.col("w")).alias("m"), "a", "b")
        ends = left.select(F.col("ca").alias("c"), order.alias("o")).union(left.select("cb", order))
        taken = settled(ends.groupBy("c").agg(F.min("o").alias("o")).select("o.a", "o.b").distinct().join(left, ["a", "b"]))
        forest = settled(forest.union(taken.select("a", "b", "w")))
        merged = settled(connected_components(taken, "ca", "cb"))
        for c in ("ca", "cb"):
            left = left.join(merged.select(F.col("node").alias(c), "component"), c, "left").withColumn(c, F.coalesce("component", c)).drop("component")
        left = settled(left.where("ca <> cb").select("a", "b", "w", "ca", "cb"))
    return forest


def representatives(edges: DataFrame, nodes: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Greedy cover: nodes (id, size) by sum + 0.25 * sum * ln(size), falling; a node is taken if no taken neighbour
    comes before it. Rounds take every node that leads its open neighbours, which gives the greedy order's answer. Values are
    rounded to 9 digits, as the last bits of a sum hang on the order of its rows: equal ones go by the least id."""
    e = edges.select("a", "b", "w")
    both = settled(e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")).distinct())
    total = both.groupBy("a").agg(F.sum(F.col("w") - threshold).alias("s"))
    p = nodes.join(total, nodes["id"] == total["a"], "left").select("id", F.round(F.coalesce(F.col("s") + 0.25 * F.col("s") * F.log(F.col("size").cast("double")), F.lit(0.0)), 9).alias("p"))
    p = settled(p)
    open_, taken = settled(p.withColumn("taken", F.lit(False))), None
    while not open_.isEmpty():
        near = both.join(open_.select(F.col("id").alias("a"), F.col("p").alias("pa")), "a").join(open_.select(F.col("id").alias("b"), F.col("p").alias("pb")), "b")
        beaten = near.where((F.col("pb") > F.col("pa")) | ((F.col("pb") == F.col("pa")) & (F.col("b") < F.col("a")))).select(F.col("a").alias("id")).distinct()
        lead = settled(open_.join(beaten, "id", "left_anti").select("id", "p"))
        taken = lead if taken is None else taken.union(lead)
        gone = both.join(lead.select(F.col("id").alias("a")), "a").select(F.col("b").alias("id")).union(lead.select("id")).distinct()
        open_ = settled(open_.join(gone, "id", "left_anti"))
    return taken.select("id") if taken is not None else p.select("id").limit(0)


def pick_subset(edges: DataFrame, nodes: DataFrame, max_ani: float) -> DataFrame:
    """Nodes (id, rank; low is good) left after the worse end of each edge above the limit goes, from the top ranks
    down: a node goes if a better neighbour stays. Same rounds as representatives."""
    over = edges.where(F.col("w") > max_ani)
    ranked = nodes.select("id", F.lit(1).alias("size"), "rank")
    both = settled(over.select("a", "b").union(over.select("b", "a")).distinct())
    open_, taken = settled(ranked), None
    while not open_.isEmpty():
        near = both.join(open_.select(F.col("id").alias("a"), F.col("rank").alias("ra")), "a").join(open_.select(F.col("id").alias("b"), F.col("rank").alias("rb")), "b")
        beaten = near.where((F.col("rb") < F.col("ra")) | ((F.col("rb") == F.col("ra")) & (F.col("b") < F.col("a")))).select(F.col("a").alias("id")).distinct()
        lead = settled(open_.join(beaten, "id", "left_anti").select("id"))
        taken = lead if taken is None else taken.union(lead)
        gone = both.join(lead.select(F.col("id").alias("a")), "a").select(F.col("b").alias("id")).union(lead).distinct()
        open_ = settled(open_.join(gone, "id", "left_anti"))
    return taken if taken is not None else nodes.select("id").limit(0)


def dbscan(edges: DataFrame, eps: float, min_points: int) -> DataFrame:
    """(node, cluster, core): edges (a, b, d) up to eps; core nodes have min_points - 1 neighbours or more; a border
    node joins its least cluster."""
    near = edges.where(F.col("d") <= eps).select("a", "b")
    both = settled(near.union(near.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    core = settled(both.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") >= min_points - 1).select("a"))
    inner = both.join(core, "a").join(core.select(F.col("a").alias("b")), "b")
    found = connected_components(inner)
    found = core.join(found, core["a"] == found["node"], "left").select(F.col("a").alias("node"), F.coalesce("component", "a").alias("cluster"))
    border = both.join(core, "a", "left_anti").join(found.select(F.col("node").alias("b"), "cluster"), "b").groupBy("a").agg(F.min("cluster").alias("cluster"))
    return found.withColumn("core", F.lit(True)).union(border.select(F.col("a").alias("node"), "cluster", F.lit(False)))


def modularity(edges: DataFrame, labels: DataFrame) -> float:
    """Of a partition (node, l): the share of edge weight (a, b, w) inside communities less what chance gives."""
    side = lambda n: labels.select(F.col("node").alias(n), F.col("l").alias(f"l{n}"))
    e = edges.join(side("a"), "a").join(side("b"), "b")
    total, inside = e.agg(F.coalesce(F.sum("w"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("la") == F.col("lb"), F.col("w"))), F.lit(0))).first()
    if not total:
        return 0.0
    degree = e.select(F.explode(F.array("la", "lb")).alias("l"), "w").groupBy("l").agg((F.sum("w") / (2.0 * float(total))).alias("d"))
    return float(inside) / float(total) - float(degree.agg(F.sum(F.col("d") * F.col("d"))).first()[0])


def communities(edges: DataFrame, least_rise: float = 5e-3) -> DataFrame:
    """(node, community): local moves that raise modularity. In each round nodes of one half of the hashes may move to the
    neighbouring community of the highest gain (ties to the least label); a round counts only if modularity rises, and
    two halves in a row that raise it by less than least_rise end it. A label is the least node of its community."""
    one = settled(edges.where("a <> b").select("a", "b", F.col("w").cast("double")))
    e = settled(one.union(one.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")))
    degree = settled(e.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("k")))
    twice = degree.agg(F.sum("k")).first()[0] or 1.0
    labels, best, idle = settled(degree.select("node", F.col("node").alias("l"))), None, 0
    r = -1
    while idle < 2:  # every half that counts raises modularity
        r += 1
        placed = labels.join(degree, "node")
        total = placed.groupBy("l").agg(F.sum("k").alias("t"))
        links = e.join(labels.select(F.col("node").alias("b"), "l"), "b").groupBy(F.col("a").alias("node"), "l").agg(F.sum("w").alias("in"))
        # a node's own community is an option even without links into it, and counts without the node itself
        options = links.union(labels.select("node", "l", F.lit(0.0).alias("in"))).groupBy("node", "l").agg(F.sum("in").alias("in"))
        options = options.join(total, "l").join(placed.select("node", "k", F.col("l").alias("own")), "node")
        rest = F.col("t") - F.when(F.col("l") == F.col("own"), F.col("k")).otherwise(F.lit(0.0))
        gain = F.round(F.col("in") - F.col("k") * rest / F.lit(twice), 9)
        choice = options.groupBy("node").agg(F.max(F.struct(gain.alias("g"), (F.col("l") == F.col("own")).alias("stay"), (-F.col("l")).alias("m"))).alias("c")).select("node", (-F.col("c.m")).alias("n"))
        turn = F.pmod(F.xxhash64("node", F.lit(r // 2)), F.lit(2)) == r % 2
        moved = settled(labels.join(choice, "node").select("node", F.when(turn, F.col("n")).otherwise(F.col("l")).alias("l")))
        best = modularity(one, labels) if best is None else best
        now = modularity(one, moved)
        idle = 0 if now - best >= least_rise else idle + 1
        if now > best + 1e-12:
            labels, best = moved, now
    least = labels.groupBy("l").agg(F.min("node").alias("community"))
    return labels.join(least, "l").select("node", "community")


#: Of at most so many different k-mers, greedy takes one a round.
FEW_KMERS = 65_536
#: Picks between two tables of what is left.
PICKS = 16


def take_one_by_one(rows: DataFrame, id_col: str) -> DataFrame:
    """kmer_filter_set where k-mers are few: nearly all of them share sequences, so a round has one first choice. A round
    is a count of few groups over the sets of the sequences; nothing is joined."""
    left = settled(rows.groupBy(id_col).agg(F.collect_list("kmer").alias("kmers")).select("kmers"))
    picked, since = [], []
    while True:
        n = left.select(F.explode("kmers").alias("kmer")).groupBy("kmer").agg(F.count("*").alias("n"))
        top = n.agg(F.min(F.struct((-F.col("n")).alias("m"), "kmer")).alias("t")).first().t
        if top is None:
            return rows.sparkSession.createDataFrame(picked, "kmer string, covered bigint")
        picked.append((top.kmer, -top.m))
        since.append(top.kmer)
        left = left.where(~F.array_contains("kmers", top.kmer))
        if len(since) == PICKS:
            left, since = settled(left), []


def kmer_filter_set(rows: DataFrame, id_col: str = "ordinal") -> DataFrame:
    """Greedy k-mer set (kmer, covered) such that each sequence (id, kmer rows) has one: the most common k-mer is taken
    (of equals the least), its sequences leave, and so on.

    A round takes every k-mer that is the first choice of all its sequences: no k-mer that greedy takes before it
    holds one of them, so the result is that of one at a time. Rows of covered sequences leave the table."""
    left, picked = settled(rows.select(id_col, "kmer").distinct()), None
    if left.select("kmer").distinct().limit(FEW_KMERS + 1).count() <= FEW_KMERS:
        return take_one_by_one(left, id_col)
    while not left.isEmpty():
        n = left.groupBy("kmer").agg(F.count("*").alias("n"))
        choice = left.join(n, "kmer").groupBy(id_col).agg(F.min(F.struct((-F.col("n")).alias("m"), "kmer")).alias("c"))
        top = settled(choice.groupBy(F.col("c.kmer").alias("kmer")).agg(F.count("*").alias("covered")).join(n, "kmer").where("covered = n").select("kmer", "covered"))
        picked = top if picked is None else picked.union(top)
        done = left.join(top.select("kmer"), "kmer", "left_semi").select(id_col).distinct()
        left = settled(left.join(done, id_col, "left_anti"))
    return picked if picked is not None else left.groupBy("kmer").agg(F.count("*").alias("covered"))


def chain_places(nodes: DataFrame, link: DataFrame) -> DataFrame:
    """(kmer, p, d): the first k-mer of each one's chain of links (a, b), and its place there, by pointer doubling. K-mers
    on a cycle are left out."""
    ptr = settled(nodes.join(link, nodes["kmer"] == link["b"], "left").select("kmer", F.coalesce("a", "kmer").alias("p"), F.when(F.col("a").isNull(), 0).otherwise(1).cast("bigint").alias("d"), F.col("a").isNull().alias("done")))
    left, rounds = ptr.where("not done").count(), 0
    while left:
        up = ptr.select(F.col("kmer").alias("p"), F.col("p").alias("pp"), F.col("d").alias("dd"), F.col("done").alias("over"))
        further = ptr.where("not done").join(up, "p").select("kmer", F.col("pp").alias("p"), (F.col("d") + F.col("dd")).alias("d"), F.col("over").alias("done"))
        ptr = settled(ptr.where("done").union(further))
        still, rounds = ptr.where("not done").count(), rounds + 1
        if still == left and 2**rounds > 2 * left:
            break
        left = still
    return ptr.where("done").drop("done")


#: Bases of a piece when a path is put together.
PATH_PIECE = 1000


def compact(nodes: DataFrame, link: DataFrame, k: int) -> DataFrame:
    """(bases, kmers, circle): nodes (kmer) put together along links (a, b), each end of a link unbranched. Pointer doubling
    gives every k-mer its path's first one and its place there; paths are put together from pieces. A circle of links is
    cut before its least k-mer."""
    rows = settled(chain_places(nodes, link))
    round_ = settled(nodes.join(rows.select("kmer"), "kmer", "left_anti"))
    rows = rows.withColumn("circle", F.lit(False))
    if not round_.isEmpty():
        own = link.join(round_.select(F.col("kmer").alias("b")), "b", "left_semi")
        cut = own.join(connected_components(own).withColumnRenamed("node", "b"), "b").where("b <> component").select("a", "b")
        rows = rows.union(chain_places(round_, settled(cut)).withColumn("circle", F.lit(True)))
    text = lambda c, by: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, c))), lambda y: y[c]), "")
    last = rows.select("p", "circle", "d", F.right("kmer", F.lit(1)).alias("x"), F.floor(F.col("d") / PATH_PIECE).alias("piece"))
    pieces = last.groupBy("p", "circle", "piece").agg(text("x", "d").alias("t"), F.count("*").alias("n"))
    whole = pieces.groupBy("p", "circle").agg(text("t", "piece").alias("t"), F.sum("n").alias("kmers"))
    return whole.select(F.concat(F.left("p", F.lit(k - 1)), "t").alias("bases"), "kmers", "circle")


def plain_links(nodes: DataFrame, k: int) -> DataFrame:
    """(a, b): k-mers that overlap by k - 1 bases, where neither has another such neighbour on that side."""
    out = nodes.select(F.col("kmer").alias("a"), F.substring("kmer", 2, k - 1).alias("j"))
    into = nodes.select(F.col("kmer").alias("b"), F.left("kmer", F.lit(k - 1)).alias("j"))
    single = lambda d, c: d.groupBy("j").agg(F.count("*").alias("n"), F.first(c).alias(c)).where("n = 1").drop("n")
    return single(out, "a").join(single(into, "b"), "j").where("a <> b").select("a", "b")


def unitigs(kmers: DataFrame, k: int) -> DataFrame:
    """(bases, kmers): maximal non-branching paths of a set of k-mers on one strand."""
    s = settled(kmers.select("kmer").distinct())
    return compact(s, settled(plain_links(s, k)), k).drop("circle")


def unitigs_both(kmers: DataFrame, k: int) -> DataFrame:
    """(bases, kmers): maximal non-branching paths of the bidirected graph of canonical k-mers, each k-mer (with its reverse
    complement) in one of them; bases are canonical.

    Nodes are (k-mer, side) as oriented k-mers: each k-mer and its reverse complement. A link holds for both strands or
    for none, so every path comes twice, turned around, and the least one stays. No link joins a k-mer to itself turned
    around, nor to one that is its own reverse complement (even k)."""
    from strandlake.functions.sequence import canonical, revcomp

    one = kmers.select(canonical(F.col("kmer")).alias("kmer")).distinct()
    s = settled(one.select(F.explode(F.array_distinct(F.array("kmer", revcomp(F.col("kmer"))))).alias("kmer")))
    own = lambda c: F.col(c) == revcomp(F.col(c))
    links = plain_links(s, k).where(~own("a") & ~own("b") & (canonical(F.col("a")) != canonical(F.col("b"))))
    both = compact(s, settled(links), k)
    # a circle starts with its least k-mer; turned around it starts with another, so these two are compared
    turned = F.transform(F.sequence(F.lit(1), F.length("bases") - k + 1), lambda i: revcomp(F.substring("bases", i, F.lit(k))))
    first = F.left("bases", F.lit(k)) <= F.array_min(turned)
    return both.where(F.when(F.col("circle"), first).otherwise(F.col("bases") <= revcomp(F.col("bases")))).drop("circle")


def tax_closure(nodes: DataFrame) -> DataFrame:
    """(id, ancestor, distance) for every node and each of its ancestors, itself included, at any depth. Rounds double the
    distance: what is known up to d steps is joined with itself. Raises ValueError where parents form a cycle."""
    n = nodes.count()
    rows = settled(nodes.select("id", F.col("id").alias("ancestor"), F.lit(0).cast("bigint").alias("distance")))
    reach, step = settled(nodes.where("id <> pid").select("id", F.col("pid").alias("ancestor"))), 1
    while not reach.isEmpty():  # reach: the ancestor just `step` above each node
        if step > n:
            raise ValueError("parents form a cycle")
        more = rows.select(F.col("id").alias("ancestor"), F.col("ancestor").alias("top"), F.col("distance").alias("d"))
        new = reach.join(more, "ancestor", "left")  # an ancestor that is no node itself has none
        new = new.select("id", F.coalesce("top", "ancestor").alias("ancestor"), (F.coalesce("d", F.lit(0)) + step).cast("bigint").alias("distance"))
        rows = settled(rows.union(new))
        ahead = reach.select(F.col("id").alias("ancestor"), F.col("ancestor").alias("far"))
        reach, step = settled(reach.join(ahead, "ancestor").select("id", F.col("far").alias("ancestor"))), step * 2
    return rows


def lineage(closure: DataFrame, nodes: DataFrame) -> DataFrame:
    named = closure.join(nodes.select(F.col("id").alias("ancestor"), "name"), "ancestor")
    parts = F.reverse(F.array_sort(F.collect_list(F.struct("distance", "name"))))
    return named.groupBy("id").agg(F.array_join(F.transform(parts, lambda x: x["name"]), ";").alias("lineage"))


def lca(groups: DataFrame, closure: DataFrame) -> DataFrame:
    """groups (group, id): the lowest common ancestor of each group's distinct ids."""
    g = groups.select("group", "id").distinct()
    n = g.groupBy("group").agg(F.count("*").alias("n"))
    hits = g.join(closure, "id").groupBy("group", "ancestor").agg(F.count("*").alias("c"), F.min("distance").alias("d")).join(n, "group").where("c = n")
    return hits.groupBy("group").agg(F.min_by("ancestor", "d").alias("lca"))


def majority_ancestor(groups: DataFrame, closure: DataFrame, share: float = 0.5) -> DataFrame:
    """The lowest ancestor above more than the given share of a group's ids; least id among equals."""
    n = groups.groupBy("group").agg(F.count("*").alias("n"))
    hits = groups.join(closure, "id").groupBy("group", "ancestor").agg(F.count("*").alias("c"), F.min("distance").alias("d")).join(n, "group").where(F.col("c") > share * F.col("n"))
    return hits.groupBy("group").agg(F.min_by("ancestor", F.struct("d", "ancestor")).alias("majority"))


def to_taxid(df: DataFrame, accessions: DataFrame, name: str = "name") -> DataFrame:
    """Names with their taxon before them; accessions has accession and taxid. Unknown ones get -1."""
    rows = df.withColumn("accession", F.regexp_extract(name, "^[^ |.]+", 0)).join(accessions.select("accession", "taxid").dropDuplicates(["accession"]), "accession", "left")
    return rows.withColumn("taxid", F.coalesce("taxid", F.lit(-1).cast("bigint"))).withColumn(name, F.concat(F.lit("tid|"), F.col("taxid").cast("string"), F.lit("|"), name)).drop("accession")


def split_by_taxa(df: DataFrame, closure: DataFrame, nodes: DataFrame, level: int) -> DataFrame:
    """Rows (taxid) with route: the name of the ancestor at a level, "unknown" without one."""
    at = closure.join(nodes.where(F.col("level") == level).select(F.col("id").alias("ancestor"), F.col("name").alias("route")), "ancestor").select(F.col("id").alias("taxid"), "route")
    return df.join(at, "taxid", "left").withColumn("route", F.coalesce("route", F.lit("unknown")))


def accession_patterns(df: DataFrame, column: str) -> DataFrame:
    """(shape, n, space): digits as D, letters as L; space is the log10 of how many accessions fit the shape."""
    shape = F.regexp_replace(F.regexp_replace(column, "[A-Za-z]", "L"), "[0-9]", "D")
    g = df.groupBy(shape.alias("shape")).agg(F.count("*").alias("n"))
    count = lambda c: F.length("shape") - F.length(F.replace("shape", F.lit(c), F.lit("")))
    return g.withColumn("space", F.round(count("D") * F.log10(F.lit(10.0)) + count("L") * F.log10(F.lit(26.0)), 6))


def bin_contigs(contigs: DataFrame, max_difference: float, gc_step: float = 0.02, depth_step: float = 0.5) -> DataFrame:
    """(id, bin): contigs (id, gc, depth, vector) in neighbouring cells of GC and log depth whose vectors lie near each
    other are linked; bins are the components, alone ones their own. Cells meet in blocks, and a pair of blocks gives a
    spanning forest of its links, so what goes on grows with the contigs and not with their pairs."""
    import numpy as np
    import pyarrow as pa

    from strandlake.operators.similarity import cell_pairs, cells_dealt, near_forest

    cell = lambda c, step: F.floor(c / step).cast("bigint")
    # vectors of other sizes, or that lack a number, have no distance
    known = contigs.where(F.col("vector").isNotNull() & ~F.exists("vector", lambda v: v.isNull()))
    base = known.select("id", F.col("vector").cast("array<double>").alias("vector"), F.size("vector").cast("bigint").alias("size"), cell(F.col("gc"), gc_step).alias("cg"), cell(F.log2(F.col("depth") + 0.01), depth_step).alias("cd"))
    base = stored(base.where("cg is not null and cd is not null"))
    left, right = cells_dealt(base, "id", ["size", "cg", "cd"], [(0, 0, 0), (0, 0, 1), (0, 1, -1), (0, 1, 0), (0, 1, 1)])
    keys = ["size", "cg", "cd", "__m", "__s", "__t"]

    def run(key, one, two):
        size, same = key[0].as_py(), key[3].as_py() == 0 and key[4].as_py() == key[5].as_py()
        numbers = lambda t: pa.concat_arrays([c.flatten() for c in t.column("vector").chunks]).to_numpy(zero_copy_only=False).reshape(-1, size).T.copy() if t.num_rows and size else np.zeros((size, t.num_rows))
        i, j = near_forest(numbers(one), numbers(one if same else two), max_difference, same)
        ids = [t.column("id").take(pa.array(at)) for t, at in ((one, i), (one if same else two, j))]
        return pa.Table.from_arrays(ids, names=["a", "b"])

    kind = dict(contigs.dtypes)["id"]
    links = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, f"a {kind}, b {kind}")
    found = connected_components(links)
    known = stored(base.join(found.withColumnRenamed("node", "id").hint("merge"), "id", "left").withColumn("l", F.coalesce("component", "id")).drop("component"))
    most = known.groupBy("l").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l").first()
    rest = known.where(F.col("l") != (most["l"] if most else None))

    def meet(batches):
        for batch in batches:
            for size, own, others in zip(*(batch.column(c) for c in ("size", "own", "others")), strict=True):
                one, two = own.values, others.values
                lx, ly = (x.field("l").to_numpy(zero_copy_only=False) for x in (one, two))
                if (lx == lx[0]).all() and (ly == lx[0]).all():
                    continue
                x, y = (t.field("vector").flatten().to_numpy(zero_copy_only=False).reshape(len(t), size.as_py()).T.copy() for t in (one, two))
                i, j = near_forest(x, y, max_difference, False)
                apart = lx[i] != ly[j]
                table = pa.Table.from_arrays([pa.array(lx[i][apart]), pa.array(ly[j][apart])], names=["a", "b"])
                yield from table.group_by(["a", "b"]).aggregate([]).to_batches()

    kind_l = dict(known.dtypes)["l"]
    between = cell_pairs(rest, known, "id", ["size", "cg", "cd"]).mapInArrow(meet, f"a {kind_l}, b {kind_l}")
    joined = connected_components(settled(between.distinct()))
    labels = known.select("id", "l").join(joined.withColumnRenamed("node", "l").hint("merge"), "l", "left").select("id", F.coalesce("component", "l").alias("bin"))
    return contigs.select("id").join(labels.hint("merge"), "id", "left").select("id", F.coalesce("bin", "id").alias("bin"))


def id_tree(pairs: DataFrame, components: DataFrame) -> DataFrame:
    """(component, newick): average-linkage trees of each component's identities (a, b, identity), one group each. A
    component must fit a task: its matrix is square."""
    import pandas as pd

    rows = pairs.join(components.select(F.col("node").alias("a"), "component"), "a")

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(pdf["a"]) | set(pdf["b"]))
        d = {frozenset((x, y)): 1 - v for x, y, v in zip(pdf["a"], pdf["b"], pdf["identity"], strict=True)}
        parts = {str(n): [n] for n in names}
        while len(parts) > 1:
            keys = sorted(parts)
            mean = lambda p, q: sum(d.get(frozenset((x, y)), 1.0) for x in parts[p] for y in parts[q]) / (len(parts[p]) * len(parts[q]))
            _, p, q = min((mean(p, q), p, q) for i, p in enumerate(keys) for q in keys[i + 1 :])
            parts[f"({p},{q})"] = parts.pop(p) + parts.pop(q)
        return pd.DataFrame({"component": [pdf["component"].iloc[0]], "newick": [next(iter(parts)) + ";"]})

    return rows.groupBy("component").applyInPandas(grow, "component long, newick string")
