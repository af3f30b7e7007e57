"""Pile-ups, alignment in bands, graphs and repeats against brute force, with small tiles, blocks and pieces."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.operators import aligner, graphs, joins, pileup, sets, similarity, windows

COMPLEMENT = str.maketrans("ACGT", "TGCA")


def rc(s):
    return s[::-1].translate(COMPLEMENT)


def some(rnd, n, symbols="ACGT"):
    return "".join(rnd.choice(symbols) for _ in range(n))


def table(one, two, free=0):
    """Rows of the full edit table; with free, starts in two cost nothing up to there."""
    row = [max(0, j - free) for j in range(len(two) + 1)]
    for i, x in enumerate(one, 1):
        new = [i]
        for j, y in enumerate(two, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row


def test_band_equals_the_full_table():
    rnd, cases = random.Random(2), []
    for _ in range(400):
        a = some(rnd, rnd.randrange(60))
        b = list(a)
        for _ in range(rnd.randrange(7)):
            i = rnd.randrange(len(b) + 1)
            b[i : i + rnd.randrange(2)] = rnd.choice(["", "A", "CG"])
        b, k, free = "".join(b), rnd.randrange(9), rnd.choice([0, 0, 4])
        b = some(rnd, rnd.randrange(5)) + b + some(rnd, rnd.randrange(12)) if free else b
        row = table(a, b, free)
        d = min(row) if free else row[-1]
        cases.append((a, b, k, free, d if d <= k else -1))
    one, two, k, free, want = zip(*cases, strict=True)
    assert aligner.band_edits(list(one), list(two), np.array(k), np.array(free)).tolist() == list(want)


def test_bounded_identity(spark):
    rows = spark.createDataFrame([(1, "ACGTACGTAC", "ACGTACGTAA"), (2, "ACGT", "TTTT"), (3, None, "A"), (4, "", ""), (5, "ACGTACGTAC", "ACG")], "edits int, a string, b string")
    got = {r["edits"]: r["identity"] for r in aligner.bounded_identity(rows, "a", "b", 0.8).collect()}
    assert got == {1: 0.9, 4: 1.0}


def reads_of(rnd, contig, n):
    """Alignments with random codes: (id, rname, pos, cigar, seq, quals, strand, mapq)."""
    out = []
    for i in range(n):
        pos, r, seq, ops = rnd.randrange(1, len(contig) - 40), 0, "", []
        for _ in range(rnd.randrange(1, 6)):
            op, size = rnd.choice("MMM=XIDNS"), rnd.randrange(1, 9)
            if ops and op == "S":
                continue
            here = contig[pos - 1 + r : pos - 1 + r + size]
            if op in "M=X":
                seq += "".join(c if rnd.random() < 0.8 else rnd.choice("ACGTN") for c in here)
            elif op in "IS":
                seq += some(rnd, size)
            r += size if op in "MDN=X" else 0
            ops.append(f"{size}{op}")
        quals = "".join(chr(33 + rnd.randrange(40)) for _ in seq)
        out.append((i, "c", pos, "".join(ops), seq, quals, i % 2, 30))
    return [*out, (n, "c", 5, None, "ACGT", "IIII", 0, 30), (n + 1, "c", 5, "9M", "ACGT", "IIII", 0, 30), (n + 2, None, None, "*", "ACGT", None, 0, 30), (n + 3, "c", 5, "4M", contig[4:8], None, 0, 30), (n + 4, "d", 1, "2M", "AC", "II", 1, 30)]


ALN = "aln_id long, rname string, pos long, cigar string, seq string, quals string, strand int, mapq int"


def walked(row):
    """(op, n, q, r) of a code that fits its bases."""
    import re

    _, _, pos, cigar, seq, *_ = row
    ops = [(x, int(n)) for n, x in re.findall(r"(\d+)([MIDNSHP=X])", cigar or "")]
    if not ops or sum(n for x, n in ops if x in "MIS=X") != len(seq):
        return []
    out, q, r = [], 0, pos - 1
    for x, n in ops:
        out.append((x, n, q, r))
        q, r = q + n * (x in "MIS=X"), r + n * (x in "MDN=X")
    return out


@pytest.fixture(scope="module")
def aligned(spark):
    rnd = random.Random(4)
    contig = some(rnd, 90, "ACGTN") + some(rnd, 40)
    rows = reads_of(rnd, contig, 120)
    return contig, rows, spark.createDataFrame(rows, ALN), spark.createDataFrame([("c", contig), ("e", "")], "name string, bases string")


def shown(contig, rows):
    out = []
    for row in rows:
        i, name, _, _, seq, quals, *_ = row
        text, quals = contig if name == "c" else "", quals or "!" * len(seq)
        for x, n, q, r in walked(row):
            if x in "M=X":
                for j in range(n):
                    if r + j < len(text) and seq[q + j] != text[r + j] and seq[q + j] in "ACGT" and text[r + j] in "ACGT":
                        out.append((i, name, r + j + 1, r + j + 2, "SUB", seq[q + j], float(ord(quals[q + j]) - 33), min(q + j, len(seq) - 1 - q - j)))
            if x == "I":
                out.append((i, name, r + 1, r + 1, "INS", seq[q : q + n], sum(ord(c) - 33 for c in quals[q : q + n]) / n, min(q, len(seq) - q - n)))
            if x == "D":
                side = quals[max(q - 1, 0) : q + 1]
                out.append((i, name, r + 1, r + n + 1, "DEL", "", sum(ord(c) - 33 for c in side) / max(len(side), 1), min(q, len(seq) - q)))
    return out


@pytest.mark.parametrize("tile", [7, 1000])
def test_alleles_by_walking_each_read(aligned, tile):
    contig, rows, aln, ref = aligned
    got = pileup.alleles(aln, ref, tile, more=()).collect()
    key = lambda x: tuple(round(v, 6) if isinstance(v, float) else v for v in x)
    assert sorted(map(key, got)) == sorted(map(key, shown(contig, rows)))
    assert pileup.alleles(aln.where("false"), ref, tile).count() == 0


@pytest.mark.parametrize("tile", [7, 1000])
def test_exact_codes(aligned, tile):
    contig, rows, aln, ref = aligned
    want = {}
    for row in rows:
        marks = ""
        for x, n, q, r in walked(row):
            text = contig if row[1] == "c" else ""
            marks += "".join("=" if r + j < len(text) and row[4][q + j] == text[r + j] else "X" for j in range(n)) if x == "M" else x * n
        if marks:
            want[row[0]] = "".join(f"{len(list(g))}{x}" for x, g in itertools.groupby(marks))
    assert {r["aln_id"]: r["cigar"] for r in pileup.exact_codes(aln, ref, tile).collect()} == want


def test_calls_and_depth(aligned):
    contig, rows, aln, ref = aligned
    depth, count = {}, {}
    for row in rows:
        for x, n, _, r in walked(row):
            for p in range(r, r + n) if x in "M=XD" else ():
                depth[row[1], p + 1] = depth.get((row[1], p + 1), 0) + 1
    for x in shown(contig, rows):
        count[x[1:6]] = count.get(x[1:6], 0) + 1
    got = pileup.call_alignments(aln, ref, min_count=1, min_fraction=0.0, tile=11).collect()
    assert len(got) == len(count)
    for r in got:
        chrom, start, stop = r["chrom"], r["start"], r["stop"]
        at = [depth.get((chrom, p), 0) for p in (range(start, stop) if stop > start else (start - 1, start))]
        mean = sum(at) / len(at) if stop > start else -(-sum(at) // 2)
        n = count[chrom, start, stop, r["type"], r["allele"]]
        assert (r["count"], r["plus"] + r["minus"]) == (n, n) and r["depth"] == pytest.approx(max(mean, n), abs=1e-5)


@pytest.mark.parametrize("tile", [5, 1000])
def test_rebuilt_sequences(spark, tile):
    rnd = random.Random(6)
    texts = {"a": some(rnd, 50), "b": some(rnd, 5), "c": "", "d": some(rnd, 10)}
    edits, want = [], {}
    for name, text in texts.items():
        at, out = 1, ""
        while at <= len(text):
            kind, n = rnd.randrange(3), rnd.randrange(1, 9)
            if kind == 0:
                put = some(rnd, rnd.randrange(4))
                stop = min(at + n, len(text) + 1)
                edits.append((name, at, stop, put))
                out, at = out + put, stop
            elif kind == 1:
                edits.append((name, at, at, "TT"))
                out += "TT" + text[at - 1]
                at += 1
            else:
                out, at = out + text[at - 1 : at - 1 + n], at + n
        edits.append((name, len(text) + 1, len(text) + 1, "GG"))
        edits.append((name, len(text) + 40, len(text) + 41, "lost"))
        want[name] = out + "GG"
    ref = spark.createDataFrame(list(texts.items()), "name string, bases string")
    got = pileup.rebuilt(ref, spark.createDataFrame(edits, "name string, start long, stop long, put string"), tile)
    assert {r["name"]: r["bases"] for r in got.collect()} == want
    cut = [(k, n, a, b) for k, (n, a, b) in enumerate((n, a, a + w) for n in texts for a in (1, 4, 9) for w in (0, 1, 6, 30))]
    got = pileup.cut_ranges(ref, spark.createDataFrame(cut, "k int, chrom string, start long, stop long"), ["k"], tile)
    assert {r["k"]: r["bases"] for r in got.collect()} == {k: texts[n][a - 1 : b - 1] for k, n, a, b in cut if texts[n][a - 1 : b - 1]}


def test_consensus_with_gaps(spark):
    ref = spark.createDataFrame([("c", "ACGTACGTACGTACGTACGT")], "name string, bases string")
    reads = [("20M", "ACGTACTTACGTACGTACGT"), ("20M", "ACGTACTTACGTACGTACGT"), ("10M2I10M", "ACGTACGTACGGGTACGTACGT"), ("10M2I10M", "ACGTACTTACGGGTACGTACGT"), ("10M2I4M3D3M", "ACGTACTTACGGGTACCGT"), ("14M3D3M", "ACGTACGTACGTACCGT"), ("14M3D3M", "ACGTACTTACGTACCGT"), ("10M2I4M3D3M", "ACGTACTTACGGGTACCGT"), ("10M2I4M3D3M", "ACGTACTTACGGGTACCGT")]
    aln = spark.createDataFrame([(i, "c", 1, c, s, "I" * len(s), 0, 9) for i, (c, s) in enumerate(reads)], ALN)
    for tile in (4, 1000):
        assert pileup.consensus_alignments(aln, ref, tile=tile).first()["bases"] == "ACGTACTTACGGGTACCGT"


def test_overlapping_variants_by_order(spark):
    rnd = random.Random(9)
    v = {("c", rnd.randrange(1, 60), "A" * rnd.randrange(1, 9), rnd.choice("CGT")): rnd.randrange(1, 9) for _ in range(80)}
    taken, kept = set(), []
    for (c, p, r, a), n in sorted(v.items(), key=lambda x: (-x[1], x[0][1:])):
        span = set(range(p, p + len(r)))
        if not span & taken:
            taken |= span
            kept.append((c, p, r, a, n))
    got = pileup.settle_overlaps(spark.createDataFrame([(*k, n) for k, n in v.items()], "chrom string, pos long, ref string, alt string, count long"))
    assert sorted(map(tuple, got.collect())) == sorted(kept)


def test_bad_reads(spark):
    ref = spark.createDataFrame([("c", "ACGTACGTACGTACGTACGT")], "name string, bases string")
    reads = ["ACGTACTTACGTACTTACGT", "ACGTACTTACGTACGTACGT", "CCGTACGTACGAACGTAGGA", "ACGTAGGTACCTACGTACGT"]
    aln = spark.createDataFrame([(i, "c", 1, "20M", s, "I" * 20, 0, 9) for i, s in enumerate(reads)], ALN)
    bad = lambda **x: sorted(map(tuple, pileup.filter_bad_reads(aln, ref, **x).collect()))
    assert bad(most=1, max_count=1, border=5) == [(3, 2)]
    assert bad(most=1, max_count=1, border=0) == [(2, 4), (3, 2)]
    assert bad(most=0, max_count=0, max_fraction=0.5, border=5) == [(0, 2), (1, 1), (2, 1), (3, 2)]


def unitig_sets(kmers, k):
    """Maximal non-branching paths over oriented k-mers by walking, one of each pair of strands."""
    nodes = set(kmers) | {rc(x) for x in kmers}
    plain = lambda a, b: a != b and rc(a) != b and rc(a) != a and rc(b) != b
    out, into = {}, {}
    for a in nodes:
        for c in "ACGT":
            if (b := a[1:] + c) in nodes:
                out.setdefault(a, []).append(b)
                into.setdefault(b, []).append(a)
    link = {a: bs[0] for a, bs in out.items() if len(bs) == 1 and len(into[bs[0]]) == 1 and plain(a, bs[0])}
    back = {b: a for a, b in link.items()}
    seen, found = set(), []
    for x in sorted(nodes):
        if x in seen:
            continue
        start = x
        while start in back and back[start] != x:
            start = back[start]
        start = x if start in back else start  # a circle
        path = [start]
        while path[-1] in link and link[path[-1]] != start:
            path.append(link[path[-1]])
        seen |= set(path)
        circle = path[-1] in link
        cut = min(range(len(path)), key=path.__getitem__) if circle else 0
        path = path[cut:] + path[:cut]
        found.append((path, circle))
    kept = []
    for path, circle in found:
        text = path[0] + "".join(p[-1] for p in path[1:])
        if (path[0] <= min(rc(p) for p in path)) if circle else (text <= rc(text)):
            kept.append((text, len(path)))
    return sorted(kept)


@pytest.mark.parametrize("k,seed", [(5, 1), (5, 2), (7, 3), (4, 4)])
def test_unitigs_on_both_strands(spark, k, seed):
    rnd = random.Random(seed)
    reads = [some(rnd, 40) for _ in range(3)]
    circle = some(rnd, 25)
    reads += [rc(reads[0][10:35]), reads[1][5:20] + some(rnd, 9), circle + circle[:k]]
    kmers = {r[i : i + k] for r in reads for i in range(len(r) - k + 1)}
    got = graphs.unitigs_both(spark.createDataFrame([(x,) for x in kmers], "kmer string"), k)
    rows = sorted(map(tuple, got.collect()))
    assert rows == unitig_sets(kmers, k)
    assert sum(n for _, n in rows) == len({min(x, rc(x)) for x in kmers})


def test_long_paths_are_put_together_from_pieces(spark, monkeypatch):
    monkeypatch.setattr(graphs, "PATH_PIECE", 7)
    text = some(random.Random(11), 200)
    kmers = spark.createDataFrame([(text[i : i + 15],) for i in range(186)], "kmer string")
    assert [tuple(r) for r in graphs.unitigs_both(kmers, 15).collect()] == [(min(text, rc(text)), 186)]


def test_spanning_forest_is_kruskal_s(spark):
    rnd = random.Random(12)
    edges = [(rnd.randrange(40), rnd.randrange(40), rnd.randrange(6)) for _ in range(90)] + [(100, 100, 9), (101, 102, 1)]
    best = {}
    for a, b, w in edges:
        if a != b:
            best[min(a, b), max(a, b)] = max(w, best.get((min(a, b), max(a, b)), -1))
    part, want = {}, []
    find = lambda x: x if part.setdefault(x, x) == x else find(part[x])
    for (a, b), w in sorted(best.items(), key=lambda x: (-x[1], x[0])):
        if find(a) != find(b):
            part[find(a)] = find(b)
            want.append((a, b, w))
    got = graphs.spanning_forest(spark.createDataFrame(edges, "a long, b long, w long"))
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert graphs.spanning_forest(got.where("false")).count() == 0


def test_closure_of_any_depth(spark):
    nodes = spark.createDataFrame([(0, 0), *[(i, i - 1) for i in range(1, 61)], (70, 99)], "id long, pid long")
    got = {(r["id"], r["ancestor"]): r["distance"] for r in graphs.tax_closure(nodes).collect()}
    assert got == {(i, j): i - j for i in range(61) for j in range(i + 1)} | {(70, 70): 0, (70, 99): 1}
    with pytest.raises(ValueError):
        graphs.tax_closure(spark.createDataFrame([(1, 2), (2, 1)], "id long, pid long"))


def test_inexact_containment_finds_all(spark):
    rnd = random.Random(13)
    long = {f"l{i}": some(rnd, 80) for i in range(4)}
    short = {}
    for i in range(24):
        s = list(long[f"l{i % 4}"][i : i + 30])
        for _ in range(i % 6):
            at = rnd.randrange(len(s))
            s[at : at + rnd.randrange(2)] = rnd.choice(["", "A", "C"])
        short[f"s{i}"] = rc("".join(s)) if i % 3 == 0 else "".join(s)
    every = long | short | {"n": "", "same": long["l0"]}
    want = set()
    for s, q in every.items():
        e = int(len(q) * 0.1 + 1e-9)
        for name, text in every.items():
            if len(q) > e and name != s and (len(text) > len(q) or (len(text) == len(q) and name < s)):
                if min(min(table(x, text, len(text))) for x in (q, rc(q))) <= e:
                    want.add((s, name))
    df = spark.createDataFrame(list(every.items()), "name string, bases string")
    assert {(r["s"], r["l"]) for r in sets.contained_near(df, 90, "name").collect()} == want
    assert {s for s, _ in want} >= {"same", "s0", "s1", "s2"}


def test_orfs_across_blocks_and_slices(spark, monkeypatch):
    monkeypatch.setattr(similarity, "ORF_BLOCK", 3)
    rnd = random.Random(14)
    rows = [("a", some(rnd, 700)), ("b", some(rnd, 5)), ("c", None), ("d", some(rnd, 400, "ACGTNU"))]
    want = set()
    back = str.maketrans("ACGTU", "TGCAA")
    for name, text in rows:
        for frame in range(6):
            s = ((text or "")[::-1].translate(back) if frame > 2 else text or "")[frame % 3 :]
            start = None
            for i in range(len(s) // 3):
                c = s[3 * i : 3 * i + 3]
                if c in ("TAA", "TAG", "TGA"):
                    if start is not None and (i - start + 1) * 3 >= 12:
                        want.add((name, frame, start, i))
                    start = None
                elif c in ("ATG", "GTG", "TTG") and start is None:
                    start = i
    got = similarity.find_orfs(spark.createDataFrame(rows, "name string, bases string"), 12)
    assert {tuple(r)[:4] for r in got.collect()} == want
    assert all(r["amino"].endswith("*") for r in got.collect())


def test_repeats_with_mismatches():
    rnd = random.Random(15)
    for _ in range(300):
        rep, d, mm = some(rnd, 24), rnd.randrange(40, 60), rnd.randrange(4)
        copy = list(rep)
        for _ in range(rnd.randrange(5)):
            copy[rnd.randrange(24)] = rnd.choice("ACGT")
        text = some(rnd, 30) + rep + some(rnd, d - 24) + "".join(copy) + some(rnd, 30)
        same = [text[t] == text[t + d] for t in range(len(text) - d)]
        for at in [t for t in range(len(same) - 8) if all(same[t : t + 8]) and (t == 0 or not same[t - 1])]:
            spans = [(x, y, same[x:y].count(False)) for x in range(at + 1) for y in range(at + 8, len(same) + 1) if same[x] and same[y - 1]]
            best = min((4 * w - (y - x), w, x, y) for x, y, w in spans if w <= mm)
            start, n, wrong = windows.extend_repeat(text, at, d, 8, mm, 500)
            assert (wrong, start, start + n) == best[1:]


def test_crispr_arrays_and_stems(spark):
    rnd = random.Random(16)
    rep = "GTTCCCACGTAACGTGGGAATTCA"
    spacers = [some(rnd, 20) for _ in range(4)]
    changed = [rep, rep, rep[:10] + "T" + rep[11:], rep, rep]
    text = some(rnd, 40) + "".join(r + s for r, s in zip(changed, [*spacers, ""], strict=True)) + some(rnd, 40)
    found = windows.find_crisprs(spark.createDataFrame([("s", text)], "name string, bases string"), repeat=(20, 40))
    pairs = {r["start"]: (r["repeat_length"], r["spacer_length"]) for r in found.collect()}
    assert all(any(abs(s - 40 - 44 * i) <= 3 for s in pairs) for i in range(4)) and all(n >= 24 for n, _ in pairs.values())
    assert max(r["stem"] for r in found.collect()) >= 7
    array = windows.crispr_arrays(found).orderBy(F.desc("copies")).first()
    assert abs(array["start"] - 40) <= 3 and array["copies"] == 5
    assert windows.stem_length("GGGAAAACCC") == 3 and windows.stem_length("A") == 0


def test_classes_with_edits(spark):
    rnd = random.Random(17)
    ref = some(rnd, 12)
    reads = {0: ref, 1: ref[:3] + rc(ref[3]) + ref[4:], 2: ref[:3] + rc(ref[3]) + ref[4:8] + rc(ref[8]) + ref[9:], 3: ref[:5] + ref[6:] + "A"}
    df = spark.createDataFrame(list(reads.items()), "ordinal long, bases string")
    refs = spark.createDataFrame([("r", ref)], "name string, bases string")
    hit = lambda **x: {r["read"] for r in joins.seal(df, refs, 12, **x).collect()}
    assert hit() == {0} and hit(hdist=1) >= {0, 1} and hit(hdist=2) >= {0, 1, 2} and hit(edist=1) >= {0, 1, 3}
