"""Column functions over bases, qualities, headers and alignment codes; all run inside Spark's own expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The IUPAC complements.
BASES, COMPLEMENT = "ACGTUacgtuMRYKVHDBmrykvhdb", "TGCAAtgcaaKYRMBDHVkyrmbdhv"
#: The standard genetic code, codons in the order of the bases TCAG.
CODON_LETTERS, AMINO = "TCAG", "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def revcomp(bases: Column) -> Column:
    return F.reverse(F.translate(bases, BASES, COMPLEMENT))


def canonical(kmer: Column) -> Column:
    """The least of a k-mer and its reverse complement."""
    return F.least(kmer, revcomp(kmer))


def normalize_bases(bases: Column, upper: bool = True, u_to_t: bool = True, ambiguous_to_n: bool = True, remap: str = "") -> Column:
    """Case, U to T, other symbols to N, and remap pairs such as "CTGN" (C to T, G to N)."""
    out = F.upper(bases) if upper else bases
    if u_to_t:
        out = F.translate(out, "Uu", "Tt")
    if ambiguous_to_n:
        out = F.regexp_replace(out, "[^ACGTNacgtn]", "N")
    if remap:
        out = F.translate(out, remap[::2], remap[1::2])
    return out


def count_of(bases: Column, symbols: str) -> Column:
    """How many of the symbols a sequence holds."""
    return F.length(bases) - F.length(F.translate(bases, symbols, ""))


def gc(bases: Column) -> Column:
    """Share of G and C among called bases; 0 without any."""
    called = count_of(bases, "ACGTacgt")
    return F.when(called > 0, count_of(bases, "GCgc") / called).otherwise(F.lit(0.0))


def letters(s: Column) -> Column:
    """The characters of a string as an array."""
    return F.filter(F.split(s, ""), lambda c: c != "")


def phred(quals: Column, offset: int = 33) -> Column:
    return F.transform(letters(quals), lambda c: F.ascii(c) - offset)


def expected_errors(quals: Column, offset: int = 33) -> Column:
    return F.aggregate(phred(quals, offset), F.lit(0.0), lambda s, q: s + F.pow(F.lit(10.0), -q / 10.0))


def average_quality(quals: Column, offset: int = 33) -> Column:
    """Phred value of the mean error probability."""
    return F.lit(-10.0) * F.log10(expected_errors(quals, offset) / F.length(quals))


def prob_correct(quals: Column, offset: int = 33) -> Column:
    return F.aggregate(phred(quals, offset), F.lit(1.0), lambda s, q: s * (1.0 - F.pow(F.lit(10.0), -q / 10.0)))


def recode_quality(bases: Column, quals: Column, lowest: int = 2, highest: int = 41, levels: list[int] | None = None, offset: int = 33) -> Column:
    """N gets 0, called bases lie in lowest..highest; with levels, the nearest level not above (else the first)."""

    def one(b: Column, q: Column) -> Column:
        v = F.greatest(F.least(q, F.lit(highest)), F.lit(lowest))
        if levels:
            steps = sorted(levels)
            out = F.lit(steps[0])
            for x in steps[1:]:
                out = F.when(v >= x, F.lit(x)).otherwise(out)
            v = out
        return F.char(F.when(b == "N", F.lit(0)).otherwise(v) + offset)

    return F.array_join(F.zip_with(letters(bases), phred(quals, offset), one), "")


def parse_header(name: Column) -> Column:
    """Struct of an instrument header: machine:run:flowcell:lane:tile:x:y, then pair:chastity:control:barcode."""
    head, tail = F.split(F.split_part(name, F.lit(" "), F.lit(1)), ":"), F.split(F.split_part(name, F.lit(" "), F.lit(2)), ":")
    at = lambda a, i, kind: F.get(a, F.lit(i)).try_cast(kind)
    return F.struct(
        F.get(head, F.lit(0)).alias("machine"), at(head, 1, "bigint").alias("run"), F.get(head, F.lit(2)).alias("flowcell"), at(head, 3, "bigint").alias("lane"),
        at(head, 4, "bigint").alias("tile"), at(head, 5, "bigint").alias("x"), at(head, 6, "bigint").alias("y"),
        at(tail, 0, "bigint").alias("pair"), F.get(tail, F.lit(1)).alias("chastity"), at(tail, 2, "bigint").alias("control"), F.get(tail, F.lit(3)).alias("barcode"),
    )


def bgi_to_illumina(name: Column, barcode: Column | None = None) -> Column:
    """"<flowcell>L<lane>C<column>R<row><tile>/<pair>" to the colon form; other names stay."""
    pattern = "^(.+)L([0-9]+)C([0-9]+)R([0-9]{3})([0-9]+)/([12])$"
    g = [F.regexp_extract(name, pattern, i) for i in range(1, 7)]
    num = lambda c: c.cast("bigint").cast("string")
    tail = [g[5], F.lit(":N:0:"), barcode if barcode is not None else F.lit("")]
    made = F.concat(g[0], F.lit(":0:"), g[0], F.lit(":"), num(g[1]), F.lit(":"), num(g[4]), F.lit(":"), num(g[2]), F.lit(":"), num(g[3]), F.lit(" "), *tail)
    return F.when(name.rlike(pattern), made).otherwise(name)


def header_tag(name: Column, tag: str, delimiter: str = " ") -> Column:
    """The text after "tag=" up to the delimiter; null without the tag."""
    found = F.substring_index(F.substring_index(name, f"{tag}=", -1), delimiter, 1)
    return F.when(F.contains(name, F.lit(f"{tag}=")), found)


def pad(bases: Column, left: int = 0, right: int = 0, symbol: str = "N") -> Column:
    return F.concat(F.lit(symbol * left), bases, F.lit(symbol * right))


def force_trim(s: Column, left: int = 0, right: int | None = None, right_cut: int = 0, modulo: int = 0) -> Column:
    """Keeps positions left..right (0-based, inclusive) less right_cut at the end, then a multiple of modulo."""
    n = F.length(s)
    end = F.least(n, F.lit(right + 1)) if right is not None else n
    size = F.greatest(end - left - right_cut, F.lit(0))
    if modulo:
        size = size - F.pmod(size, F.lit(modulo))
    return F.substring(s, F.lit(left + 1), size)


def hamming(a: Column, b: Column) -> Column:
    """Positions that differ; what one has beyond the other counts too."""
    return F.aggregate(F.zip_with(letters(a), letters(b), lambda x, y: (~x.eqNullSafe(y)).cast("int")), F.lit(0), lambda s, d: s + d)


def once(value: Column, of) -> Column:
    """of(value), the value worked out once: within a lambda a column's expression runs again for each element."""
    return F.transform(F.array(value), of)[0]


#: Codons of a text that are cut out together, as the cost of a substring grows with its place.
CODONS = 32


def translate_frame(bases: Column, frame: int) -> Column:
    """Amino acids of frame 0-2, or 3-5 on the reverse strand; codons with other symbols are X."""
    codes = F.create_map(*[F.lit(x) for i, a in enumerate(AMINO) for x in (CODON_LETTERS[i // 16] + CODON_LETTERS[i // 4 % 4] + CODON_LETTERS[i % 4], a)])
    count = lambda t: F.floor(F.length(t) / 3).cast("int")
    each = lambda n, of: F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), of), "")).otherwise(F.lit(""))
    codon = lambda t, i: F.coalesce(F.try_element_at(codes, F.substring(t, i * 3 + 1, F.lit(3))), F.lit("X"))
    part = lambda t: each(count(t), lambda i: codon(t, i))
    cut = lambda s, i: F.substring(s, i * 3 * CODONS + 1, F.lit(3 * CODONS))
    whole = lambda s: each(F.ceil(count(s) / CODONS).cast("int"), lambda i: once(cut(s, i), part))
    return once(F.substring(revcomp(bases) if frame > 2 else bases, F.lit(frame % 3 + 1), F.length(bases)), whole)


def cigar_ops(cigar: Column) -> Column:
    """Array of structs (n, op)."""
    return F.transform(F.regexp_extract_all(cigar, F.lit("([0-9]+[MIDNSHP=X])"), 1), lambda x: F.struct(F.regexp_extract(x, "^[0-9]+", 0).cast("bigint").alias("n"), F.right(x, F.lit(1)).alias("op")))


def cigar_sum(cigar: Column, ops: str) -> Column:
    return F.aggregate(F.filter(cigar_ops(cigar), lambda x: F.contains(F.lit(ops), x["op"])), F.lit(0).cast("bigint"), lambda s, x: s + x["n"])


def cigar_to_m(cigar: Column) -> Column:
    """"=" and "X" as "M", runs next to each other merged."""
    start = F.array().cast("array<struct<n:bigint,op:string>>")
    plain = F.transform(cigar_ops(cigar), lambda x: F.struct(x["n"].alias("n"), F.translate(x["op"], "=X", "MM").alias("op")))

    def add(s: Column, x: Column) -> Column:
        last = F.try_element_at(s, F.lit(-1))
        same = (F.size(s) > 0) & (last["op"] == x["op"])
        merged = F.concat(F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0))), F.array(F.struct((last["n"] + x["n"]).alias("n"), x["op"].alias("op"))))
        return F.when(same, merged).otherwise(F.concat(s, F.array(x)))

    return F.array_join(F.transform(F.aggregate(plain, start, add), lambda x: F.concat(x["n"].cast("string"), x["op"])), "")


def to_ascii(s: Column) -> Column:
    """Accents to plain letters where Latin-1 has them; other characters outside the printable ones to "?"."""
    plain = F.translate(s, "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜàáâãäåçèéêëìíîïñòóôõöùúûü", "AAAAAACEEEEIIIINOOOOOUUUUaaaaaaceeeeiiiinooooouuuu")
    return F.regexp_replace(plain, "[^\\x20-\\x7E]", "?")


def vector_distance(a: Column, b: Column, metric: str = "abs") -> Column:
    """abs, euclid, cosine or hellinger distance of two arrays of doubles."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    if metric == "abs":
        return total(F.zip_with(a, b, lambda x, y: F.abs(x - y)))
    if metric == "euclid":
        return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))
    if metric == "cosine":
        dot = total(F.zip_with(a, b, lambda x, y: x * y))
        norm = F.sqrt(total(F.transform(a, lambda x: x * x)) * total(F.transform(b, lambda x: x * x)))
        return F.lit(1.0) - dot / norm
    if metric == "hellinger":
        return F.sqrt(total(F.zip_with(a, b, lambda x, y: F.pow(F.sqrt(x) - F.sqrt(y), 2))) / 2)
    raise ValueError(metric)


#: Sequences are cut into pieces of so many k-mers, as the cost of a substring grows with its place.
PIECE = 2000


def pieces(bases: Column, k: int) -> Column:
    """Pieces (array of strings) that hold PIECE k-mers each, the last fewer; none for a sequence shorter than k."""
    n = F.length(bases) - (k - 1)
    cut = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / PIECE).cast("int")), lambda i: F.substring(bases, i * PIECE + 1, F.lit(PIECE + k - 1)))
    return F.when(n >= 1, cut).otherwise(F.array().cast("array<string>"))


def words(called: Column, k: int, rcomp: bool) -> Column:
    """All k-mers (array of strings) of a piece in which all that is not ACGT is N, canonical with rcomp: a k-mer's reverse
    complement is read from that of the piece, so no k-mer is turned around on its own."""
    n = F.length(called) - (k - 1)
    own = lambda i: F.substring(called, i, F.lit(k))
    if not rcomp:
        return F.transform(F.sequence(F.lit(1), n), own)
    back = F.reverse(F.translate(called, "ACGT", "TGCA"))
    return F.transform(F.array(back), lambda b: F.transform(F.sequence(F.lit(1), n), lambda i: F.least(own(i), F.substring(b, n - i + 1, F.lit(k)))))[0]


def kmers(bases: Column, k: int) -> Column:
    """All k-mers of ACGT only, in order (array of strings)."""
    each = F.transform(pieces(F.regexp_replace(bases, "[^ACGT]", "N"), k), lambda p: words(p, k, False))
    return F.filter(F.flatten(each), lambda x: ~F.contains(x, F.lit("N")))
