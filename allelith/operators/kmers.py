"""k-mers of sequences: windows, encoding, strands, counts, sketches and membership.

A k-mer is a BIGINT with two bits a base (a=0, c=1, g=2, t=3), the first base highest, so k is 31 at most. Sequences are
cut into short overlapping pieces first, each packed into two numbers of which every window is a shift and a mask: the
work for a base doesn't depend on the sequence's length, and no window makes a string.
"""

from __future__ import annotations

from ..plans.relation import Op

MAX_K = 31
#: Windows that begin in a piece; with the MAX_K - 1 bases that follow, a piece fills two numbers.
PIECE = 31


def windows(k: int, source: str, keys: str, place: str = "pos") -> str:
    """SQL of (keys, place, kmer) for each window of k bases that are all a, c, g or t of {source}(keys, seq)."""
    if not 1 <= k <= MAX_K:
        raise ValueError(f"k must be 1 to {MAX_K}, as a k-mer is a BIGINT")
    return f"""select {keys}, {PIECE} * j + p - 1 as {place}, @window(hi; lo; p; {k}) as kmer
        from (
          select {keys}, j, hi, lo, others, piece, @each(1; least({PIECE}, length(piece) - {k - 1})) as p
          from (
            select {keys}, j, piece, others, @packed(case when others = 0 then piece else @strip_other(piece) end; hi; lo) from (
              select {keys}, j, piece, length(translate(piece, '0123', '')) as others
              from (select {keys}, @poseach(@pieces(@digits(seq); {PIECE}; {k - 1}); j; piece) from {source} where length(seq) >= {k}) a where length(piece) >= {k}
            ) b
          ) c
        ) d where others = 0 or length(translate(substr(piece, cast(p as int), {k}), '0123', '')) = 0"""


def kmers(k: int = 11, source: str = "reads", key: str = "read_id") -> Op:
    return Op(f"kmers{k}", source, windows(k, f"{{{source}}}", key), "F1, W9: (key, pos, kmer).")


def kmer_text(k: int = 11) -> Op:
    """the bases of a k-mer."""
    bases = ", ".join(f"substr('acgt', cast(1 + cast(floor(kmer / {4 ** (k - 1 - j)}) as bigint) % 4 as int), 1)" for j in range(k))
    return Op("kmer_text", "counts", f"select kmer, n, concat({bases}) as bases from {{counts}}")


reverse_complement = Op("reverse_complement", "reads", "select read_id, reverse(translate(seq, 'acgt', 'tgca')) as seq from {reads}", "F3: the other strand.")
kmer_count = Op("kmer_count", "kmers", "select kmer, count(*) as n from {kmers} group by kmer", "A5: occurrences of each k-mer; partial counts before the shuffle.")
both_strands = Op("both_strands", "forward backward", "select * from {forward} union all select * from {backward}", "U4.")


def both_ways(k: int = 11) -> Op:
    """U4: k-mers and those of the other strand, without their sequences."""
    back = " + ".join(f"(3 - cast(floor(kmer / {4**j}) as bigint) % 4) * {4 ** (k - 1 - j)}" for j in range(k))
    return Op("both_ways", "kmers", f"select @unnest(@array(kmer, {back})) as kmer from {{kmers}}")


def approx_counter(modulo: int = 20011, most: int = 255) -> Op:
    """Saturating counts of k-mers by bucket kmer mod modulo."""
    return Op("approx_counter", "kmers", f"select kmer % {modulo} as bucket, least({most}, count(*)) as n from {{kmers}} group by kmer % {modulo}")


def min_count_sketch(moduli: tuple[int, ...] = (8191, 9973, 12007, 13001)) -> Op:
    """A2: each k-mer's least count over the rows of a count-min sketch, one row for each modulus. k-mers are counted once; the
    sketch has as many cells as the moduli sum to, whatever the input."""
    return Op(
        "min_count_sketch",
        "kmers",
        f"""with counted as (select kmer, count(*) as n from {{kmers}} group by kmer),
        dealt as (select kmer, n, @unnest(@array({", ".join(map(str, moduli))})) as m from counted),
        cell as (select m, kmer % m as bucket, cast(sum(n) as bigint) as n from dealt group by m, kmer % m)
        select d.kmer, min(c.n) as est from dealt d join cell c on c.m = d.m and c.bucket = d.kmer % d.m group by d.kmer""",
    )


def modulo_filter(modulo: int = 200003) -> Op:
    """Counted k-mers whose bucket some index k-mer shares (no false negatives)."""
    return Op(
        "modulo_filter", "counts index", f"select kmer, n from {{counts}} c where exists (select 1 from (select distinct kmer % {modulo} as b from {{index}}) i where i.b = c.kmer % {modulo})"
    )


has_kmer = Op("has_kmer", "counts index", "select kmer, n from {counts} c where exists (select 1 from {index} i where i.kmer = c.kmer)", "J2, exact: a left semi join.")
unique_kmers = Op("unique_kmers", "counts index", "select kmer, n from {counts} c where not exists (select 1 from {index} i where i.kmer = c.kmer)", "U3: a left anti join.")
shared_kmers = Op(
    "shared_kmers",
    "signatures",
    """select site_id, count(*) as n_shared from (select site_id, kmer from (select distinct site_id, allele, kmer from {signatures}) a group by site_id, kmer having count(*) > 1) b group by site_id""",
    "J13, U2: k-mers that several alleles of a site share.",
)
shared_anywhere = Op(
    "shared_anywhere",
    "signatures",
    """select distinct r.site_id, r.kmer from {signatures} r where r.allele = 0 and exists (select 1 from {signatures} a where a.allele > 0 and a.kmer = r.kmer)""",
    "J13, the global form: reference k-mers that an alternative of any site has too.",
)
node_counts = Op(
    "node_counts",
    "counts index nodes",
    """select v.node_id, coalesce(f.n, 0) as n from {nodes} v left join (
         select i.node_id, cast(sum(c.n) as bigint) as n from {counts} c join {index} i on i.kmer = c.kmer group by i.node_id
       ) f on f.node_id = v.node_id""",
    "J1, J3: read k-mers, counted first, joined with the index and summed by node; nodes without reads get 0.",
)
