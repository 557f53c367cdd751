"""Scalars over one sequence, as Column expressions that stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from helixframe.functions.alphabet import CODE, COMPLEMENT_FROM, COMPLEMENT_TO

FRAMES = ("F1", "F2", "F3", "R1", "R2", "R3")
#: Residues of a block, the unit in which long sequences are worked on; a multiple of 3, so that no codon is cut.
BLOCK = 49_152
#: Stands for "no limit" in headers of truncated sequences.
UNBOUNDED = 1_000_000_000


def clean(raw: Column, case: str | None = None, strip_digits: bool = False) -> Column:
    """The residues of raw record text: white space removed, digits that lead a line removed, case changed if asked."""
    lines = F.regexp_replace(raw, "[ \\t\\r\\f]", "")
    if strip_digits:
        lines = F.regexp_replace(lines, "(?m)^\\d+", "")
    joined = F.replace(lines, F.lit("\n"), F.lit(""))
    return {"upper": F.upper, "lower": F.lower, None: lambda c: c}[case](joined)


def is_set(header: Column) -> Column:
    """True unless the header is empty or "0", as those tools see it that skip such records."""
    return ~F.coalesce(header, F.lit("")).isin("", "0")


def as_dna(seq: Column) -> Column:
    """U read as T."""
    return F.translate(seq, "Uu", "Tt")


def reverse_complement(seq: Column, rna: bool = False) -> Column:
    """IUPAC complement, both cases; other characters (U among them, unless rna) stay."""
    return F.translate(F.reverse(as_dna(seq) if rna else seq), COMPLEMENT_FROM, COMPLEMENT_TO)


def strict_complement(seq: Column) -> Column:
    """Complement in place; whatever is no IUPAC code becomes X."""
    return F.translate(F.regexp_replace(seq, f"[^{COMPLEMENT_FROM}]", "X"), COMPLEMENT_FROM, COMPLEMENT_TO)


def strict_reverse_complement(seq: Column) -> Column:
    return F.reverse(strict_complement(seq))


def bisulfite(seq: Column, keep_cpg: bool = False) -> Column:
    """C read as T; other IUPAC codes stay, the rest becomes X. keep_cpg leaves the C of CG as it is."""
    known = F.regexp_replace(seq, f"[^{COMPLEMENT_FROM}]", "X")
    if keep_cpg:
        return F.regexp_replace(F.regexp_replace(known, "C(?![Gg])", "T"), "c(?![Gg])", "t")
    return F.translate(known, "Cc", "Tt")


def strand(seq: Column, direction: str) -> Column:
    return seq if direction == "F" else reverse_complement(seq)


def blocks(seq: Column, overlap: int = 0, size: int = BLOCK, length: Column | None = None) -> Column:
    """The sequence in blocks of `size` residues, each with the next `overlap` residues behind it; an empty one has none.

    Whatever makes a list of residues, words or codons makes it of one block at a time, however long the sequence. length
    spares making a costly `seq` more than once; one that is too large does no harm, but for an empty block.
    """
    n = F.length(seq) if length is None else length
    cut = F.regexp_extract_all(seq, F.lit(f"(?s)(?=(.{{1,{size + overlap}}})).{{1,{size}}}"), F.lit(1))
    return F.when(n <= 0, F.array().cast("array<string>")).when(n <= size, F.array(seq)).otherwise(cut)


def from_offset(seq: Column, offset: int) -> Column:
    return F.substring(seq, offset + 1, 2**31 - 1) if offset else seq


def codons(seq: Column) -> Column:
    """Whole codons, in upper case."""
    return F.regexp_extract_all(F.upper(seq), F.lit("(?s).{3}"), F.lit(0))


def by_codon(seq: Column, mark: Callable[[Column], Column], length: Column | None = None) -> Column:
    """A mark for each whole codon, as one string, made block by block."""
    return F.array_join(F.transform(blocks(seq, length=length), lambda b: F.array_join(F.transform(codons(b), mark), "")), "")


def genetic_code() -> Column:
    """Amino acids by the first two residues, then by codon: maps are searched entry by entry, so two small ones are faster."""
    under = lambda two: F.create_map(*[F.lit(x) for codon, acid in CODE.items() if codon[:2] == two for x in (codon, acid)])
    return F.create_map(*[x for two in sorted({c[:2] for c in CODE}) for x in (F.lit(two), under(two))])


def translated(seq: Column, frame: str) -> Column:
    """Protein of a frame F1..F3, R1..R3: X for unknown codons, * for stops; a partial last codon is dropped."""
    if frame not in FRAMES:
        raise ValueError(f"no frame {frame}")
    acid = lambda c: F.coalesce(F.try_element_at(F.try_element_at(genetic_code(), F.substring(c, 1, 2)), c), F.lit("X"))
    return by_codon(from_offset(strand(seq, frame[0]), int(frame[1]) - 1), acid, F.length(seq))


def cut_out(seq: Column, begin: Column, length: Column | None = None) -> Column:
    """begin counts from 0, or from the end if negative; a negative length leaves that many residues off the end. What
    lies outside is clipped."""
    n = F.length(seq)
    first = F.when(begin < 0, n + begin).otherwise(begin)
    last = n if length is None else F.when(length < 0, n + length).otherwise(first.cast("long") + length)
    low, high = F.greatest(first, F.lit(0)), F.least(last.cast("long"), n.cast("long"))
    return F.when(high > low, F.substr(seq, low + 1, (high - low).cast("int"))).otherwise("")


def without_stop(seq: Column) -> Column:
    return F.regexp_replace(seq, "\\*$", "")


def digest(seq: Column, base64: bool = False) -> Column:
    """MD5 of the upper-case sequence without a last *; hexadecimal, or base 64 without padding."""
    hexadecimal = F.md5(without_stop(F.upper(seq)))
    return F.rtrim(F.base64(F.unhex(hexadecimal)), F.lit("=")) if base64 else hexadecimal


def cigar_length(cigar: Column, fixed: bool = False) -> Column:
    """Reference bases of an alignment. M, N and I add and D subtracts; fixed counts M, D, N, = and X instead. Anything else
    raises an error (fixed: S, H, P and I count nothing, and * is null)."""
    parts = F.regexp_extract_all(cigar, F.lit("\\d+[A-Z=]"), F.lit(0))
    size = lambda p: F.regexp_extract(p, "^\\d+", 0).cast("long")
    op = lambda p: F.right(p, F.lit(1))
    if fixed:
        total = F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a + F.when(op(p).isin("M", "D", "N", "=", "X"), size(p)).otherwise(0))
        return F.when(cigar.rlike("^(\\d+[MIDNSHP=X])+$"), total)
    total = F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a + F.when(op(p) == "D", -size(p)).otherwise(size(p)))
    return F.when(cigar.rlike("^(\\d+[MIDN])+$"), total).otherwise(F.raise_error(F.concat(F.lit("cigar not understood: "), F.coalesce(cigar, F.lit("null")))).cast("long"))


def record_id(header: Column) -> Column:
    """First word of a header; a header that begins with white space has the id ""."""
    return F.regexp_extract(header, "^(\\S*)", 1)


def read_id(header: Column) -> Column:
    """Id of a read, without the /1 or /2 of its pair."""
    return F.regexp_replace(record_id(header), "/[12]$", "")


def highlighted(seq: Column, pattern: str) -> Column:
    """Lower case, with the first match of the pattern in upper case."""
    low, at = F.lower(seq), F.regexp_instr(seq, F.lit(f"(?i)({pattern})"))
    n = F.length(F.regexp_extract(seq, f"(?i)({pattern})", 1))
    return F.when(at > 0, F.concat(F.substr(low, F.lit(1), at - 1), F.upper(F.substr(low, at, n)), F.substr(low, at + n))).otherwise(low)


def decoded(code: Column, k: int) -> Column:
    """The word of k nucleotides that a number stands for, two bits each, A0 C1 G2 T3."""
    return F.concat(*[F.substr(F.lit("ACGT"), (F.shiftright(code, 2 * j).bitwiseAND(F.lit(3)) + 1).cast("int"), F.lit(1)) for j in reversed(range(k))])


def encoded(word: Column, k: int) -> Column:
    """The number of a word of A, C, G and T."""
    place = lambda j: (F.instr(F.lit("ACGT"), F.substring(word, j + 1, 1)) - 1).cast("long")
    total = place(0)
    for j in range(1, k):
        total = total * 4 + place(j)
    return total


def wrapped(seq: Column, width: int) -> Column:
    return F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n")


def fasta(header: Column, seq: Column, width: int | None = 60) -> Column:
    """A record as text; width None keeps the sequence on one line; an empty sequence has no line."""
    body = seq if width is None else wrapped(seq, width)
    return F.concat(F.lit(">"), header, F.when(body != "", F.concat(F.lit("\n"), body)).otherwise(""))


def fastq(header: Column, seq: Column, qheader: Column, qual: Column) -> Column:
    return F.concat_ws("\n", header, seq, qheader, qual)


def pretty(header: Column, seq: Column, line: int = 50, spacer: int = 10, digits: int = 10, numbers: bool = True) -> Column:
    """Numbered lines, with a space after every `spacer` residues counted over the whole sequence, none at a line's end."""
    n = F.length(seq)
    number = lambda j: F.format_string(f"%{digits}d ", j * line + 1) if numbers else F.lit("")

    def body(j: Column) -> Column:
        part = F.substr(seq, j * line + 1, F.lit(line))
        if line % spacer == 0:
            marked = F.regexp_replace(part, f"(.{{{spacer}}})", "$1 ")
            return F.when(F.length(part) == line, F.rtrim(marked)).otherwise(marked)
        places = F.sequence(F.lit(1), F.length(part))
        space = lambda i: F.when(((j * line + i) % spacer == 0) & (i < line), F.lit(" ")).otherwise("")
        return F.array_join(F.transform(places, lambda i: F.concat(F.substr(part, i, F.lit(1)), space(i))), "")

    lines = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / line).cast("int")), lambda j: F.concat(number(j), body(j)))
    empty = F.array(F.rtrim(number(F.lit(0))))
    return F.concat_ws("\n", F.concat(F.lit(">"), header), F.array_join(F.when(n > 0, lines).otherwise(empty), "\n"))
