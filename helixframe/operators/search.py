"""Motifs, open reading frames, homopolymers and regular expressions. All are narrow: nothing is shuffled.

Lists are taken apart by outer generators, as for others Spark adds a filter that makes every list once more.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import groupby
from operator import add
from re import _parser as sre_parse

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions import sequences as S
from helixframe.functions.alphabet import IUPAC, STARTS, STOPS

#: Residues of a block, the unit in which parts of long strands are looked up; segments of a chunk, in which places are added up.
BLOCK, CHUNK = 4096, 100


class Motif:
    """An IUPAC pattern: upper-case places must match, lower-case ones may differ; a dot is N."""

    def __init__(self, pattern: str) -> None:
        self.text = pattern.replace(".", "N")
        if not 1 <= len(self.text) <= 256 or any(c.upper() not in IUPAC for c in self.text):
            raise ValueError(f"no IUPAC pattern of 1 to 256 places: {pattern!r}")

    def __len__(self) -> int:
        return len(self.text)

    def pattern(self, backwards: bool = False, ambiguous: bool = False) -> str:
        """Regular expression of windows that can match: A, C, G and T, those of the set at upper-case places; with ambiguous
        also the codes that stand for one of these."""
        codes = [c for c in IUPAC if ambiguous or c in "ACGT"]
        parts = ["[" + "".join(c for c in codes if p.islower() or _meet(p, c)) + "]" for p in self.text]
        return "".join(reversed(parts) if backwards else parts)

    def mismatches(self, window: Column) -> Column:
        """Lower-case places that differ, of a window that fits pattern()."""
        soft = [F.when(F.substring(window, j + 1, 1).isin(*IUPAC[c.upper()]), 0).otherwise(1) for j, c in enumerate(self.text) if c.islower()]
        return reduce(add, soft, F.lit(0))

    def by_place(self, window: Column, value: Callable[[str, str], str]) -> Column:
        """A character for each place of an upper-case window, from the pattern's letter and the window's code there."""
        codes, parts, at = "".join(IUPAC), [], 1
        for p, same in groupby(self.text):
            n = len(list(same))
            parts.append(F.translate(F.substring(window, at, n), codes, "".join(value(p, c) for c in codes)))
            at += n
        return F.concat(*parts)

    def first_expansion(self, window: Column, most: int) -> tuple[Column, Column, Column]:
        """Of an upper-case window that fits pattern(ambiguous=True): the fewest mismatches of its expansions, and those and
        the text of the first expansion, place by place in the codes' order, that has at most so many.

        Mismatches that no expansion avoids are set aside; as long as some of the others are left, a lower-case place takes
        its code's first base, and then the first that matches.
        """
        close = lambda p, c: (_meet(p, c) or IUPAC[c])[0]
        free = lambda p, c: IUPAC[c][0] if p.islower() else close(p, c)
        misses = lambda value: F.length(F.translate(self.by_place(window, value), "0", ""))
        extra = lambda p, c: "1" if _meet(p, c) and free(p, c) not in _meet(p, c) else "0"
        least = misses(lambda p, c: "0" if p.isupper() or _meet(p, c) else "1")
        if not most or self.text.isupper():
            return least, F.lit(0), self.by_place(window, close)
        spare = F.lit(most) - least
        # The place at which the last mismatch to spare is spent; beyond the window if some are left.
        last = F.when(spare > 0, F.length(F.call_function("substring_index", self.by_place(window, extra), F.lit("1"), spare)) + 1).otherwise(0)
        text = F.concat(F.substr(self.by_place(window, free), F.lit(1), last), F.substr(self.by_place(window, close), last + 1))
        return least, least + F.least(spare, misses(extra)), text


def _meet(place: str, code: str) -> str:
    """The bases, in the code's order, that a pattern's letter has in common with a code."""
    return "".join(b for b in IUPAC[code] if b in IUPAC[place.upper()])


def motif_hits(seqs: DataFrame, pattern: str, mismatches: int = 0, ambiguous: int = 0, bisulfite: int = 0, neighbours: int = 0, fixed: bool = False) -> DataFrame:
    """(seq_idx, header, pos, dir, left, match, right, n_mis, expansion, window): places of a motif on both strands.

    pos is 1-based on the given strand; window is the given strand there; left, match and right are in the direction of
    the hit. bisulfite searches the converted strands f and r and their complements u and v. With neighbours n, a hit
    needs n residues after it on the given strand; before it X fills up. ambiguous: so many ambiguity codes of the text may stand for
    whatever matches. Characters other than letters are passed over.
    """
    if mismatches < 0 or ambiguous < 0 or not 0 <= neighbours <= 50:
        raise ValueError("mismatches and ambiguous must be 0 or more, neighbours from 0 to 50")
    motif, n = Motif(pattern), neighbours
    size = len(motif)
    text = F.regexp_replace("seq", "[^A-Za-z]", "")
    comp = S.strict_complement
    # Strands, all from left to right as given; those that run backwards are searched with the motif turned round, so that
    # a window is only turned where it is a hit. They are searched in blocks that overlap by a window less one.
    top = F.col("top")
    if bisulfite:
        bis = lambda c: S.bisulfite(c, fixed and bisulfite == 2)
        other = F.reverse(bis(S.strict_reverse_complement(top)))
        strands = {"f": bis(top), "r": other, "u": comp(bis(top)), "v": comp(other)}
    else:
        strands = {"f": top, "r": comp(top)}
    backwards = {"r", "u"}
    core = lambda c: F.substring(c, n + 1, size)
    each = seqs.select("seq_idx", "header", text.alias("top"), F.explode(F.array(*map(F.lit, strands))).alias("dir"))
    strand = reduce(lambda out, d: out.when(F.col("dir") == d, strands[d]), list(strands)[1:], F.when(F.col("dir") == "f", strands["f"]))
    cut = lambda c: S.blocks(F.concat(F.lit("X" * n), c), 2 * n + size - 1, length=F.length("top") + n)
    pairs = each.select("seq_idx", "header", "dir", F.posexplode_outer(F.arrays_zip(cut(strand).alias("s"), cut(top).alias("t"))).alias("b", "p"))
    # A block is read to the end of its last window; windows that begin in the overlap don't fit into it.
    fits = F.when(F.col("dir").isin(*backwards), F.lit(motif.pattern(True, ambiguous > 0))).otherwise(F.lit(motif.pattern(False, ambiguous > 0)))
    windows = F.regexp_extract_all("p.s", F.concat(F.lit(f"(?is)(?=(.{{{n}}}"), fits, F.lit(f".{{{n}}}))|.")), F.lit(1))
    hits = pairs.select("seq_idx", "header", "dir", "b", F.col("p.t").alias("t"), F.posexplode_outer(windows).alias("i", "w")).where("w <> ''")
    places = hits.select("seq_idx", "header", "dir", (F.col("b") * S.BLOCK + F.col("i")).alias("at"), "w", F.substr("t", F.col("i") + n + 1, F.lit(size)).alias("window"))
    buf = F.when(F.col("dir").isin(*backwards), F.reverse("w")).otherwise(F.col("w"))
    places = places.select("seq_idx", "header", "window", "dir", (F.col("at") + 1).alias("pos"), buf.alias("text")).withColumn("up", F.upper(core(F.col("text"))))
    if ambiguous:
        least, n_mis, exp = motif.first_expansion(F.col("up"), mismatches)
        found = places.where((F.length(F.translate("up", "ACGT", "")) <= ambiguous) & (least <= mismatches)).withColumns({"n_mis": n_mis, "exp": exp})
    else:
        found = places.withColumns({"n_mis": motif.mismatches(F.col("up")), "exp": F.col("up")}).where(F.col("n_mis") <= mismatches)
    return found.select(
        "seq_idx", "header", "pos", "dir", F.substring("text", 1, n).alias("left"), core(F.col("text")).alias("match"), F.substring("text", n + size + 1, n).alias("right"),
        "n_mis", F.col("exp").alias("expansion"), "window",
    )


def open_reading_frames(seqs: DataFrame, min_length: int | None = None, starts: str | None = None, whole: bool = False, frames: tuple[str, ...] = S.FRAMES) -> DataFrame:
    """(seq_idx, header, frame, start, position, length, start_codon, stop_codon, orf): from the first start codon after a
    stop to the next stop, in each frame; length in nucleotides, without the stop, is 300 by default at least.

    Each frame's codons become a line of marks (S start, T stop, - other), block by block, and the line is cut behind each
    stop. Segments lie in chunks whose places are added up once, so a segment's place is that of its chunk and the few
    segments before it there: no window, no shuffle, no list longer than the segments. start counts from 0 on the strand, position from 1
    on the given strand. whole also reports what begins before or ends after the sequence, with ??? for a codon so near its end.
    """
    least = min_length or 300
    begins = set((starts or ",".join(STARTS)).upper().split(",")) - set(STOPS)
    if any(len(c) != 3 or set(c) - set("ACGT") for c in begins):
        raise ValueError(f"no codons: {starts}")
    mark = lambda c: F.when(c.isin(*STOPS), "T").when(c.isin(*begins), "S").otherwise("-")
    each = seqs.select("seq_idx", "header", F.length("seq").alias("size"), "seq", F.explode(F.array(*map(F.lit, frames))).alias("frame"))
    strand = F.when(F.startswith("frame", F.lit("F")), F.col("seq")).otherwise(S.strand(F.col("seq"), "R"))
    off = F.substring("frame", 2, 1).cast("int") - 1
    each = each.select("seq_idx", "header", "size", "frame", off.alias("off"), strand.alias("strand"))
    marks = S.by_codon(F.substr("strand", F.col("off") + 1), mark, F.col("size"))
    lines = each.select("seq_idx", "header", "size", "frame", "off", S.blocks(F.col("strand"), 0, BLOCK, F.col("size")).alias("blocks"), F.regexp_extract_all(marks, F.lit("[^T]*+(?:T|$)"), F.lit(0)).alias("segments"))
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size("segments") - 1) / CHUNK).cast("int")), lambda k: F.slice("segments", k * CHUNK + 1, CHUNK))
    lines = lines.select("seq_idx", "header", "size", "frame", "off", "blocks", F.when(F.size("segments") > 0, chunks).otherwise(F.array().cast("array<array<string>>")).alias("chunks"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
    places = F.aggregate("chunks", start, lambda a, c: F.struct((a["at"] + F.length(F.array_join(c, ""))).alias("at"), F.concat(a["all"], F.array(a["at"])).alias("all")), lambda a: a["all"])
    lines = lines.select("seq_idx", "header", "size", "frame", "off", "blocks", F.arrays_zip(places.alias("at"), F.col("chunks").alias("runs")).alias("chunks"))
    held = lines.select("seq_idx", "header", "size", "frame", "off", "blocks", F.explode_outer("chunks").alias("c"))
    found = held.select("seq_idx", "header", "size", "frame", "off", "blocks", "c", F.posexplode_outer("c.runs").alias("k", "run"))
    found = found.where(F.length("run") * 3 >= least)
    found = found if whole else found.where(F.endswith("run", F.lit("T")))
    at = F.col("c.at") + F.length(F.array_join(F.slice("c.runs", F.lit(1), F.col("k")), ""))
    segments = found.select("seq_idx", "header", "size", "frame", "off", "blocks", "run", at.alias("at"))
    skip = F.instr("run", "S") - 1
    skip = F.when(F.col("at") == 0, 0).otherwise(skip) if whole else skip
    size = F.col("size")
    orfs = segments.withColumns({"skip": skip, "codons": F.length("run") - F.when(F.endswith("run", F.lit("T")), 1).otherwise(0) - skip}).where((F.col("skip") >= 0) & (3 * F.col("codons") >= least))
    a, n = F.col("off") + 3 * (F.col("at") + F.col("skip")), 3 * F.col("codons")
    # Frame and stop, cut from the few blocks that hold them, however long the strand.
    first_block = F.floor(a / BLOCK).cast("int")
    near = F.array_join(F.slice("blocks", first_block + 1, F.floor((a + n + 2) / BLOCK).cast("int") - first_block + 1), "")
    orfs = orfs.select("seq_idx", "header", "size", "frame", a.alias("start"), n.alias("length"), F.substr(near, a - first_block * BLOCK + 1, n + 3).alias("piece"))
    a, n = F.col("start"), F.col("length")
    first, last = F.substring("piece", 1, 3), F.substr("piece", n + 1, F.lit(3))
    if whole:
        first, last = F.when(a < 3, "???").otherwise(first), F.when(a + n >= size - 3, "???").otherwise(last)
    return orfs.select(
        "seq_idx", "header", "frame", "start", F.when(F.startswith("frame", F.lit("F")), a + 1).otherwise(size - (a + n) + 1).alias("position"),
        "length", first.alias("start_codon"), last.alias("stop_codon"), F.substr("piece", F.lit(1), n).alias("orf"),
    )


def orf_header() -> Column:
    return F.concat_ws(" ", F.concat_ws("-", "frame", F.col("position").cast("string"), F.col("length").cast("string"), "start_codon", "stop_codon"), "header")


def longest_runs(seqs: DataFrame, base: str = "a", min_run: int | None = None, fixed: bool = False) -> DataFrame:
    """(seq_idx, header, length, left, remaining) of each record's longest run of a base that does not end the sequence.

    The first of equal runs wins; records without one have no row. left counts what precedes the run but leaves out what
    lies before runs that set no record; fixed counts all of it.
    """
    if len(base) != 1 or not base.isalpha():
        raise ValueError("base must be one letter")
    parts = lambda g: F.regexp_extract_all(F.lower("seq"), F.lit(f"\\G(.*?)({base.lower()}{{{min_run or 4},}})"), F.lit(g))
    begin = F.struct(*[F.lit(0).alias(x) for x in ("best", "left", "right", "at", "sum")], F.length("seq").alias("n"))

    def step(acc: Column, x: Column) -> Column:
        gap, run = F.length(x["gap"]), F.length(x["run"])
        after = acc["at"] + gap + run
        new = (run > acc["best"]) & (after < acc["n"])
        pick = lambda a, b: F.when(new, a).otherwise(b)
        kept = acc["sum"] + gap + run
        return F.struct(
            pick(run, acc["best"]).alias("best"), pick(acc["at"] + gap if fixed else kept - run, acc["left"]).alias("left"), pick(acc["n"] - after, acc["right"]).alias("right"),
            after.alias("at"), pick(kept, acc["sum"]).alias("sum"), acc["n"].alias("n"),
        )

    folded = F.aggregate(F.arrays_zip(parts(1).alias("gap"), parts(2).alias("run")), begin, step)
    out = seqs.where(S.is_set(F.col("header"))).withColumn("r", folded).where("r.best > 0")
    return out.select("seq_idx", "header", F.col("r.best").alias("length"), F.col("r.left").alias("left"), F.col("r.right").alias("remaining"))


#: What a pattern can hold that looks beyond its match, or at where the text begins.
_PLACED = re.compile(r"\(\?<[=!]|(?<!\[)\^|\\[AbBG]")
_AHEAD = re.compile(r"\(\?[=!]|\$|\\[zZ]")


def _widest(pattern: str) -> int | None:
    """The longest match that a pattern can have, or None if it has no bound, or looks ahead."""
    if _AHEAD.search(pattern):
        return None
    try:
        most = sre_parse.parse(pattern).getwidth()[1]
    except re.error:
        return None
    return most if 0 < most <= S.BLOCK else None


def _grouped(pattern: str) -> str:
    """The pattern as group 1, its backreferences counted on."""
    return "(" + re.sub(r"(\\\\)|\\([1-9])", lambda m: m[1] or f"\\{int(m[2]) + 1}", pattern) + ")"


def _restarted(pattern: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Matches as they are found by searching anew, in what follows the start of each match: there ^ holds again and nothing can
    be seen behind. For a pattern that looks there no position can be judged by itself."""
    known = re.compile(pattern.encode(), re.IGNORECASE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for idx, header, seq in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rest, at = memoryview((seq or "").encode()), 0  # slices of it are no copies
                while (m := known.search(rest)) and m.end() > m.start():
                    rows.append((idx, header, at + m.start(), bytes(rest[m.start() : m.end()]).decode()))
                    at, rest = at + m.start() + 1, rest[m.start() + 1 :]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["seq_idx", "header", "offset", "match"])

    return run


def regex_matches(seqs: DataFrame, pattern: str, every: bool = False) -> DataFrame:
    """(seq_idx, header, offset, length, match): the first match, or all, also overlapping ones. Case is ignored; matches
    are of the upper-case sequence. The search for all goes on behind the start of each match, where ^ holds again and
    look-behind sees nothing (such patterns go through Python); it ends at an empty match, and the first may be empty.

    Patterns of bounded length are looked up block by block; others make a list of the length of the sequence.
    """
    up = F.upper("seq")
    if not every:
        where, whole = F.regexp_instr(up, F.lit(f"(?i){pattern}")), F.regexp_extract(up, f"(?i){_grouped(pattern)}", 1)
        hits = seqs.select("seq_idx", "header", (where - 1).alias("offset"), whole.alias("match")).where("offset >= 0")
    elif _PLACED.search(pattern):
        hits = seqs.select("seq_idx", "header", up.alias("seq")).mapInArrow(_restarted(pattern), "seq_idx long, header string, offset int, match string")
    else:
        most = _widest(pattern)
        size, overlap = (S.BLOCK, most - 1) if most else (2**30, 0)
        cut = seqs.select("seq_idx", "header", F.posexplode_outer(S.blocks(up, overlap, size, F.length("seq")) if most else F.array(up)).alias("b", "block"))
        places = F.regexp_extract_all("block", F.lit(f"(?i)(?={_grouped(pattern)})|(?s:.)"), F.lit(1))
        hits = cut.select("seq_idx", "header", "b", F.posexplode_outer(places).alias("i", "match")).where((F.length("match") > 0) & (F.col("i") < size))
        hits = hits.select("seq_idx", "header", (F.col("b") * size + F.col("i")).alias("offset"), "match")
    return hits.select("seq_idx", "header", "offset", F.length("match").alias("length"), "match")


def regex_counts(seqs: DataFrame, pattern: str) -> DataFrame:
    """(seq_idx, header, n): overlapping matches of each record, found as in regex_matches(), also where there are none."""
    if _PLACED.search(pattern):
        found = regex_matches(seqs, pattern, every=True).groupBy("seq_idx").agg(F.count(F.lit(1)).alias("n"))
        return seqs.select("seq_idx", "header").join(found, "seq_idx", "left").fillna(0, ["n"])
    most = _widest(pattern)
    up = F.upper("seq")
    size, overlap = (S.BLOCK, most - 1) if most else (2**30, 0)
    places = lambda b: F.regexp_extract_all(b, F.lit(f"(?i)(?={_grouped(pattern)})|(?s:.)"), F.lit(1))
    # Marks of the places of a block alone: 1 where a match begins.
    n = F.aggregate(S.blocks(up, overlap, size, F.length("seq")) if most else F.array(up), F.lit(0).cast("long"), lambda a, b: a + F.size(F.filter(F.slice(places(b), 1, size), lambda m: F.length(m) > 0)))
    return seqs.select("seq_idx", "header", F.coalesce(n, F.lit(0)).alias("n"))
