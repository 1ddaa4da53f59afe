"""Sequences, alignments and regions as Column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

from clonarium.functions.distance import IUPAC

# Amino acids of the standard code, codons in the order TCAG.
STANDARD = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
BASES = "TCAG"
CODES = "".join(IUPAC)

# Where regions begin, in codons of the numbering, by definition.
REGION_STARTS = {
    "default": {"fwr1": 1, "cdr1": 27, "fwr2": 39, "cdr2": 56, "fwr3": 66, "cdr3": 105},
    "rhesus-igl": {"fwr1": 1, "cdr1": 28, "fwr2": 40, "cdr2": 59, "fwr3": 69, "cdr3": 108},
}
# Codons that stop for all of their bases.
STOPS = ("TAA", "TGA", "TAG", "TRA", "TRG", "TAR", "TGR", "TRR")
#: (F|W)GXG in nucleotides: where a J segment's junction part ends.
J_MOTIF = r"T(TT|TC|GG)GG[ACGT]{4}GG[AGCT]"


def codon_table() -> str:
    """Amino acids of all codons of nucleotide codes, in the order of ``CODES`` at each place: what all readings agree on, else B, Z, J or X."""
    single = {"".join(c): a for c, a in zip(product(BASES, repeat=3), STANDARD, strict=True)}
    shared = {frozenset("DN"): "B", frozenset("EQ"): "Z", frozenset("IL"): "J"}
    out = []
    for codon in product(CODES, repeat=3):
        made = frozenset(single["".join(c)] for c in product(*(IUPAC[x] for x in codon)))
        out.append(next(iter(made)) if len(made) == 1 else shared.get(made, "X"))
    return "".join(out)


CODONS = codon_table()


def _sql(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def translate(sequence: Column | str) -> Column:
    """Amino acids of whole codons; a rest of one or two letters is left out. Codons with other letters give X.

    The text is cut into codons once, and each is looked up by the places of its letters' codes. Both tables are constants of the plan.
    """
    s = F.upper(_sql(sequence))
    n = len(CODES)
    amino = F.split(F.lit(CODONS), "")

    def letter(codon: Column) -> Column:
        place = [F.instr(F.lit(CODES), F.substring(codon, k, 1)) - 1 for k in (1, 2, 3)]
        return F.when((place[0] >= 0) & (place[1] >= 0) & (place[2] >= 0), F.get(amino, (place[0] * n + place[1]) * n + place[2])).otherwise("X")

    return F.array_join(F.transform(F.regexp_extract_all(s, F.lit("(?s).{3}"), F.lit(0)), letter), "")


def reverse_complement(sequence: Column | str) -> Column:
    return F.reverse(F.translate(_sql(sequence), "ACGTRYSWKMBDHVNacgtryswkmbdhvn", "TGCAYRSWMKVHDBNtgcayrswmkvhdbn"))


def first_stop(sequence: Column | str) -> Column:
    """Place (from 0) of the first codon of frame 1 that is surely a stop; -1 without one."""
    s = _sql(sequence)
    count = F.ceil(F.length(s) / 3).cast("int")
    codons = F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: F.substring(s, i * 3 + 1, F.lit(3)).isin(*STOPS))
    at = F.array_position(codons, F.lit(True))
    return F.when(s.isNotNull(), F.when((F.length(s) > 0) & (at > 0), (at - 1) * 3).otherwise(-1)).cast("int")


def unlike_places(a: Column | str, b: Column | str) -> Column:
    """Places where both have a letter that is no N or gap, and the letters differ. Unequal lengths raise."""
    a, b = _sql(a), _sql(b)
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (~x.isin("N", "-", ".", "") & ~y.isin("N", "-", ".", "") & (x != y)).cast("int"))
    count = F.when(F.length(a) == 0, 0).otherwise(F.aggregate(pairs, F.lit(0), lambda s, x: s + x))
    return F.when(F.length(a) == F.length(b), count).otherwise(F.raise_error(F.lit("sequences must have equal lengths")).cast("int"))


def missing_letters(sequence: Column | str) -> Column:
    return F.length(F.regexp_replace(_sql(sequence), "[ACGT]", ""))


def gaps_to_n(sequence: Column | str) -> Column:
    return F.translate(_sql(sequence), "-.", "NN")


def trim_n(sequence: Column | str) -> Column:
    return F.regexp_replace(_sql(sequence), "^N+|N+$", "")


def clean_id(name: Column | str) -> Column:
    """For tree files: , : ) ( become dashes and spaces underscores."""
    return F.translate(_sql(name), ",:)( ", "----_")


def clean_metadata(value: Column | str) -> Column:
    return F.replace(_sql(value), F.lit("_"), F.lit(""))


# Alignments: arrays of (op, len).


def _operation(op: str, size: Column) -> Column:
    return F.struct(F.lit(op).alias("op"), size.cast("int").alias("len"))


def decode_btop(btop: Column | str) -> Column:
    """Digits are matches; pairs of letters are mismatches, insertions (-A) or deletions (A-). Neighbours of a kind are one operation."""
    marked = F.regexp_replace(_sql(btop), r"(\d+|[-A-Z]{2})", "$1;")
    runs = F.regexp_extract_all(marked, F.lit(r"\d+;|(?:[A-Z]{2};)+|(?:-[A-Z];)+|(?:[A-Z]-;)+"), F.lit(0))

    def operation(run: Column) -> Column:
        text = F.replace(run, F.lit(";"), F.lit(""))
        half = F.length(text) / 2
        return (
            F.when(text.rlike(r"^\d"), _operation("=", text.try_cast("int")))
            .when(text.startswith("-"), _operation("I", half))
            .when(F.substring(text, 2, 1) == "-", _operation("D", half))
            .otherwise(_operation("X", half))
        )

    return F.transform(runs, operation)


def decode_cigar(cigar: Column | str, compat: bool = False) -> Column:
    """``compat`` leaves out ``=`` operations, as tools do that know letters only."""
    letters = "[A-Z]" if compat else "[A-Z=]"
    found = F.regexp_extract_all(_sql(cigar), F.lit(rf"\d+{letters}"), F.lit(0))
    return F.transform(found, lambda x: F.struct(F.right(x, F.lit(1)).alias("op"), F.regexp_extract(x, r"^\d+", 0).cast("int").alias("len")))


def encode_cigar(alignment: Column | str) -> Column:
    return F.array_join(F.transform(_sql(alignment), lambda x: F.concat(x["len"].cast("string"), x["op"])), "")


def pad_alignment(alignment: Column | str, query: Column, reference: Column) -> Column:
    """Adds to the soft clip (S) and to the reference skip (N) at the start, or puts them there; S stands before N. An empty alignment raises."""
    a = _sql(alignment)
    a = F.when(F.size(a) > 0, a).otherwise(F.raise_error(F.lit("the alignment is empty")).cast("array<struct<op:string,len:int>>"))
    op = lambda i: F.try_element_at(a, F.lit(i))
    clipped = op(1)["op"] == "S"
    second = F.when(clipped, op(2)).otherwise(op(1))
    skipped = F.coalesce(second["op"] == "N", F.lit(False))
    clip = F.when(clipped, op(1)["len"]).otherwise(0) + query
    skip = F.when(skipped, second["len"]).otherwise(0) + reference
    rest = F.slice(a, clipped.cast("int") + skipped.cast("int") + 1, F.size(a))
    head = F.filter(F.array(F.struct(F.lit("S").alias("op"), clip.cast("int").alias("len"), (clipped | (query > 0)).alias("on")), F.struct(F.lit("N").alias("op"), skip.cast("int").alias("len"), (skipped | (reference > 0)).alias("on"))), lambda x: x["on"])
    return F.concat(F.transform(head, lambda x: F.struct(x["op"].alias("op"), x["len"].alias("len"))), rest)


def alignment_positions(alignment: Column | str) -> Column:
    """q_start, q_length, r_start, r_length; starts from 0, out of S and N at the start."""
    a = _sql(alignment)
    op = lambda i: F.try_element_at(a, F.lit(i))
    total = lambda ops: F.aggregate(F.filter(a, lambda x: x["op"].isin(*ops)), F.lit(0), lambda s, x: s + x["len"])
    second = F.when(op(1)["op"] == "S", op(2)).otherwise(op(1))
    return F.struct(
        F.when(op(1)["op"] == "S", op(1)["len"]).otherwise(0).alias("q_start"),
        total(["M", "=", "X", "I"]).alias("q_length"),
        F.when(second["op"] == "N", second["len"]).otherwise(0).alias("r_start"),
        total(["M", "=", "X", "D"]).alias("r_length"),
    )


# Numbering and regions.


def gap_positions(reference: Column | str) -> Column:
    """Places (from 0) of the gaps of a numbered reference."""
    s = _sql(reference)
    return F.when(s.isNotNull(), F.filter(F.transform(F.split(s, ""), lambda x, i: F.when(x == ".", i)), lambda x: x.isNotNull()))


def gap_v(sequence: Column | str, germ_start: Column, germ_length: Column, reference: Column | str) -> Column:
    """(sequence, start, length) with the reference's gaps put in; null without a reference.

    The sequence is set back by dots to the reference's start. Gaps of the reference go in, from the left, as long as they lie within the
    aligned part as it has grown so far. With p the place of the i-th gap (from 0), that is p < length + start - 1 + i;
    as places ascend by 1 at least, the gaps that go in are the first ones.
    """
    s, germ_start, germ_length, ref = _sql(sequence), germ_start.cast("int"), germ_length.cast("int"), _sql(reference)
    lead = germ_start - 1
    base = F.concat(F.repeat(F.lit("."), lead), s)
    gaps = gap_positions(ref)
    # Places ascend at least as fast as their rank, so the condition holds for a first stretch only: count up to the first failure.
    fails = F.array_position(F.transform(gaps, lambda p, i: p >= germ_length + lead + i), F.lit(True))
    used = F.slice(gaps, F.lit(1), F.when(fails > 0, fails - 1).otherwise(F.size(gaps)).cast("int"))
    # Cut the sequence before each gap: the i-th cut, in letters of the sequence without gaps, is p - i.
    cuts = F.transform(used, lambda p, i: p - i)
    pieces = F.transform(F.concat(F.array(F.lit(0)), cuts), lambda c, i: F.when(i < F.size(cuts), F.substring(base, c + 1, F.get(cuts, i) - c)).otherwise(F.substring(base, c + 1, F.length(base))))
    gapped = F.array_join(pieces, ".")
    return F.when(ref.isNotNull() & s.isNotNull(), F.struct(gapped.alias("sequence"), F.lit(1).alias("start"), (germ_length + lead + F.size(used)).alias("length")))


def region_bounds(junction_length: Column, definition: str = "default", amino_acid: bool = False) -> dict[str, tuple[Column, Column]]:
    """(start, end) of each region, half open, from 0; ends of cdr3 and fwr4 are null without a junction length."""
    unit = 1 if amino_acid else 3
    at = {k: (v - 1) * unit for k, v in REGION_STARTS[definition].items()}
    order = ("fwr1", "cdr1", "fwr2", "cdr2", "fwr3", "cdr3")
    out = {a: (F.lit(at[a]), F.lit(at[b])) for a, b in zip(order, order[1:], strict=False)}
    fwr4 = F.greatest(F.lit(at["cdr3"]), at["cdr3"] - 2 * unit + junction_length)
    fwr4 = F.when(junction_length.isNotNull(), fwr4)
    return out | {"cdr3": (F.lit(at["cdr3"]), fwr4), "fwr4": (fwr4, F.lit(1 << 30)), "junction": (F.lit(at["cdr3"] - unit), fwr4 + unit)}


def regions(sequence: Column | str, junction_length: Column, definition: str = "default", amino_acid: bool = False) -> dict[str, Column]:
    """Columns by region name: slices that end with the sequence; all null without a sequence, cdr3 and fwr4 null without a junction length."""
    s = _sql(sequence)
    out = {}
    for name, (start, end) in region_bounds(junction_length, definition, amino_acid).items():
        if name != "junction":
            out[name] = F.when(s.isNotNull() & end.isNotNull() & start.isNotNull(), F.substring(s, start + 1, F.greatest(end - start, F.lit(0))))
    return out


def infer_junction(sequence: Column | str, j_start: Column, j_length: Column, reference: Column | str, definition: str = "default") -> Column:
    """(junction, junction_aa, junction_length) from a numbered sequence and the J reference's motif; null without a reference.

    The junction ends three letters behind the motif's place in the sequence, or with the sequence if the reference has no motif.
    """
    s, ref = _sql(sequence), _sql(reference)
    motif = F.regexp_instr(ref, F.lit(J_MOTIF)) - 1  # from 0; -1 without one
    end = F.when(motif >= 0, F.length(s) - j_length + F.greatest(motif - j_start + 1, F.lit(-1)) + 3).otherwise(F.length(s))
    start = (REGION_STARTS[definition]["cdr3"] - 2) * 3
    junction = F.substring(s, F.lit(start + 1), F.greatest(end - start, F.lit(0)).cast("int"))
    return F.when(ref.isNotNull() & s.isNotNull(), F.struct(junction.alias("junction"), translate(gaps_to_n(junction)).alias("junction_aa"), F.length(junction).alias("junction_length")))


# Headers with annotations.


def header_fields(header: Column | str) -> Column:
    """Annotations of ``ID|KEY=VALUE|..`` as a map, by row; null if some part has no value."""
    parts = F.split(_sql(header), r"\|")
    rest = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    good = F.forall(rest, lambda x: x.contains("="))
    entries = F.transform(rest, lambda x: F.struct(F.substring_index(x, "=", 1).alias("key"), F.substring(x, F.length(F.substring_index(x, "=", 1)) + 2, F.length(x)).alias("value")))
    return F.when(good & (F.size(rest) > 0), F.map_from_entries(entries))


def header_id(header: Column | str) -> Column:
    return F.substring_index(_sql(header), "|", 1)


def make_header(name: Column | str, fields: dict[str, Column]) -> Column:
    """``ID|KEY=VALUE|..`` in the order of the fields; null values are empty."""
    return F.concat_ws("|", _sql(name), *[F.concat(F.lit(f"{k.upper()}="), F.coalesce(v.cast("string"), F.lit(""))) for k, v in fields.items()])
