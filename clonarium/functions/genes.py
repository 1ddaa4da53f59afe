"""Gene names in call columns: alleles, genes, families, loci and allele numbers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of the nomenclature. The whole match counts.
LOCUS = r"(IG[HLK]|TR[ABGD])"
PATTERNS = {
    "allele": LOCUS + r"[VDJ][A-R0-9]+[-/\w]*[-\*][\.\w]+",
    "gene": LOCUS + r"[VDJ][A-R0-9]+[-/\w]*",
    "family": LOCUS + r"[VDJ][A-R0-9]+",
    "locus": LOCUS,
    "v_allele": LOCUS + r"V[A-R0-9]+[-/\w]*[-\*][\.\w]+",
    "d_allele": LOCUS + r"D[A-R0-9]+[-/\w]*[-\*][\.\w]+",
    "j_allele": LOCUS + r"J[A-R0-9]+[-/\w]*[-\*][\.\w]+",
    "c_allele": LOCUS + r"[DMAGEC][P0-9]?[A-Z]?[\*][\.\w]+",
    "c_gene": LOCUS + r"[DMAGEC][P0-9]?[A-Z]?",
}
#: Text after the asterisk; group 1.
ALLELE_NUMBER = r"\*([\.\w]+)"
#: Alpha genes that also serve as delta genes.
ALPHA_DELTA = r"TRAV\d+(?:-\d+)?/DV\d+"

ACTIONS = ("first", "set", "list")


def parse_call(call: Column | str, pattern: str, action: str = "first", group: int = 0) -> Column:
    """Matches of ``pattern`` in a call: the first one as a string, or a sorted array, distinct (``set``) or not (``list``).

    Null, or no match: null.
    """
    if action not in ACTIONS:
        raise ValueError(f"action is one of {ACTIONS}")
    call = F.col(call) if isinstance(call, str) else call
    if action == "first":
        return F.nullif(F.regexp_extract(call, pattern, group), F.lit(""))
    found = F.regexp_extract_all(call, F.lit(pattern), F.lit(group))
    found = F.array_distinct(found) if action == "set" else found
    return F.when(F.size(found) > 0, F.sort_array(found))


def allele(call: Column | str, action: str = "first") -> Column:
    return parse_call(call, PATTERNS["allele"], action)


def gene(call: Column | str, action: str = "first") -> Column:
    return parse_call(call, PATTERNS["gene"], action)


def family(call: Column | str, action: str = "first") -> Column:
    return parse_call(call, PATTERNS["family"], action)


def locus(call: Column | str, action: str = "first") -> Column:
    """The locus; a gene of both alpha and delta gives ``TRA/TRD``, or both of them."""
    column = F.col(call) if isinstance(call, str) else call
    both = F.lit("TRA/TRD") if action == "first" else F.array(F.lit("TRA"), F.lit("TRD"))
    return F.when(column.rlike(ALPHA_DELTA), both).otherwise(parse_call(column, PATTERNS["locus"], action))


def allele_number(call: Column | str, action: str = "first") -> Column:
    return parse_call(call, ALLELE_NUMBER, action, group=1)


def v_allele(call: Column | str, action: str = "first") -> Column:
    return parse_call(call, PATTERNS["v_allele"], action)


def d_allele(call: Column | str, action: str = "first") -> Column:
    return parse_call(call, PATTERNS["d_allele"], action)


def j_allele(call: Column | str, action: str = "first") -> Column:
    return parse_call(call, PATTERNS["j_allele"], action)


def c_allele(call: Column | str, action: str = "first") -> Column:
    return parse_call(call, PATTERNS["c_allele"], action)


def c_gene(call: Column | str, action: str = "first") -> Column:
    return parse_call(call, PATTERNS["c_gene"], action)


KINDS = {"allele": allele, "gene": gene, "family": family, "number": allele_number}


def segment_call(segment: str, kind: str, action: str = "first", field: str | None = None) -> Column:
    """What a record's V, D or J call gives by the generic patterns; ``field`` names another call column."""
    return KINDS[kind](field or f"{segment.lower()}_call", action)


def segment_calls(kind: str, segments: list[str], action: str = "first") -> Column:
    """The calls of several segments in the order asked for, as an array."""
    return F.array(*[segment_call(s, kind, action) for s in segments])


def split_as_is(call: Column | str, delimiter: str = "*") -> tuple[Column, Column]:
    """Gene and allele of a call that follows no nomenclature: split at the last delimiter. Without one the allele is null."""
    column = F.col(call) if isinstance(call, str) else call
    parts = F.split(column, "\\Q" + delimiter + "\\E")
    has = F.size(parts) > 1
    allele_ = F.when(has, F.element_at(parts, -1))
    gene_ = F.when(has, F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), delimiter)).otherwise(column)
    return gene_, allele_


def first_as_is(call: Column | str) -> Column:
    """The text before the first comma."""
    column = F.col(call) if isinstance(call, str) else call
    return F.substring_index(column, ",", 1)
