"""Names, types and coordinates of repertoire columns: lower-case exchange names, legacy upper-case names and attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REGIONS = ("fwr1", "fwr2", "fwr3", "fwr4", "cdr1", "cdr2", "cdr3")
SEGMENTS = ("v", "d", "j")

# Columns of the exchange format whose name differs from the attribute's beyond the rules below.
EXCHANGE_NAMES = {
    "sequence": "sequence_input",
    "sequence_alignment": "sequence_imgt",
    "germline_alignment": "germline_imgt",
    "sequence_aa": "sequence_aa_input",
    "sequence_aa_alignment": "sequence_aa_imgt",
    "germline_aa_alignment": "germline_aa_imgt",
    "germline_alignment_d_mask": "germline_imgt_d_mask",
    "productive": "functional",
    "stop_codon": "stop",
    "vj_in_frame": "in_frame",
    "duplicate_count": "dupcount",
    "consensus_count": "conscount",
    "umi_count": "umicount",
    "clone_id": "clone",
    "cell_id": "cell",
}

# Columns that each format asks for.
REQUIRED = {
    "airr": (
        "sequence_id sequence sequence_alignment germline_alignment rev_comp productive stop_codon vj_in_frame locus v_call d_call j_call c_call "
        "junction junction_length junction_aa np1_length np2_length v_sequence_start v_sequence_end v_germline_start v_germline_end "
        "d_sequence_start d_sequence_end d_germline_start d_germline_end j_sequence_start j_sequence_end j_germline_start j_germline_end"
    ).split(),
    "airr-aa": (
        "sequence_id sequence sequence_alignment germline_alignment sequence_aa sequence_aa_alignment germline_aa_alignment rev_comp productive "
        "stop_codon locus v_call d_call j_call c_call junction junction_length junction_aa v_sequence_aa_start v_sequence_aa_end "
        "v_germline_aa_start v_germline_aa_end"
    ).split(),
    "legacy": (
        "SEQUENCE_ID SEQUENCE_INPUT FUNCTIONAL IN_FRAME STOP MUTATED_INVARIANT INDELS LOCUS V_CALL D_CALL J_CALL SEQUENCE_VDJ SEQUENCE_IMGT "
        "V_SEQ_START V_SEQ_LENGTH V_GERM_START_VDJ V_GERM_LENGTH_VDJ V_GERM_START_IMGT V_GERM_LENGTH_IMGT NP1_LENGTH D_SEQ_START D_SEQ_LENGTH "
        "D_GERM_START D_GERM_LENGTH NP2_LENGTH J_SEQ_START J_SEQ_LENGTH J_GERM_START J_GERM_LENGTH JUNCTION JUNCTION_LENGTH GERMLINE_IMGT"
    ).split(),
    "legacy-aa": (
        "SEQUENCE_ID SEQUENCE_AA_INPUT STOP INDELS LOCUS V_CALL SEQUENCE_AA_VDJ SEQUENCE_AA_IMGT V_SEQ_AA_START V_SEQ_AA_LENGTH "
        "V_GERM_AA_START_VDJ V_GERM_AA_LENGTH_VDJ V_GERM_AA_START_IMGT V_GERM_AA_LENGTH_IMGT GERMLINE_AA_IMGT"
    ).split(),
}
EXTENSION = {"airr": "tsv", "airr-aa": "tsv", "legacy": "tab", "legacy-aa": "tab"}


def _exchange_rules() -> dict[str, str]:
    out = dict(EXCHANGE_NAMES)
    for s in SEGMENTS:
        own = "_imgt" if s == "v" else ""
        for part in ("start", "end", "length"):
            for aa in ("", "_aa"):
                out[f"{s}_sequence{aa}_{part}"] = f"{s}_seq{aa}_{part}"
                out[f"{s}_germline{aa}_{part}"] = f"{s}_germ{aa}_{part}{own}"
        out[f"{s}_support"] = f"{s}_evalue"
    for r in REGIONS:
        out |= {r: f"{r}_imgt", f"{r}_aa": f"{r}_aa_imgt"}
    return out


_EXCHANGE = _exchange_rules()
_FROM_ATTRIBUTE = {v: k for k, v in _EXCHANGE.items()}


def to_attribute(name: str, fmt: str) -> str:
    """Attribute of a column; names without a rule are lower-cased (legacy) or kept (exchange)."""
    return name.lower() if fmt.startswith("legacy") else _EXCHANGE.get(name.lower(), name.lower())


def from_attribute(name: str, fmt: str) -> str:
    return name.upper() if fmt.startswith("legacy") else _FROM_ATTRIBUTE.get(name, name)


def coordinates() -> list[tuple[str, str, str]]:
    """(start, length, end) attributes; end = start + length - 1."""
    out = [(f"v_{x}_start{y}", f"v_{x}_length{y}", f"v_{x}_end{y}") for x in ("seq", "seq_aa") for y in ("",)]
    out += [(f"v_germ{a}_start_{y}", f"v_germ{a}_length_{y}", f"v_germ{a}_end_{y}") for a in ("", "_aa") for y in ("imgt", "vdj")]
    out += [(f"v_alignment{a}_start", f"v_alignment{a}_length", f"v_alignment{a}_end") for a in ("", "_aa")]
    out += [(f"{s}_{x}{a}_start", f"{s}_{x}{a}_length", f"{s}_{x}{a}_end") for s in "dj" for x in ("seq", "germ") for a in ("", "_aa")]
    return out + [(f"{r}_start", f"{r}_length", f"{r}_end") for r in ("junction", *REGIONS)]


LOGICAL = {"rev_comp", "functional", "in_frame", "stop", "mutated_invariant", "indels", "v_frameshift"}
COUNTS = {"conscount", "dupcount", "umicount", "d_frame"}


def kind(attribute: str) -> str:
    """identity, logical, integer, double, nucleotide or aminoacid; unknown attributes are identity."""
    known = {x for t in coordinates() for x in t} | {f"np{i}{a}_{p}" for i in (1, 2) for a in ("", "_aa") for p in ("start", "length")}
    known |= {"n1_length", "n2_length", "p3v_length", "p5d_length", "p3d_length", "p5j_length", "junction_aa_length"} | COUNTS
    if attribute in LOGICAL:
        return "logical"
    if attribute in known:
        return "integer"
    if attribute in {f"{s}_{x}" for s in SEGMENTS for x in ("score", "identity", "evalue")} | {"vdj_score"}:
        return "double"
    sequences = {"sequence_input", "sequence_imgt", "sequence_vdj", "junction", "germline_imgt", "germline_imgt_d_mask", "germline_vdj", "germline_vdj_d_mask", "cdr3_igblast"}
    if attribute in sequences | {f"{r}_imgt" for r in REGIONS}:
        return "nucleotide"
    proteins = {"sequence_aa_input", "sequence_aa_imgt", "sequence_aa_vdj", "junction_aa", "germline_aa_imgt", "germline_aa_vdj", "cdr3_igblast_aa"}
    return "aminoacid" if attribute in proteins | {f"{r}_aa_imgt" for r in REGIONS} else "identity"


# Texts of logical cells and of missing sequences.
TRUE, FALSE, MISSING = ("T", "TRUE", "True"), ("F", "FALSE", "False"), ("NA", "None")


def parse(column: Column, to: str) -> Column:
    """A typed column from text. Failed numbers and other logical texts are null; missing sequences are empty, not null."""
    if to == "logical":
        return F.when(column.isin(*TRUE), True).when(column.isin(*FALSE), False)
    if to == "integer":
        return column.try_cast("int") if hasattr(column, "try_cast") else column.cast("int")
    if to == "double":
        return column.try_cast("double")
    if to in ("nucleotide", "aminoacid"):
        return F.when(column.isNull() | column.isin(*MISSING), "").otherwise(F.upper(column))
    return column


def deparse(column: Column, to: str) -> Column:
    """Text of a typed column; null becomes empty."""
    if to == "logical":
        text = F.when(column, "T").when(~column, "F")
    elif to in ("nucleotide", "aminoacid"):
        text = F.when(~column.isin(*MISSING), F.upper(column))
    else:
        text = column.cast("string")
    return F.coalesce(text, F.lit(""))


def typed(df: DataFrame, fmt: str) -> DataFrame:
    """Attribute-named, typed columns from a text table in a format; other columns keep their text under their attribute name.

    The exchange format has ends and not lengths: where an end stands, the length becomes end - start + 1. A missing
    junction start follows from the V alignment: v_seq_end - (v_germ_end_imgt - 310), where that bracket is 0 at least.
    """
    cols = []
    for c in df.columns:
        if c.startswith("_"):
            cols.append(F.col(f"`{c}`"))
        else:
            a = to_attribute(c.strip(), fmt)
            cols.append(parse(F.col(f"`{c}`"), kind(a)).alias(a))
    out = df.select(*cols)
    if fmt.startswith("airr"):
        for start, length, end in coordinates():
            if end in out.columns and start in out.columns:
                known = F.col(length) if length in out.columns else F.lit(None).cast("int")
                out = out.withColumn(length, F.when(F.col(end).isNotNull(), F.col(end) - F.col(start) + 1).otherwise(known))
    else:
        out = with_ends(out)
    if {"v_seq_end", "v_germ_end_imgt", "junction_length"} <= set(out.columns):
        shift = F.col("v_germ_end_imgt") - 310
        start = F.when(shift >= 0, F.col("v_seq_end") - shift)
        out = out.withColumn("junction_start", F.coalesce(F.col("junction_start"), start) if "junction_start" in out.columns else start)
        dots = F.length("junction") - F.length(F.replace(F.col("junction"), F.lit("."), F.lit(""))) if "junction" in out.columns else F.lit(0)
        out = out.withColumn("junction_end", F.col("junction_start") + F.col("junction_length") - dots - 1)
    return out


def with_ends(df: DataFrame) -> DataFrame:
    """Adds the end of each coordinate whose start and length are there."""
    for start, length, end in coordinates():
        if {start, length} <= set(df.columns) and start != "junction_start":
            df = df.withColumn(end, F.col(start) + F.col(length) - 1)
    return df


def texts(df: DataFrame, fmt: str, fields: list[str] | None = None) -> DataFrame:
    """A text table in a format from attribute-named columns; ``fields`` (in the format's names) chooses and orders, missing ones are empty."""
    have = {c for c in df.columns if not c.startswith("_")}
    fields = fields or [from_attribute(c, fmt) for c in df.columns if c in have]
    out = []
    for f in fields:
        a = to_attribute(f, fmt)
        out.append((deparse(F.col(a), kind(a)) if a in have else F.lit("")).alias(f))
    return df.select(*out, *[c for c in df.columns if c.startswith("_")])


def convert_names(columns: list[str], source: str, target: str) -> list[str]:
    """Output columns of a conversion: ends before lengths going to the exchange format, lengths after ends going back."""
    attributes = [to_attribute(c, source) for c in columns]
    by_length = {n: e for _, n, e in coordinates()}
    by_end = {e: n for _, n, e in coordinates()}
    out: list[str] = []
    for a in attributes:
        if target.startswith("airr") and a in by_length and by_length[a] not in attributes:
            out.append(by_length[a])
        out.append(a)
        if target.startswith("legacy") and a in by_end and by_end[a] not in attributes:
            out.append(by_end[a])
    return [from_attribute(a, target) for a in dict.fromkeys(out)]


def convert(df: DataFrame, source: str, target: str) -> DataFrame:
    """A text table in one format from one in another."""
    return texts(with_ends(typed(df, source)), target, convert_names([c for c in df.columns if not c.startswith("_")], source, target))


def lookup(df: DataFrame, name: str, fmt: str = "airr") -> Column:
    """A column of a typed table by any of its names, in any case; unknown names give null."""
    for candidate in (name, to_attribute(name, fmt), to_attribute(name, "legacy"), name.lower()):
        if candidate in df.columns:
            return F.col(candidate)
    return F.lit(None).cast("string")
