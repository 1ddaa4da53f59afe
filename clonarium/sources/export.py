"""Writers of sequence files: FASTA, FASTA with germlines by clone, and feature tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clonarium.functions import genes as G
from clonarium.functions import sequences as S
from clonarium.plans.store import stash

#: Letters of a line.
WIDTH = 60
# Defaults of feature tables.
PRODUCT, MOLECULE = "immunoglobulin heavy chain", "mRNA"
KEYWORDS = "[keyword=TLS; Targeted Locus Study; AIRR; MiAIRR:1.0]"


def wrap(sequence: Column | str, width: int = WIDTH) -> Column:
    text = F.col(sequence) if isinstance(sequence, str) else sequence
    return F.regexp_replace(text, f"(.{{{width}}})(?=.)", "$1\n")


def fasta(df: DataFrame, ident: str = "sequence_id", seq: str = "sequence_alignment", fields: list[str] | None = None) -> DataFrame:
    """Adds ``passed`` (id and sequence are there) and ``fasta``: header with annotations, and the sequence in lines."""
    there = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    head = S.make_header(ident, {f: F.col(f) for f in fields or []})
    ok = there(ident) & there(seq)
    return df.withColumn("passed", ok).withColumn("fasta", F.when(ok, F.concat(F.lit(">"), head, F.lit("\n"), wrap(seq))))


def write_fasta(df: DataFrame, path: str, **options) -> None:
    fasta(df, **options).where("passed").select("fasta").write.text(path)


def clonal_fasta(df: DataFrame, ident: str = "sequence_id", seq: str = "sequence_alignment", germline: str = "germline_alignment_d_mask", cluster: str | None = None, fields: list[str] | None = None, order: str | list[str] = "_row") -> DataFrame:
    """(order.., fasta): each sequence in the order of ``order``, with germlines under ``>>`` before. Without a cluster column every record is
    preceded by its own germline, under its own header; with one a germline, under the cluster's name, stands wherever the cluster
    differs from that of the record before (or there is none before). An empty germline raises.

    No task sorts all rows: records are range sorted and written; within a partition a record looks at the one before it, and the
    first of a partition at the last of the partitions before, of which there is one row each.
    """
    keys = [order] if isinstance(order, str) else order
    text = F.coalesce(F.nullif(F.col(germline), F.lit("")), F.raise_error(F.concat(F.lit("no germline for "), F.col(ident))).cast("string"))
    head = S.make_header(ident, {f: F.col(f) for f in fields or []})
    own = F.concat(F.lit(">"), head, F.lit("\n"), wrap(seq))
    under = lambda name: F.concat(F.lit(">>"), name, F.lit("\n"), wrap(text), F.lit("\n"), own)
    if cluster is None:
        return df.select(*keys, under(head).alias("fasta"))
    kept = stash(df.orderBy(*keys).withColumn("_part", F.spark_partition_id()), "ordered")
    ends = kept.groupBy("_part").agg(F.max_by(F.struct(F.col(cluster).alias("c")), F.struct(*keys)).alias("_last"))
    ends = ends.select("_part", F.lag("_last").over(Window.orderBy("_part")).alias("_last"))  # one row for each partition
    by = Window.partitionBy("_part").orderBy(*keys)
    d = kept.withColumn("_before", F.lag(F.struct(F.col(cluster).alias("c"))).over(by)).join(ends, "_part").withColumn("_before", F.coalesce("_before", "_last"))
    new = F.col("_before").isNull() | ~F.col("_before.c").eqNullSafe(F.col(cluster))
    return d.select(*keys, F.when(new, under(S.make_header(F.coalesce(F.col(cluster).cast("string"), F.lit("")), {}))).otherwise(own).alias("fasta"))


_FEATURE = "struct<start:string,end:string,key:string,qualifiers:array<struct<key:string,value:string>>>"


def _feature(start: Column, end: Column, key: str, qualifiers: list[tuple[str, Column]]) -> Column:
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in qualifiers]) if qualifiers else F.array().cast("array<struct<key:string,value:string>>")
    return F.struct(start.cast("string").alias("start"), end.cast("string").alias("end"), F.lit(key).alias("key"), F.filter(pairs, lambda x: x["value"].isNotNull()).alias("qualifiers"))


def features(
    df: DataFrame, product: str = PRODUCT, inference: str | None = None, db_xref: str | None = None, c_field: str | None = None, allow_stop: bool = False, as_is: bool = False, delimiter: str = "*"
) -> DataFrame:
    """Adds ``features`` (null where a record has none: V or J missing, places beyond the sequence, or a stop in its junction).

    Places count from the sequence as it is submitted: without the N at its ends. In order: the constant region behind J, if the
    sequence goes on there; the variable region, once bare and once with a note; V, D and J segments; and the junction, as a coding sequence or
    with ``allow_stop``, where it has a stop, as a note.
    """
    text = S.gaps_to_n("sequence_input")
    head = F.length(text) - F.length(F.ltrim(text, F.lit("N")))
    tail = F.length(F.rtrim(text, F.lit("N")))
    trimmed = F.length(text) - tail
    source = F.length("sequence_input") - trimmed
    whole = lambda c: F.col(c).cast("int")
    end = lambda s: whole(f"{s}_seq_start") + whole(f"{s}_seq_length") - 1
    call = {}
    for s in "vdj":
        call[s] = G.split_as_is(f"{s}_call", delimiter) if as_is else (G.gene(f"{s}_call"), G.allele_number(f"{s}_call"))
    constant = (F.col(c_field) if as_is else G.c_gene(c_field)) if c_field else F.lit(None).cast("string")
    xref = lambda name: F.concat(F.lit(f"{db_xref}:"), name) if db_xref else F.lit(None).cast("string")
    how = F.lit(f"COORDINATES:alignment:{inference}") if inference else F.lit(None).cast("string")
    c_start = end("j") + 1 - head
    c_length = F.greatest(F.length("sequence_input") - (c_start + head - 1), F.lit(0)) - trimmed
    goes_on = c_length > 0
    c_end = c_start + c_length - 1
    j_end = F.when(goes_on, end("j")).otherwise(end("j") + c_length)
    v_start, v_end = F.greatest(whole("v_seq_start") - head, F.lit(1)), j_end - head
    segment = lambda s, start, stop: _feature(start, stop, f"{s.upper()}_segment", [("gene", call[s][0]), ("allele", call[s][1]), ("db_xref", xref(call[s][0])), ("inference", how)])
    junction_start, junction_end = F.col("junction_start") - head, F.col("junction_end") - head
    has_junction = junction_start.isNotNull() & junction_end.isNotNull()
    letters = F.substring("sequence_input", junction_start, F.greatest(junction_end - junction_start + 1, F.lit(0)))
    protein = S.translate(F.concat(letters, F.repeat(F.lit("N"), F.pmod(-F.length(letters), F.lit(3)))))
    stops = has_junction & protein.contains("*")
    motif = F.lit(f"COORDINATES:protein motif:{inference}") if inference else F.lit(None).cast("string")
    bounds = (F.concat(F.lit("<"), junction_start.cast("string")), F.concat(F.lit(">"), junction_end.cast("string")))
    coding = _feature(*bounds, "CDS", [("function", F.lit("JUNCTION")), ("inference", motif), ("product", F.lit(f"{product} junction region")), ("codon_start", F.lit("1"))])
    noted = _feature(*bounds, "misc_feature", [("function", F.lit("JUNCTION")), ("inference", motif), ("note", F.lit(f"{product} junction region"))])
    nothing = F.lit(None).cast(_FEATURE)
    made = F.array(
        F.when(goes_on, _feature(c_start, F.concat(F.lit(">"), c_end.cast("string")), "C_region", [("gene", constant), ("db_xref", xref(constant))])).otherwise(nothing),
        _feature(v_start, v_end, "V_region", []),
        _feature(v_start, v_end, "misc_feature", [("note", F.lit(f"{product} variable region"))]),
        segment("v", v_start, end("v") - head),
        F.when(call["d"][0].isNotNull() & (call["d"][0] != ""), segment("d", whole("d_seq_start") - head, end("d") - head)).otherwise(nothing),
        segment("j", whole("j_seq_start") - head, v_end),
        F.when(stops, noted).when(has_junction, coding).otherwise(nothing),
    )
    fails = call["v"][0].isNull() | call["j"][0].isNull() | (goes_on & (c_end > source)) | (v_end > source)
    if not allow_stop:
        fails = fails | F.coalesce(stops, F.lit(False))
    return df.withColumn("features", F.when(~F.coalesce(fails, F.lit(True)), F.filter(made, lambda x: x.isNotNull())))


def read_features(path: str) -> dict[str, str]:
    """Features of a sample from a file of lines ``key: value``; comments, blank lines and quotes around values are left out."""
    out = {}
    with open(path) as f:
        for line in f:
            key, sep, value = line.partition(":")
            if sep and not line.lstrip().startswith("#"):
                out[key.strip()] = value.split(" #")[0].strip().strip("'\"")
    return out


def submission(
    df: DataFrame, name: Column | None = None, label: str | None = None, count_field: str | None = None, index_field: str | None = None, molecule: str = MOLECULE, sample: dict[str, str] | None = None, **options
) -> DataFrame:
    """Adds ``features``, ``table`` (feature table text) and ``fasta`` (header and trimmed sequence) for submission; both null where features are."""
    d = features(df, **options)
    ident = name if name is not None else F.substring_index("sequence_id", " ", 1)
    short = F.concat(F.lit(f"{label}="), ident) if label else ident
    head = F.concat_ws(" ", short, *[F.lit(f"[{k}={v}]") for k, v in (sample or {}).items()], F.lit(f"[moltype={molecule}]"), F.lit(KEYWORDS))
    notes = [F.concat(F.lit(f"{k}:"), F.coalesce(F.col(c).cast("string"), F.lit("None"))) for k, c in (("AIRR_READ_COUNT", count_field), ("AIRR_CELL_INDEX", index_field)) if c]
    if notes:
        head = F.concat(head, F.lit(" [note="), F.concat_ws("; ", *notes), F.lit("]"))
    line = lambda f: F.concat_ws("\n", F.concat_ws("\t", f["start"], f["end"], f["key"]), F.array_join(F.transform(f["qualifiers"], lambda q: F.concat(F.lit("\t\t\t"), q["key"], F.lit("\t"), q["value"])), "\n"))
    lines = F.transform("features", lambda f: F.rtrim(line(f), F.lit("\n")))
    table = F.concat(F.lit(">Features "), short, F.lit("\n"), F.array_join(lines, "\n"))
    text = F.concat(F.lit(">"), head, F.lit("\n"), wrap(S.trim_n(S.gaps_to_n("sequence_input"))))
    ok = F.col("features").isNotNull()
    return d.withColumn("table", F.when(ok, table)).withColumn("fasta", F.when(ok, text))
