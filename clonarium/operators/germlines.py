"""Germline sequences from a reference of alleles: per record, or per clone from its consensus record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clonarium.functions import genes as G

#: Reference tables up to so many alleles are broadcast; larger ones are joined by shuffle.
BROADCAST = 50_000


def read_germlines(spark: SparkSession, paths: str | list[str], as_is: bool = False) -> DataFrame:
    """(allele, sequence) from FASTA files or folders: the first allele name in the header, or its first word. Of repeated names, the
    first one in file order stays; sequences are upper case without line breaks."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    out = None
    for i, path in enumerate(paths):
        df = spark.read.option("lineSep", ">").option("pathGlobFilter", "*.{fasta,fna,fa}").text(path)
        df = df.where("trim(value) <> ''").select("value", F.struct(F.lit(i), F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("place"))
        out = df if out is None else out.unionByName(df)
    head = F.regexp_extract("value", r"^([^\r\n]*)", 1)
    name = F.substring_index(head, " ", 1) if as_is else G.allele(head)
    body = F.upper(F.regexp_replace(F.regexp_replace("value", r"^[^\r\n]*", ""), r"\s+", ""))
    records = out.select(name.alias("allele"), body.alias("sequence"), "place").where("allele is not null")
    return records.groupBy("allele").agg(F.min_by("sequence", "place").alias("sequence"))


def gapped(references: DataFrame) -> bool:
    """Whether any reference carries the numbering's gaps; germlines of others do not line up with numbered sequences."""
    return references.where(F.col("sequence").contains("...")).limit(1).count() > 0


def _reference(references: DataFrame, segment: str) -> DataFrame:
    # A reference holds alleles of a few species; the bound is checked, not assumed.
    df = references.select(F.col("allele").alias(f"_{segment}_allele"), F.col("sequence").alias(f"_{segment}_ref"))
    return F.broadcast(df) if references.limit(BROADCAST + 1).count() <= BROADCAST else df


def _whole(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name).try_cast("int"), F.lit(0)) if name in df.columns else F.lit(0)


def _slice(ref: Column, start: Column, length: Column) -> Column:
    """``length`` letters from ``start`` (from 0), as far as they go; a negative start counts from the end, as slices do."""
    begin = F.when(start < 0, F.greatest(F.length(ref) + start, F.lit(0))).otherwise(start)
    end = start + length
    end = F.when(end < 0, F.greatest(F.length(ref) + end, F.lit(0))).otherwise(end)
    return F.substring(ref, begin + 1, F.greatest(end - begin, F.lit(0)))


def attach_germlines(
    df: DataFrame, references: DataFrame, seq: str = "sequence_imgt", v: str = "v_call", d: str = "d_call", j: str = "j_call", amino_acid: bool = False, compat: bool = False
) -> DataFrame:
    """Adds germline_full, germline_dmask, germline_vonly, germline_regions (null where they fail) and germline_error.

    V and J slices are filled up with N (X for proteins) to their lengths; a call without an allele gives fill only, D gives nothing. Between them
    stand N for the N/P lengths; regions spell V, N, P, D and J, with P apart where n1_length is there. Bad numbers count as 0.
    An allele that the references lack, an empty sequence, or a length unlike the sequence's is an error, in this order.

    ``compat``: with an empty J, the D-masked germline repeats the whole one at its end, as older tools do.
    """
    aa, fill = ("_aa", "X") if amino_acid else ("", "N")
    out = df
    for s, call, kind in (("v", v, G.allele), ("d", d, G.allele), ("j", j, G.allele)):
        named = kind(call) if call in df.columns else F.lit(None).cast("string")
        out = out.withColumn(f"_{s}_allele", named).join(_reference(references, s), f"_{s}_allele", "left")
    own = "_imgt"
    spans = {"v": (_whole(df, f"v_germ{aa}_start{own}") - 1, _whole(df, f"v_germ{aa}_length{own}"))} | {s: (_whole(df, f"{s}_germ{aa}_start") - 1, _whole(df, f"{s}_germ{aa}_length")) for s in "dj"}
    # A start that is missing counts as the first letter.
    for s, (start, length) in spans.items():
        name = f"v_germ{aa}_start{own}" if s == "v" else f"{s}_germ{aa}_start"
        begin = F.when(F.col(name).try_cast("int").isNull(), 0).otherwise(start) if name in df.columns else F.lit(0)
        ref = F.col(f"_{s}_ref")
        found = _slice(ref, begin, length)
        if s != "d":
            tail = F.length(_slice(ref, begin, F.lit(1 << 30)))
            found = F.concat(found, F.repeat(F.lit(fill), F.greatest(length - tail, F.lit(0))))
        missing = F.lit("") if s == "d" else F.repeat(F.lit(fill), length)
        out = out.withColumn(f"_{s}", F.when(F.col(f"_{s}_allele").isNull(), missing).otherwise(found))
    np = {i: _whole(df, f"np{i}{aa}_length") for i in (1, 2)}
    filled = {i: F.repeat(F.lit(fill), np[i]) for i in (1, 2)}
    out = out.withColumn("_germ", F.concat("_v", filled[1], "_d", filled[2], "_j"))
    letters = lambda letter, n: F.repeat(F.lit(letter), n)
    plain = {i: letters("N", np[i]) for i in (1, 2)}
    if not amino_acid and "n1_length" in df.columns:
        part = lambda p, n, q: F.concat(letters("P", _whole(df, p)), letters("N", _whole(df, n)), letters("P", _whole(df, q)))
        detailed = {1: part("p3v_length", "n1_length", "p5d_length"), 2: part("p3d_length", "n2_length", "p5j_length")}
        has = F.col("n1_length").isNotNull()
        plain = {i: F.when(has, detailed[i]).otherwise(plain[i]) for i in (1, 2)}
    out = out.withColumn("_regions", F.concat(letters("V", F.length("_v")), plain[1], letters("D", F.length("_d")), plain[2], letters("J", F.length("_j"))))
    lacks = lambda s: F.col(f"_{s}_allele").isNotNull() & F.col(f"_{s}_ref").isNull()
    absent = lambda s: F.concat(F.lit("Allele "), F.col(f"_{s}_allele"), F.lit(" is not in the provided germline database."))
    text = F.coalesce(F.col(seq), F.lit(""))
    gap = F.abs(F.length("_germ") - F.length(text))
    error = F.when(lacks("v"), absent("v")).when(lacks("d"), absent("d")).when(lacks("j"), absent("j"))
    error = error.when(text == "", F.lit(f"Sequence is missing from the {seq} field")).when(gap > 0, F.concat(F.lit("Germline sequence differs in length from input sequence by "), gap.cast("string"), F.lit(" characters.")))
    n = F.length("_germ")
    tail = F.when(F.length("_j") > 0, F.right("_germ", F.length("_j"))).otherwise(F.col("_germ") if compat else F.lit(""))
    masked = F.concat(F.substring("_germ", F.lit(1), F.length("_v")), letters(fill, F.greatest(n - F.length("_v") - F.length("_j"), F.lit(0))), tail)
    out = out.withColumn("germline_error", error)
    good = F.col("germline_error").isNull()
    out = out.withColumns({f"germline_{k}": F.when(good, F.upper(c)) for k, c in (("full", F.col("_germ")), ("dmask", masked), ("vonly", F.col("_v")), ("regions", F.col("_regions")))})
    return out.drop(*[c for c in out.columns if c.startswith(("_v", "_d", "_j")) or c in ("_germ", "_regions")])


def consensus(df: DataFrame, clone: str = "clone", seq: str = "sequence_imgt", v: str = "v_call", j: str = "j_call", ident: str = "sequence_id") -> DataFrame:
    """One row for each clone: ``_cons`` (its consensus record), v_cons, j_cons, longest.

    Candidates have a first V and a first J that are the most frequent in the clone (all of those that tie), and the clone's longest
    sequence, or any length if none has; the least id decides. Counts are pre-aggregated by clone and call; no clone is brought together in one task.
    """
    rows = df.withColumn("_v1", G.allele(v)).withColumn("_j1", G.allele(j)).withColumn("_len", F.length(F.coalesce(F.col(seq), F.lit(""))))
    keyed = rows.where(F.col(clone).isNotNull())
    best = {}
    for s in ("_v1", "_j1"):
        counts = keyed.groupBy(clone, s).agg(F.count("*").alias("c"))
        most = F.max("c").over(Window.partitionBy(clone))  # one row for each call of a clone
        tied = counts.withColumn("m", most).where("c = m").select(clone, s)
        best[s] = tied
    names = {s: best[s].groupBy(clone).agg(F.array_join(F.sort_array(F.collect_list(F.coalesce(F.col(s), F.lit("None")))), ",").alias("v_cons" if s == "_v1" else "j_cons")) for s in best}
    longest = keyed.groupBy(clone).agg(F.max("_len").alias("longest"))
    have = keyed.alias("k")
    for s in best:
        b = best[s].select(F.col(clone).alias(f"{s}_clone"), F.col(s).alias(f"{s}_best"))
        have = have.join(b, (F.col(clone) == F.col(f"{s}_clone")) & F.col(s).eqNullSafe(F.col(f"{s}_best")), "left_semi")
    chosen = have.join(longest, clone)
    record = F.struct(*[c for c in df.columns])
    picked = chosen.groupBy(clone).agg(F.min_by(record, F.struct((F.col("_len") != F.col("longest")), F.col(ident))).alias("_cons"))
    return longest.join(names["_v1"], clone).join(names["_j1"], clone).join(picked, clone, "left")


def attach_clonal_germlines(
    df: DataFrame, references: DataFrame, clone: str = "clone", seq: str = "sequence_imgt", v: str = "v_call", d: str = "d_call", j: str = "j_call", ident: str = "sequence_id",
    amino_acid: bool = False, compat: bool = False,
) -> DataFrame:
    """As ``attach_germlines``, with one germline for each clone: that of its consensus record.

    All sequences of a clone are filled up with N (X for proteins) to the longest one, and their J lengths grow by the fill. A clone
    without a record that has both a most frequent V and a most frequent J is an error. Clones of one record take it as it is.
    Rows without a clone are left out, as they have no germline to share.
    """
    fill = "X" if amino_acid else "N"
    length = f"j_germ{'_aa' if amino_acid else ''}_length"
    found = consensus(df, clone, seq, v, j, ident)
    text = F.coalesce(F.col(seq), F.lit(""))
    grown = lambda frame: frame.withColumn(length, _whole(frame, length) + F.col("longest") - F.length(text)).withColumn(seq, F.concat(text, F.repeat(F.lit(fill), F.col("longest") - F.length(text))))
    picked = found.where("_cons is not null").select("_cons.*", "longest")
    germ = attach_germlines(grown(picked).drop("longest"), references, seq, v, d, j, amino_acid, compat)
    germ = germ.select(F.col(clone).alias("_c"), F.col(ident).alias("germline_consensus"), *[c for c in germ.columns if c.startswith("germline_") and c not in df.columns])
    rows = df.where(F.col(clone).isNotNull()).join(found.select(F.col(clone).alias("_k"), "longest"), F.col(clone) == F.col("_k")).drop("_k")
    rows = grown(rows).drop("longest")
    out = rows.join(germ, F.col(clone) == F.col("_c"), "left").drop("_c")
    return out.withColumn("germline_error", F.when(F.col("germline_consensus").isNull(), "No sequence found with both consensus V and J calls.").otherwise(F.col("germline_error")))


def looks_like_protein(df: DataFrame, seq: str = "sequence_imgt", rows: int = 10) -> bool:
    """Whether any of a few rows has letters that only proteins have."""
    return df.select(seq).limit(rows).where(F.upper(seq).rlike("[EFIKLMPQWY]")).count() > 0
