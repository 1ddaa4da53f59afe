"""Scans of aligner reports into typed records: four-table reports, block reports (nucleotide and protein), and semicolon tables.

Each scan gives attribute-named columns. What a report says by row or by block is one projection; block reports alone need a parser in Python,
which sees one block at a time. References and query sequences are joined, not looked up in a driver's dictionary.
"""

from __future__ import annotations

import os
import re
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clonarium.functions import genes as G
from clonarium.functions import sequences as S
from clonarium.operators.verbs import index
from clonarium.plans.store import ship
from clonarium.sources.tsv import ROW, read_tsv

# The four tables of a report, by the start of their names.
TABLES = {"summary": "1_Summary", "gapped": "2_IMGT-gapped", "ntseq": "3_Nt-sequences", "junction": "6_Junction"}

# Optional columns by report.
SCORES = {s: [f"{s}_score", f"{s}_identity", f"{s}_evalue", f"{s}_cigar"] for s in "vdj"}
REGION_COLUMNS = [f"{r}_imgt" for r in ("fwr1", "fwr2", "fwr3", "fwr4", "cdr1", "cdr2", "cdr3")]
EXTENDED = {
    "imgt": ["v_score", "v_identity", "j_score", "j_identity", *REGION_COLUMNS, "n1_length", "n2_length", "p3v_length", "p5d_length", "p3d_length", "p5j_length", "d_frame"],
    "igblast": [*SCORES["v"], *SCORES["d"], *SCORES["j"], *REGION_COLUMNS],
    "igblast-aa": [*SCORES["v"], "fwr1_aa_imgt", "fwr2_aa_imgt", "fwr3_aa_imgt", "cdr1_aa_imgt", "cdr2_aa_imgt"],
    "ihmmune": ["vdj_score", *REGION_COLUMNS],
}
# Names of the columns of a semicolon table, in order; the last start counts.
SEMICOLON = (
    "sequence_id v_text d_text j_text v_seq np1_seq d_seq np2_seq j_seq v_mut d_mut j_mut nx_count j_inframe v_start_1 stop_count d_prob "
    "hmm_score rc common_mut common_nx v_start v_length a_score"
).split()
# Chain types of block reports.
CHAINS = {"VH": "IGH", "VK": "IGK", "VL": "IGL", "VB": "TRB", "VD": "TRD", "VA": "TRA", "VG": "TRG"}


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(description, sequence); a repeated description raises."""
    df = spark.read.option("lineSep", ">").text(path).where("trim(value) <> ''")
    out = df.select(F.rtrim(F.regexp_extract("value", r"^([^\r\n]*)", 1)).alias("description"), F.regexp_replace(F.regexp_replace("value", r"^[^\r\n]*", ""), r"\s+", "").alias("sequence"))
    twice = out.groupBy("description").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"repeated sequence name: {twice[0][0]}")
    return out


def fastq_to_fasta(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``>name`` and sequence from four-line records, with their order. Files are read split by split: a line's number is that
    within its split and the counts of the file's splits before."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth"))
    ahead = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row for each split
    counts = lines.groupBy("file", "block").agg(F.count("*").alias("lines"), F.min("nth").alias("first"))
    counts = counts.select("file", "block", "first", F.coalesce(F.sum("lines").over(ahead), F.lit(0)).alias("before"))
    kept = lines.join(counts, ["file", "block"]).withColumn("n", F.col("before") + F.col("nth") - F.col("first")).where("n % 4 in (0, 1)")
    text = F.rtrim("value", F.lit("\r"))
    return kept.select(F.when(F.col("n") % 4 == 0, F.concat(F.lit(">"), F.substring(text, 2, 1 << 30))).otherwise(text).alias("value"), F.struct("file", "n").alias(ROW))


def read_cell_ranger(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A contig table; the separator is what the first line holds, and ``None`` is empty."""
    first = spark.read.text(path).first()[0]
    sep = max(",\t;", key=first.count)
    df = spark.read.csv(path, sep=sep, header=True)
    df = df.select(columns or df.columns)
    return df.select([F.when(F.col(c) == "None", "").otherwise(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in df.columns])


def short_ids(sequences: DataFrame, length: int = 49) -> DataFrame:
    """(short, description): what a report makes of long names. At 49 letters, blanks alone are replaced; else other signs as well."""
    signs = r"\s" if length == 49 else r"\s|[/.|]"
    return sequences.select(F.regexp_replace(F.substring("description", 1, length), signs, "_").alias("short"), "description")


def unpack_tables(path: str, folder: str) -> dict[str, str]:
    """Paths of the four tables of a folder, zip file or tar file; archives are unpacked into ``folder``, by member name only."""
    if os.path.isdir(path):
        names = [os.path.join(root, f) for root, _, files in os.walk(path) for f in files]
    else:
        archive = zipfile.ZipFile(path) if zipfile.is_zipfile(path) else tarfile.open(path)
        with archive:
            members = archive.namelist() if isinstance(archive, zipfile.ZipFile) else archive.getnames()
            names = []
            for m in members:
                if os.path.basename(m).startswith(tuple(TABLES.values())):
                    source = archive.open(m) if isinstance(archive, zipfile.ZipFile) else archive.extractfile(m)
                    target = os.path.join(folder, os.path.basename(m))
                    with source, open(target, "wb") as out:
                        out.write(source.read())
                    names.append(target)
    out = {k: [n for n in names if os.path.basename(n).startswith(start)] for k, start in TABLES.items()}
    if any(len(v) != 1 for v in out.values()):
        raise ValueError(f"exactly four tables are needed: {', '.join(TABLES.values())}")
    return {k: v[0] for k, v in out.items()}


def _present(df: DataFrame, name: str) -> Column:
    return F.nullif(F.col(f"`{name}`"), F.lit("")) if name in df.columns else F.lit(None).cast("string")


def _number(c: Column) -> Column:
    return F.coalesce(c.cast("int"), F.lit(0))


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _locus(v: Column, j: Column) -> Column:
    """The locus of V and J if they agree, or of the one that has one."""
    a, b = G.locus(v), G.locus(j)
    return F.when(a.isNull(), b).when(b.isNull() | (a == b), a)


def read_tables(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Records of a four-table report. Rows are matched by their place and must carry the same id; a mismatch raises.

    The shorter table ends the report, as rows are taken side by side.
    """
    frames = {}
    for k, path in paths.items():
        # Places in file order, as an equi-join key.
        df = index(read_tsv(spark, path), "_nth").drop(ROW)
        frames[k] = df.select("_nth", *[F.col(f"`{c}`").alias(f"{k}: {c}") for c in df.columns if c != "_nth"])
    out = frames["summary"]
    for k in ("gapped", "ntseq", "junction"):
        # The few columns that are read of a well compressed table look small, though it has every row: no side is broadcast.
        out = out.join(frames[k].hint("merge"), "_nth")
    same = [F.col(f"`summary: Sequence ID`") == F.col(f"`{k}: Sequence ID`") for k in ("gapped", "ntseq", "junction")]
    checked = F.when(same[0] & same[1] & same[2], F.col("`summary: Sequence ID`")).otherwise(F.raise_error(F.concat(F.lit("tables disagree from record "), F.col("`summary: Sequence ID`"))).cast("string"))
    t = lambda table, name: _present(out, f"{table}: {name}")
    functionality = F.coalesce(t("summary", "Functionality"), t("summary", "V-DOMAIN Functionality"), F.lit(""))
    comment = F.coalesce(t("summary", "Functionality comment"), t("summary", "V-DOMAIN Functionality comment"), F.lit(""))
    results = ~functionality.contains("No results")
    potential = F.coalesce(t("summary", "V-REGION potential ins/del"), F.lit(""))
    call = lambda s: F.regexp_replace(F.regexp_replace(t("summary", f"{s}-GENE and allele"), r",|\(see comment\)", ""), r"\sor\s", ",")
    whole = lambda table: F.coalesce(t(table, "V-D-J-REGION"), t(table, "V-J-REGION"), t(table, "V-REGION"))
    size = lambda c: F.coalesce(F.length(c), F.lit(0))
    nb = lambda *names: sum((_number(t("junction", n)) for n in names), F.lit(0))
    v_start, v_length = t("ntseq", "V-REGION start").cast("int"), size(t("ntseq", "V-REGION"))
    np1 = nb("P3'V-nt nb", "N-REGION-nt nb", "N1-REGION-nt nb", "P5'D-nt nb")
    np2 = nb("P3'D-nt nb", "N2-REGION-nt nb", "P5'J-nt nb")
    d_length = nb("D-REGION-nt nb")
    percent = lambda s: t("summary", f"{s}-REGION identity %").try_cast("double") / 100.0
    frame = t("junction", "D-REGION reading frame")
    junction_length = size(t("junction", "JUNCTION"))
    db = out.select(
        checked.alias("sequence_id"),
        t("summary", "Sequence").alias("sequence_input"),
        F.when(results, F.when(t("summary", "Orientation") == "-", True).when(t("summary", "Orientation") == "+", False)).alias("rev_comp"),
        F.when(results, F.when(functionality.startswith("productive"), True).when(functionality.startswith("unproductive"), False)).alias("functional"),
        F.when(results, F.when(t("summary", "JUNCTION frame") == "in-frame", True).when(t("summary", "JUNCTION frame") == "out-of-frame", False)).alias("in_frame"),
        F.when(results, comment.contains("stop codon")).alias("stop"),
        F.when(results, comment.contains("missing") | potential.contains("missing")).alias("mutated_invariant"),
        F.when(results, (potential != "") | t("summary", "V-REGION insertions").isNotNull() | t("summary", "V-REGION deletions").isNotNull()).alias("indels"),
        _locus(call("V"), call("J")).alias("locus"),
        call("V").alias("v_call"), call("D").alias("d_call"), call("J").alias("j_call"),
        F.upper(whole("ntseq")).alias("sequence_vdj"), F.upper(whole("gapped")).alias("sequence_imgt"),
        v_start.alias("v_seq_start"), v_length.alias("v_seq_length"),
        F.lit(1).alias("v_germ_start_imgt"), size(t("gapped", "V-REGION")).alias("v_germ_length_imgt"),
        np1.alias("np1_length"),
        (F.coalesce(v_start, F.lit(0)) + v_length + np1).alias("d_seq_start"), d_length.alias("d_seq_length"),
        (nb("5'D-REGION trimmed-nt nb") + 1).alias("d_germ_start"), d_length.alias("d_germ_length"),
        np2.alias("np2_length"),
        (F.coalesce(v_start, F.lit(0)) + v_length + np1 + d_length + np2).alias("j_seq_start"), size(t("ntseq", "J-REGION")).alias("j_seq_length"),
        (nb("5'J-REGION trimmed-nt nb") + 1).alias("j_germ_start"), size(t("gapped", "J-REGION")).alias("j_germ_length"),
        F.upper(F.coalesce(t("junction", "JUNCTION"), F.lit(""))).alias("junction"), F.upper(F.coalesce(t("junction", "JUNCTION (AA)"), F.lit(""))).alias("junction_aa"), junction_length.alias("junction_length"),
        t("summary", "V-REGION score").try_cast("double").alias("v_score"), percent("V").alias("v_identity"),
        t("summary", "J-REGION score").try_cast("double").alias("j_score"), percent("J").alias("j_identity"),
        F.coalesce(frame.try_cast("int"), F.nullif(F.regexp_extract(frame, "reading frame ([0-9])", 1), F.lit("")).cast("int")).alias("d_frame"),
        nb("N-REGION-nt nb", "N1-REGION-nt nb").alias("n1_length"), nb("N2-REGION-nt nb").alias("n2_length"),
        nb("P3'V-nt nb").alias("p3v_length"), nb("P5'D-nt nb").alias("p5d_length"), nb("P3'D-nt nb").alias("p3d_length"), nb("P5'J-nt nb").alias("p5j_length"),
        F.col("_nth").alias(ROW),
    )
    return db.withColumns({f"{r}_imgt": c for r, c in S.regions("sequence_imgt", F.col("junction_length")).items()})


# Block reports.


def _columns(line: str, pattern: str, sep: str = ",") -> list[str]:
    found = re.search(pattern, line)
    return [x.strip() for x in found.group(1).split(sep)] if found else []


def parse_block(text: str) -> dict:
    """Sections of one block: query, summary, subregion, and hits as lists of fields. Sections stand between blank lines."""
    out: dict = {}
    for chunk in re.split(r"\n[ \t]*\n", text.replace("\r\n", "\n")):
        lines = [x.strip() for x in chunk.split("\n") if x.strip()]
        if not lines:
            continue
        rows = [x.split("\t") for x in lines if not x.startswith("#")]
        query = next((x for x in lines if x.startswith("# Query:")), None)
        if query is not None:
            out["query"] = query[len("# Query:") :].strip()
        title = next((x for x in lines if x.startswith("#")), "")
        summary = next((x for x in lines if x.startswith("# V-(D)-J rearrangement summary")), None)
        if summary is not None and rows:
            out["summary"] = dict(zip(_columns(summary, r"summary for query sequence \((.+)\)\."), rows[0], strict=False))
        if title.startswith("# Sub-region sequence details"):
            columns = _columns(title, r"sequence details \((.+)\)")
            own = next((r[1:] for r in rows if r[0].startswith("CDR3")), None)
            if own is not None:
                out["subregion"] = dict(zip(columns, own, strict=False))
        fields = next((x for x in lines if x.startswith("# Fields:")), None)
        if fields is not None:
            columns = ["segment", *[x.strip() for x in fields[len("# Fields:") :].split(",")]]
            out["hits"] = [dict(zip(columns, r, strict=False)) for r in rows if len(r) >= len(columns)]
    return out


_HIT = "struct<q_start:int,q_end:int,s_start:int,s_end:int,gap_opens:int,identity:double,evalue:double,score:double,query:string,subject:string,btop:string,name:string>"
_BLOCK = f"query string, summary map<string,string>, subregion map<string,string>, has_hits boolean, v {_HIT}, d {_HIT}, j {_HIT}, tied array<string>"


def _hit(h: dict | None) -> dict | None:
    if h is None:
        return None
    whole = lambda k: int(h[k]) if h.get(k, "").lstrip("-").isdigit() else None

    def real(k: str) -> float | None:
        try:
            return float(h[k])
        except (KeyError, ValueError):
            return None

    return {"q_start": whole("q. start"), "q_end": whole("q. end"), "s_start": whole("s. start"), "s_end": whole("s. end"), "gap_opens": whole("gap opens"), "identity": real("% identity"), "evalue": real("evalue"), "score": real("bit score"), "query": h.get("query seq"), "subject": h.get("subject seq"), "btop": h.get("BTOP"), "name": h.get("subject id")}


def _blocks(protein: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["value"]:
                b = parse_block(text)
                if not b:
                    continue
                hits = b.get("hits") or []
                first = {s: next((h for h in hits if h["segment"] == s.upper()), None) for s in "vdj"}
                tied: list[str] = []
                if protein and first["v"] is not None:
                    own = [h for h in hits if h["segment"] == "V"]
                    top = max(float(h["bit score"]) for h in own)
                    best = sorted((h for h in own if float(h["bit score"]) == top), key=lambda h: h["subject id"])
                    first["v"], tied = best[0], [h["subject id"] for h in best]
                rows.append({"query": b.get("query"), "summary": b.get("summary"), "subregion": b.get("subregion"), "has_hits": "hits" in b, **{s: _hit(first[s]) for s in "vdj"}, "tied": tied})
            yield pd.DataFrame(rows, columns=["query", "summary", "subregion", "has_hits", "v", "d", "j", "tied"])

    return run


def _without_insertions(hit: str, start: Column) -> Column:
    """The aligned query from ``start`` on (from 0), without places where the subject has a gap."""
    query, subject = F.col(f"{hit}.query"), F.col(f"{hit}.subject")
    # Gaps before the start do not count: they are cut off with what stands before it.
    kept_from = F.filter(F.transform(F.split(query, ""), lambda a, i: F.when((i >= start) & (F.substring(subject, i + 1, F.lit(1)) != "-"), a)), lambda x: x.isNotNull())
    return F.when(query.isNotNull() & subject.isNotNull(), F.array_join(kept_from, ""))


def _text_blocks(spark: SparkSession, path: str) -> DataFrame:
    """One row for each block of a report; blocks start with a title line."""
    return spark.read.option("lineSep", "# IGBLAST").text(path).where("trim(value) <> ''").select(F.concat(F.lit("# IGBLAST"), F.col("value")).alias("value"))


def _query_join(parsed: DataFrame, sequences: DataFrame) -> DataFrame:
    """Each block's query sequence; a query that the sequences lack raises."""
    named = sequences.select(F.col("description").alias("query"), F.col("sequence").alias("_input"))
    joined = parsed.join(named, "query", "left")
    return joined.withColumn("_input", F.coalesce("_input", F.raise_error(F.concat(F.lit("no query sequence for "), F.col("query"))).cast("string")))


def _with_reference(df: DataFrame, references: DataFrame, allele: Column, name: str) -> DataFrame:
    from clonarium.operators.germlines import BROADCAST

    ref = references.select(F.col("allele").alias("_allele"), F.col("sequence").alias(name))
    ref = F.broadcast(ref) if references.limit(BROADCAST + 1).count() <= BROADCAST else ref
    return df.withColumn("_want", allele).join(ref, F.col("_want") == F.col("_allele"), "left").drop("_want", "_allele")


def read_blocks(
    spark: SparkSession, path: str, sequences: DataFrame, references: DataFrame, as_is: bool = False, definition: str = "default", infer_junction: bool = False
) -> DataFrame:
    """Records of a nucleotide block report. First hits give positions; where segments overlap, the later one starts behind the earlier one.

    A V allele that the references lack leaves the numbered sequence null. The junction is the reported CDR3 with three letters on
    either side; without one it is inferred from the J reference if asked for.
    """
    ship(spark)
    d = _query_join(_text_blocks(spark, path).mapInPandas(_blocks(False), _BLOCK), sequences)
    s = lambda name: F.try_element_at("summary", F.lit(name))
    called = {}
    for x, kind in (("v", G.v_allele), ("d", G.d_allele), ("j", G.j_allele), ("c", G.c_allele)):
        match = s(f"Top {x.upper()} gene match")
        called[x] = F.when(match != "N/A", match) if as_is else F.array_join(kind(match, "list"), ",")
    d = d.withColumns({f"{x}_call": F.nullif(c, F.lit("")) for x, c in called.items()})
    chain = s("Chain type")
    known = F.create_map(*[F.lit(y) for p in CHAINS.items() for y in p])
    reverse = _flag(s("Strand") == "-")
    has_summary = F.col("summary").isNotNull()
    d = d.withColumns({
        "sequence_id": F.col("query"),
        "sequence_input": F.when(reverse, S.reverse_complement("_input")).otherwise(F.col("_input")),
        "locus": F.when(chain != "N/A", F.coalesce(F.try_element_at(known, chain), chain)),
        "stop": F.when(has_summary, _flag(s("stop codon") == "Yes")),
        "in_frame": F.when(has_summary, _flag(s("V-J frame") == "In-frame")),
        "functional": F.when(has_summary, _flag(s("Productive") == "Yes")),
        "rev_comp": F.when(has_summary, reverse),
        "v_frameshift": F.when(has_summary, _flag(s("V Frame shift") == "Yes")),
    })
    # Hits count for segments that are called.
    for x in "vdj":
        d = d.withColumn(x, F.when(F.col(f"{x}_call").isNotNull() & F.col("has_hits"), F.col(x)))
    h = lambda x, k: F.col(f"{x}.{k}")
    d = d.withColumns({
        "v_seq_start": h("v", "q_start"), "v_seq_length": h("v", "q_end") - h("v", "q_start") + 1,
        "v_germ_start_vdj": h("v", "s_start"), "v_germ_length_vdj": h("v", "s_end") - h("v", "s_start") + 1,
        "indels": h("v", "gap_opens") != 0,
    })
    v_after = F.col("v_seq_start") + F.col("v_seq_length")
    vd = F.when(F.col("v").isNotNull(), h("d", "q_start") - v_after)
    d = d.withColumn("_d_over", F.when(F.col("d").isNotNull(), F.greatest(-F.coalesce(vd, F.lit(0)), F.lit(0))))
    floor0 = lambda c: F.greatest(c, F.lit(0))
    span = lambda x, a, over: (h(x, f"{a}_start") + over, floor0(h(x, f"{a}_end") - h(x, f"{a}_start") - over + 1))
    over = F.col("_d_over")
    d = d.withColumns({"d_seq_start": span("d", "q", over)[0], "d_seq_length": F.when(F.col("d").isNotNull(), span("d", "q", over)[1]), "d_germ_start": span("d", "s", over)[0], "d_germ_length": F.when(F.col("d").isNotNull(), span("d", "s", over)[1])})
    dj = F.when(F.col("d").isNotNull(), h("j", "q_start") - (F.col("d_seq_start") + F.col("d_seq_length")))
    vj = F.when(F.col("v").isNotNull(), h("j", "q_start") - v_after)
    before_j = F.coalesce(dj, vj, F.lit(0))
    d = d.withColumn("_j_over", F.when(F.col("j").isNotNull(), floor0(-before_j)))
    over = F.col("_j_over")
    d = d.withColumns({"j_seq_start": span("j", "q", over)[0], "j_seq_length": F.when(F.col("j").isNotNull(), span("j", "q", over)[1]), "j_germ_start": span("j", "s", over)[0], "j_germ_length": F.when(F.col("j").isNotNull(), span("j", "s", over)[1])})
    has = {x: F.col(x).isNotNull() for x in "vdj"}
    d = d.withColumn("np1_length", F.when(has["d"] & has["v"], floor0(vd)).when(has["j"] & ~has["d"], F.when(has["v"], floor0(vj)).otherwise(0)))
    d = d.withColumn("np2_length", F.when(has["d"] & has["j"], floor0(dj)))
    # Aligned parts with what lies between them, with and without insertions.
    between = lambda start, length: F.substring("sequence_input", start, F.greatest(length, F.lit(0)))
    whole = lambda x, over: F.expr(f"substring({x}.query, {over} + 1)")
    d_end = F.col("d_seq_start") + F.col("d_seq_length")
    for name, part in (("sequence_vdj", whole), ("sequence_trim", lambda x, over: _without_insertions(x, F.expr(over)))):
        pieces = F.concat(
            F.when(has["v"], part("v", "0")).otherwise(""),
            F.when(has["d"], F.concat(F.when(has["v"], between(v_after, vd)).otherwise(""), part("d", "_d_over"))).otherwise(""),
            F.when(has["j"], F.concat(F.when(has["d"], between(d_end, dj)).when(has["v"], between(v_after, vj)).otherwise(""), part("j", "_j_over"))).otherwise(""),
        )
        d = d.withColumn(name, F.when(F.col("has_hits"), pieces))
    for x in "vdj":
        cigar = S.encode_cigar(S.pad_alignment(S.decode_btop(h(x, "btop")), h(x, "q_start") - 1, h(x, "s_start") - 1))
        d = d.withColumns({f"{x}_score": h(x, "score"), f"{x}_identity": h(x, "identity") / 100.0, f"{x}_evalue": h(x, "evalue"), f"{x}_btop": h(x, "btop"), f"{x}_cigar": F.when(h(x, "btop").isNotNull() & (h(x, "btop") != ""), cigar)})
    first_v = G.first_as_is("v_call") if as_is else G.v_allele("v_call")
    d = _with_reference(d, references, F.when(F.coalesce(F.col("sequence_trim"), F.lit("")) != "", first_v), "_v_ref")
    d = d.withColumn("_gap", S.gap_v("sequence_trim", F.col("v_germ_start_vdj"), F.col("v_germ_length_vdj"), "_v_ref"))
    d = d.withColumns({"sequence_imgt": F.col("_gap.sequence"), "v_germ_start_imgt": F.col("_gap.start"), "v_germ_length_imgt": F.col("_gap.length")})
    first_j = G.first_as_is("j_call") if as_is else G.j_allele("j_call")
    d = _with_reference(d, references, first_j, "_j_ref")
    sub = lambda name: F.try_element_at("subregion", F.lit(name))
    start, end = sub("start").try_cast("int") - 3, sub("end").try_cast("int") + 3
    reported = F.substring("sequence_input", start, F.greatest(end - start + 1, F.lit(0)))
    inferred = S.infer_junction("sequence_imgt", F.col("j_germ_start"), F.col("j_germ_length"), "_j_ref", definition)
    inferred = inferred if infer_junction else F.lit(None).cast("struct<junction:string,junction_aa:string,junction_length:int>")
    found = F.when(start.isNotNull(), F.struct(reported.alias("junction"), S.translate(S.gaps_to_n(reported)).alias("junction_aa"), F.length(reported).alias("junction_length"))).otherwise(inferred)
    d = d.withColumn("_junction", found)
    d = d.withColumns({"junction": F.col("_junction.junction"), "junction_aa": F.col("_junction.junction_aa"), "junction_length": F.col("_junction.junction_length"), "junction_start": start, "junction_end": end, "cdr3_igblast": sub("nucleotide sequence"), "cdr3_igblast_aa": sub("translation")})
    d = d.withColumns({f"{r}_imgt": c for r, c in S.regions("sequence_imgt", F.col("junction_length"), definition).items()})
    return d.drop("query", "summary", "subregion", "has_hits", "v", "d", "j", "tied", "_input", "_d_over", "_j_over", "_gap", "_junction", "_v_ref", "_j_ref", "sequence_trim")


def read_protein_blocks(spark: SparkSession, path: str, sequences: DataFrame, references: DataFrame, as_is: bool = False, definition: str = "default") -> DataFrame:
    """Records of a protein block report: V only. All hits that tie at the highest score give the calls, sorted; the first by name gives positions."""
    ship(spark)
    d = _query_join(_text_blocks(spark, path).mapInPandas(_blocks(True), _BLOCK), sequences)
    names = F.sort_array(F.array_distinct("tied"))
    alleles = F.flatten(F.transform(names, lambda x: F.coalesce(G.v_allele(x, "list"), F.array().cast("array<string>"))))
    call = F.array_join(names, ",") if as_is else F.array_join(F.sort_array(F.array_distinct(alleles)), ",")
    h = lambda k: F.col(f"v.{k}")
    d = d.withColumn("v_call", F.nullif(call, F.lit("")))
    d = d.withColumns({
        "sequence_id": F.col("query"), "sequence_aa_input": F.col("_input"),
        "v_germ_aa_start_vdj": h("s_start"), "v_germ_aa_length_vdj": h("s_end") - h("s_start") + 1,
        "v_seq_aa_start": h("q_start"), "v_seq_aa_length": h("q_end") - h("q_start") + 1,
        "indels": h("gap_opens") != 0,
        "sequence_aa_vdj": h("query"), "_trim": _without_insertions("v", F.lit(0)),
        "locus": G.locus("v_call"), "stop": h("query").contains("*"),
        "v_score": h("score"), "v_identity": h("identity") / 100.0, "v_evalue": h("evalue"), "v_btop": h("btop"),
        "v_cigar": F.when(h("btop").isNotNull() & (h("btop") != ""), S.encode_cigar(S.pad_alignment(S.decode_btop(h("btop")), h("q_start") - 1, h("s_start") - 1))),
    })
    d = _with_reference(d, references, F.when(F.coalesce(F.col("_trim"), F.lit("")) != "", G.first_as_is("v_call") if as_is else G.v_allele("v_call")), "_v_ref")
    d = d.withColumn("_gap", S.gap_v("_trim", F.col("v_germ_aa_start_vdj"), F.col("v_germ_aa_length_vdj"), "_v_ref"))
    d = d.withColumns({"sequence_aa_imgt": F.col("_gap.sequence"), "v_germ_aa_start_imgt": F.col("_gap.start"), "v_germ_aa_length_imgt": F.col("_gap.length")})
    parts = S.regions("sequence_aa_imgt", F.lit(None).cast("int"), definition, amino_acid=True)
    d = d.withColumns({f"{r}_aa_imgt": parts[r] for r in ("fwr1", "fwr2", "fwr3", "cdr1", "cdr2")})
    return d.drop("query", "summary", "subregion", "has_hits", "v", "d", "j", "tied", "_input", "_trim", "_gap", "_v_ref")


def read_semicolon(spark: SparkSession, path: str, sequences: DataFrame, references: DataFrame, compat: bool = True) -> DataFrame:
    """Records of a semicolon table without a header. Rows without a V alignment keep their id and input only.

    ``compat``: D and J germline starts count the dots before the segment; else one more, as places start from 1.
    """
    schema = ", ".join(f"{c} string" for c in SEMICOLON)
    d = spark.read.csv(path, sep=";", quote='"', schema=schema, mode="PERMISSIVE").where("sequence_id is not null").withColumnRenamed("sequence_id", "query")
    d = _query_join(d, sequences)
    v_text = F.coalesce("v_text", F.lit(""))
    good = (v_text != "") & ~v_text.startswith("NA - ") & ~v_text.startswith("State path")
    on = lambda c: F.when(good, c)
    calls = {x: on(F.nullif(F.array_join(kind(f"{x}_text", "list"), ","), F.lit(""))) for x, kind in (("v", G.v_allele), ("d", G.d_allele), ("j", G.j_allele))}
    d = d.withColumns({f"{x}_call": c for x, c in calls.items()})
    stops = _number(F.col("stop_count").try_cast("int"))
    j_text = F.coalesce("j_text", F.lit(""))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    d = d.withColumns({
        "sequence_id": F.col("query"), "sequence_input": F.col("_input"),
        "rev_comp": on(_number(F.col("rc").try_cast("int")) != 0),
        "functional": on((F.col("j_inframe") == "true") & (j_text != "") & (j_text != "NO_JGENE_ALIGNMENT") & (stops == 0)),
        "in_frame": on(F.col("j_inframe") == "true"), "stop": on(stops > 0),
        "indels": on(_flag(F.col("v_text").contains("indels")) | _flag(F.col("d_text").contains("indels")) | _flag(F.col("j_text").contains("indels"))),
        "locus": on(_locus(F.col("v_text"), F.col("j_text"))),
        "np1_length": on(F.length(text("np1_seq"))), "np2_length": on(F.length(text("np2_seq"))),
        "vdj_score": on(F.col("hmm_score").try_cast("double")),
    })
    bare = lambda x: F.btrim(text(f"{x}_seq"), F.lit("."))
    has = {x: F.col(f"{x}_call").isNotNull() for x in "vdj"}
    n0 = lambda c: F.coalesce(F.col(c), F.lit(0))
    d = d.withColumns({"v_seq_start": F.when(has["v"], F.col("v_start").try_cast("int")), "v_seq_length": F.when(has["v"], F.length(bare("v"))), "v_germ_start_vdj": F.when(has["v"], 1), "v_germ_length_vdj": F.when(has["v"], F.length(bare("v")))})
    d = d.withColumns({"d_seq_start": F.when(has["d"], n0("v_seq_start") + n0("v_seq_length") + n0("np1_length")), "d_seq_length": F.when(has["d"], F.length(bare("d")))})
    d = d.withColumns({"j_seq_start": F.when(has["j"], n0("v_seq_start") + n0("v_seq_length") + n0("np1_length") + n0("d_seq_length") + n0("np2_length")), "j_seq_length": F.when(has["j"], F.length(bare("j")))})
    for x in "dj":
        dots = F.length(text(f"{x}_seq")) - F.length(F.ltrim(text(f"{x}_seq"), F.lit(".")))
        d = d.withColumns({f"{x}_germ_start": F.when(has[x], dots + (0 if compat else 1)), f"{x}_germ_length": F.col(f"{x}_seq_length")})
    pieces = [F.when(has["v"], bare("v")).otherwise(""), text("np1_seq"), F.when(has["d"], bare("d")).otherwise(""), text("np2_seq"), F.when(has["j"], bare("j")).otherwise("")]
    d = d.withColumn("sequence_vdj", on(F.upper(F.concat(*pieces))))
    d = _with_reference(d, references, F.when(F.col("sequence_vdj") != "", G.v_allele("v_call")), "_v_ref")
    d = d.withColumn("_gap", S.gap_v("sequence_vdj", F.col("v_germ_start_vdj"), F.col("v_germ_length_vdj"), "_v_ref"))
    d = d.withColumns({"sequence_imgt": F.col("_gap.sequence"), "v_germ_start_imgt": F.col("_gap.start"), "v_germ_length_imgt": F.col("_gap.length")})
    d = _with_reference(d, references, G.j_allele("j_call"), "_j_ref")
    d = d.withColumn("_junction", S.infer_junction("sequence_imgt", F.col("j_germ_start"), F.col("j_germ_length"), "_j_ref"))
    d = d.withColumns({c: F.col(f"_junction.{c}") for c in ("junction", "junction_aa", "junction_length")})
    d = d.withColumns({f"{r}_imgt": c for r, c in S.regions("sequence_imgt", F.col("junction_length")).items()})
    return d.drop(*[c for c in SEMICOLON if c != "sequence_id"], "query", "_input", "_gap", "_junction", "_v_ref", "_j_ref")


def renumber(df: DataFrame, references: DataFrame) -> DataFrame:
    """Typed records whose alignments lack the numbering's gaps, with gaps put in by the V reference, places in the numbering, and a new germline.

    Records whose V allele the references lack keep null in these columns.
    """
    from clonarium.operators.germlines import attach_germlines

    d = _with_reference(df, references, G.v_allele("v_call"), "_v_ref")
    d = d.withColumn("_gap", S.gap_v("sequence_imgt", F.col("v_germ_start_imgt"), F.col("v_germ_length_imgt"), "_v_ref"))
    d = d.withColumns({"sequence_imgt": F.col("_gap.sequence"), "v_germ_start_imgt": F.col("_gap.start"), "v_germ_length_imgt": F.col("_gap.length")}).drop("_v_ref", "_gap")
    d = attach_germlines(d, references).withColumn("germline_imgt", F.col("germline_full"))
    return d.drop("germline_full", "germline_dmask", "germline_vonly", "germline_regions", "germline_error")


# Validation and assembly of a parsed report.


def junction_agrees(df: DataFrame) -> Column:
    """Whether the junction is what stands at its place in the numbered sequence."""
    return _flag(F.col("junction") == F.substring("sequence_imgt", F.lit(310), F.length("junction")))


def passes(df: DataFrame, check: str = "strict") -> Column:
    """``strict``: V and J calls, functionality, numbered sequence and junction are there and agree; ``gentle``: without agreeing;
    ``partial``: any of the V, D and J calls is there."""
    there = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) != ""
    if check == "partial":
        return there("v_call") | there("d_call") | there("j_call")
    gentle = there("v_call") & there("j_call") & F.col("functional").isNotNull() & there("sequence_imgt") & there("junction")
    return gentle & junction_agrees(df) if check == "strict" else gentle


def finish(
    df: DataFrame, references: DataFrame | None = None, ids: DataFrame | None = None, cells: DataFrame | None = None, parse_id: bool = True, check: str = "strict", amino_acid: bool = False, strict_cells: bool = False
) -> DataFrame:
    """A parsed report with germlines, full ids, header annotations, cell annotations and ``passed``.

    A header that does not parse leaves its own row without annotations. With ``strict_cells`` a contig without annotations raises.
    """
    from clonarium.operators.germlines import attach_germlines

    out = df
    if ids is not None:
        out = out.join(ids.select(F.col("short").alias("_short"), "description"), F.col("sequence_id") == F.col("_short"), "left").withColumn("sequence_id", F.coalesce("description", "sequence_id")).drop("_short", "description")
    if references is not None:
        field = "sequence_aa_imgt" if amino_acid else "sequence_imgt"
        out = attach_germlines(out, references, seq=field, amino_acid=amino_acid)
        out = out.withColumn("germline_aa_imgt" if amino_acid else "germline_imgt", F.col("germline_full")).drop("germline_full", "germline_dmask", "germline_vonly", "germline_regions", "germline_error")
    if parse_id:
        out = out.withColumn("annotations", S.header_fields("sequence_id")).withColumn("sequence_id", F.when(F.col("annotations").isNotNull(), S.header_id("sequence_id")).otherwise(F.col("sequence_id")))
    if cells is not None:
        extra = cells.select(F.col("contig_id").alias("_contig"), *[c for c in cells.columns if c not in out.columns and c != "contig_id"])
        out = out.join(extra, F.col("sequence_id") == F.col("_contig"), "left")
        if strict_cells:
            missing = F.raise_error(F.concat(F.lit("no annotations for "), F.col("sequence_id"))).cast("string")
            out = out.withColumn("sequence_id", F.when(F.col("_contig").isNull(), missing).otherwise(F.col("sequence_id")))
        out = out.drop("_contig")
    return out.withColumn("passed", passes(out, check))
