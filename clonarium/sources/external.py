"""Adapters for external programs: aligners, a submission packer and a tree builder. The programs are arguments, so tests bring their own."""

from __future__ import annotations

import os
import re
import subprocess
import tempfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from clonarium.operators.clones import call_groups
from clonarium.plans.store import ship

# Output formats of the block aligner, and the versions that it must have for its options.
BLOCK_FORMAT = "7 std qseq sseq btop"
TABLE_FORMAT = "19"
VERSIONS = {"blocks": (1, 6), "table": (1, 9), "constant": (1, 18)}
# Names of germline databases by kind of loci.
LOCI = {"ig": "Ig", "tr": "TCR"}


def version(program: str, run: Callable = subprocess.run) -> tuple[int, ...]:
    """Version numbers in the first line that ``program -version`` prints."""
    out = run([program, "-version"], capture_output=True, text=True, check=True).stdout
    return tuple(int(x) for x in re.search(r"(\d+(?:\.\d+)+)", out).group(1).split("."))


def check_version(found: tuple[int, ...], what: str) -> None:
    if found < VERSIONS[what]:
        raise RuntimeError(f"{what} needs version {'.'.join(map(str, VERSIONS[what]))} or later")


def igblast_command(
    program: str, query: str, output: str, base: str, organism: str = "human", loci: str = "ig", fmt: str = "blocks", vdb: str | None = None, ddb: str | None = None, jdb: str | None = None, cdb: str | None = None, threads: int = 1, protein: bool = False
) -> list[str]:
    """Command line of the block aligner; databases lie below ``base`` unless named."""
    db = lambda given, s: given or os.path.join(base, "database", f"imgt_{'aa_' if protein else ''}{organism}_{loci}_{s}")
    out = [program, "-query", query, "-out", output, "-num_threads", str(threads), "-ig_seqtype", LOCI[loci], "-organism", organism, "-germline_db_V", db(vdb, "v")]
    if not protein:
        out += ["-germline_db_D", db(ddb, "d"), "-germline_db_J", db(jdb, "j"), "-auxiliary_data", os.path.join(base, "optional_file", f"{organism}_gl.aux")]
        if cdb:
            out += ["-c_region_db", cdb]
    return [*out, "-domain_system", "imgt", "-outfmt", TABLE_FORMAT if fmt == "table" else BLOCK_FORMAT]


def run_partitions(sequences: DataFrame, command: Callable[[str, str], list[str]], run: Callable = subprocess.run) -> DataFrame:
    """Report texts: each task writes its sequences (description, sequence) to a file of its own, runs the command on it and returns what it
    wrote. A task that is run again starts afresh; nothing outside its temporary folder is touched."""
    ship(sequences.sparkSession)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with tempfile.TemporaryDirectory() as folder:
            query, output = os.path.join(folder, "query.fasta"), os.path.join(folder, "report")
            n = 0
            with open(query, "w") as f:
                for b in batches:
                    for name, seq in zip(b["description"], b["sequence"], strict=True):
                        f.write(f">{name}\n{seq}\n")
                        n += 1
            if n:
                run(command(query, output), check=True)
                with open(output) as f:
                    yield pd.DataFrame({"report": [f.read()]})

    return sequences.select("description", "sequence").mapInPandas(work, "report string")


def muscle(program: str = "muscle", run: Callable = subprocess.run) -> Callable[[list[str]], list[str]]:
    """An aligner of lists of sequences by an external program."""

    def align(sequences: list[str]) -> list[str]:
        if len(sequences) < 2:
            return list(sequences)
        with tempfile.TemporaryDirectory() as folder:
            source, target = os.path.join(folder, "in.fasta"), os.path.join(folder, "out.fasta")
            with open(source, "w") as f:
                f.writelines(f">{i}\n{s}\n" for i, s in enumerate(sequences))
            run([program, "-diags", "-maxiters", "2", "-in", source, "-out", target, "-quiet"], check=True)
            with open(target) as f:
                found = dict(re.findall(r">(\d+)[^\n]*\n([^>]*)", f.read()))
        return [re.sub(r"\s+", "", found[str(i)]) for i in range(len(sequences))]

    return align


def align_records(df: DataFrame, fields: list[str], align: Callable[[list[str]], list[str]], how: str = "across", calls: list[str] | None = None, group_fields: list[str] | None = None, mode: str = "gene") -> DataFrame:
    """Adds <field>_align for each field, and ``passed``.

    ``across`` aligns each field over the records of a group, ``block`` all fields of a group together, ``within`` the fields of each record.
    A group (or record) with an empty sequence fails as a whole, as do records without a group.
    """
    ship(df.sparkSession)
    if how not in ("across", "block", "within"):
        raise ValueError("how is across, block or within")
    grouped = df if how == "within" else call_groups(df, calls, mode, group_fields)
    schema = StructType([*grouped.schema.fields, *(StructField(f"{f}_align", StringType()) for f in fields), StructField("passed", BooleanType())])

    def aligned(table: pd.DataFrame) -> pd.DataFrame:
        out = table.copy()
        cells = [list(out[f].fillna("")) for f in fields]
        good = all(all(c) for c in cells)
        if good:
            if how == "across":
                made = [align(c) for c in cells]
            else:
                flat = align([x for c in cells for x in c])
                made = [flat[i * len(out) : (i + 1) * len(out)] for i in range(len(fields))]
        for i, f in enumerate(fields):
            out[f"{f}_align"] = made[i] if good else None
        out["passed"] = good
        return out

    if how == "within":
        def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.concat([aligned(b.iloc[[i]]) for i in range(len(b))]) if len(b) else aligned(b).iloc[:0]

        return grouped.mapInPandas(rows, schema)
    named = grouped.where(F.col("group").isNotNull()).groupBy("group").applyInPandas(aligned, schema)
    lost = grouped.where(F.col("group").isNull())
    lost = lost.withColumns({f"{f}_align": F.lit(None).cast("string") for f in fields} | {"passed": F.lit(False)})
    return named.unionByName(lost).drop("group")


def tbl2asn(fasta: str, template: str, program: str = "tbl2asn", run: Callable = subprocess.run) -> str:
    """Packs a FASTA file, with its feature table beside it, for submission; returns what the program printed."""
    return run([program, "-p", os.path.dirname(fasta) or ".", "-a", "s", "-V", "vb", "-t", template], capture_output=True, text=True, check=True).stdout


def igphyml_commands(
    manifest: str, program: str = "igphyml", threads: int = 1, optimize: str = "lr", omega: str = "e,e", kappa: str = "e", motifs: str = "FCH", hotness: str = "e,e,e,e,e,e", oformat: str = "tab", asr: float | None = None, hlp: bool = True
) -> list[list[str]]:
    """Two runs of the tree builder: trees under a simple codon model, then (with ``hlp``) parameters of the hotspot model on these trees."""
    first = [program, "--repfile", manifest, "-m", "GY", "--outrep", f"{manifest}.gy", "--run_id", "gy", "-o", "tlr", "--threads", str(threads)]
    if not hlp:
        return [first]
    second = [program, "--repfile", f"{manifest}.gy", "-m", "HLP", "--run_id", "hlp", "--threads", str(threads), "-o", optimize, "--omega", omega, "-t", kappa, "--motifs", motifs, "--hotness", hotness, "--oformat", oformat]
    return [first, second + (["--ASRc", str(asr)] if asr is not None else [])]


def run_igphyml(manifest: str, run: Callable = subprocess.run, clean: str = "none", **options) -> None:
    """Runs the commands; ``clean="all"`` then removes the folder of clone files, and leaves the program's results beside the manifest."""
    for command in igphyml_commands(manifest, **options):
        run(command, check=True)
    if clean == "all":
        with open(manifest) as f:
            for line in f.readlines()[1:]:
                fasta, _, _, parts = line.rstrip("\n").split("\t")
                for path in (fasta, parts):
                    if os.path.exists(path):
                        os.remove(path)
