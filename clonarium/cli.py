"""Command line over the operators: ``python -m clonarium.cli TOOL [VERB] -d FILE ...``."""

from __future__ import annotations

import argparse
import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clonarium.functions import records as R
from clonarium.operators import clones, germlines, lineage, verbs
from clonarium.plans.store import share
from clonarium.session import session
from clonarium.sources import aligners, export, external
from clonarium.sources.tsv import EXTENSIONS, ROW, output_name, read_tsv, summary, write_tsv

FORMATS = ("airr", "legacy", "airr-aa", "legacy-aa")


def _common(p: argparse.ArgumentParser, db: bool = True) -> argparse.ArgumentParser:
    if db:
        p.add_argument("-d", dest="files", nargs="+", required=True, help="tables")
    p.add_argument("-o", dest="out", nargs="+", help="one output for each input; not with --outdir, --outname or --failed")
    p.add_argument("--outdir")
    p.add_argument("--outname")
    p.add_argument("--failed", action="store_true", help="write rows that fail as well")
    p.add_argument("--log", help="write results and reasons of records here")
    p.add_argument("--parts", action="store_true", help="leave outputs in as many files as tasks write, in order, instead of one")
    p.add_argument("--format", choices=FORMATS, default="airr")
    p.add_argument("--nproc", type=int, help="local[n] instead of the configured master")
    return p


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="clonarium", description=__doc__)
    tools = top.add_subparsers(dest="tool", required=True)

    parse = tools.add_parser("parse", help="relational verbs").add_subparsers(dest="verb", required=True)
    options = {
        "add": "fu", "drop": "f", "rename": "fk", "index": "f1", "delete": "fu?lr", "select": "fulr", "sort": "f1nd", "update": "f1ut", "merge": "D", "split": "f1N",
    }
    for verb, spec in options.items():
        p = _common(parse.add_parser(verb))
        if "f1" in spec:
            p.add_argument("-f", dest="field", required=verb != "index", default="INDEX")
        elif "f" in spec:
            p.add_argument("-f", dest="fields", nargs="+", required=True)
        if "u" in spec:
            p.add_argument("-u", dest="values", nargs="+", required="?" not in spec, default=list(verbs.EMPTY))
        if "k" in spec:
            p.add_argument("-k", dest="names", nargs="+", required=True)
        if "t" in spec:
            p.add_argument("-t", dest="updates", nargs="+", required=True)
        if "l" in spec:
            p.add_argument("--logic", choices=("any", "all"), default="any")
            p.add_argument("--regex", action="store_true")
        if "n" in spec:
            p.add_argument("--num", action="store_true")
            p.add_argument("--descend", action="store_true")
        if "D" in spec:
            p.add_argument("--drop", action="store_true")
        if "N" in spec:
            p.add_argument("--num", type=float, dest="threshold")

    p = _common(tools.add_parser("clones", help="clonal assignment"))
    p.add_argument("--sf", default="junction")
    p.add_argument("--vf", default="v_call")
    p.add_argument("--jf", default="j_call")
    p.add_argument("--gf", nargs="+")
    p.add_argument("--mode", choices=("allele", "gene"), default="gene")
    p.add_argument("--act", choices=("first", "set"), default="set")
    p.add_argument("--model", default="ham")
    p.add_argument("--dist", type=float, default=0.0)
    p.add_argument("--norm", choices=("len", "mut", "none"), default="len")
    p.add_argument("--sym", choices=("avg", "min"), default="avg")
    p.add_argument("--link", choices=("single", "average", "complete"), default="single")
    p.add_argument("--maxmiss", type=int, default=0)

    p = _common(tools.add_parser("germlines", help="germline sequences"))
    p.add_argument("-r", dest="refs", nargs="+", required=True)
    p.add_argument("-g", dest="types", nargs="+", choices=("full", "dmask", "vonly", "regions"), default=["dmask"])
    p.add_argument("--cloned", action="store_true")
    p.add_argument("--sf", default="sequence_imgt")
    p.add_argument("--vf", default="v_call")
    p.add_argument("--df", default="d_call")
    p.add_argument("--jf", default="j_call")
    p.add_argument("--cf", default="clone")

    make = tools.add_parser("make", help="records from aligner reports").add_subparsers(dest="report", required=True)
    for report in ("igblast", "igblast-aa", "imgt", "ihmm"):
        p = _common(make.add_parser(report), db=False)
        p.add_argument("-i", dest="files", nargs="+", required=True)
        p.add_argument("-s", dest="seqs", required=report != "imgt")
        p.add_argument("-r", dest="refs", nargs="+", required=report != "imgt")
        p.add_argument("--10x", dest="cells")
        p.add_argument("--asis-id", action="store_true")
        p.add_argument("--extended", action="store_true")
        p.add_argument("--partial", action="store_true")
        if report.startswith("igblast"):
            p.add_argument("--asis-calls", action="store_true")
            p.add_argument("--regions", default="default", choices=("default", "rhesus-igl"))
        if report == "igblast":
            p.add_argument("--infer-junction", action="store_true")
        if report == "imgt":
            p.add_argument("--imgt-id-len", type=int, default=49)

    convert = tools.add_parser("convert", help="other formats").add_subparsers(dest="target", required=True)
    for target in ("airr", "legacy", "fasta", "baseline", "genbank"):
        p = _common(convert.add_parser(target))
        if target in ("fasta", "baseline"):
            p.add_argument("--if", dest="ident", default="sequence_id")
            p.add_argument("--sf", default="sequence_alignment")
            p.add_argument("--mf", nargs="+")
        if target == "baseline":
            p.add_argument("--gf", default="germline_alignment_d_mask")
            p.add_argument("--cf")
        if target == "genbank":
            for name, default in (("product", export.PRODUCT), ("mol", export.MOLECULE), ("inf", None), ("db", None), ("cf", None), ("nf", None), ("if", None), ("label", None)):
                p.add_argument(f"--{name}", dest=f"gb_{name}", default=default)
            p.add_argument("--allow-stop", action="store_true")
            p.add_argument("--asis-calls", action="store_true")
            p.add_argument("--sample", nargs="*", default=[], metavar="KEY=VALUE")
            p.add_argument("-y", dest="features", help="file of lines KEY: VALUE, like --sample")

    p = _common(tools.add_parser("trees", help="input of lineage trees"))
    p.add_argument("--collapse", action="store_true")
    p.add_argument("--ncdr3", action="store_true")
    p.add_argument("--nmask", action="store_true")
    p.add_argument("--md", nargs="+")
    p.add_argument("--clones", nargs="+", dest="only")
    p.add_argument("--minseq", type=int, default=1)
    p.add_argument("--sample", type=int, dest="depth")
    p.add_argument("--append", nargs="+")
    p.add_argument("--igphyml", action="store_true")
    for name, default in (("optimize", "lr"), ("omega", "e,e"), ("motifs", "FCH"), ("hotness", "e,e,e,e,e,e"), ("oformat", "tab")):
        p.add_argument(f"--{name}", default=default)
    p.add_argument("-t", dest="kappa", default="e")
    p.add_argument("--nohlp", action="store_true")
    p.add_argument("--asr", type=float)
    p.add_argument("--clean", choices=("none", "all"), default="none")

    align = tools.add_parser("align", help="multiple alignment").add_subparsers(dest="how", required=True)
    for how in ("across", "block", "within"):
        p = _common(align.add_parser(how))
        p.add_argument("--sf", nargs="+", required=True)
        p.add_argument("--exec", dest="program", default="muscle")
        if how != "within":
            p.add_argument("--gf", nargs="+")
            p.add_argument("--calls", nargs="+", choices=("v", "d", "j"))
            p.add_argument("--mode", choices=("allele", "gene"), default="gene")

    assign = tools.add_parser("assign", help="run a gene aligner").add_subparsers(dest="kind", required=True)
    for kind in ("igblast", "igblast-aa"):
        p = _common(assign.add_parser(kind), db=False)
        p.add_argument("-s", dest="files", nargs="+", required=True)
        p.add_argument("-b", dest="base", required=True)
        p.add_argument("--organism", default="human")
        p.add_argument("--loci", choices=("ig", "tr"), default="ig")
        for s in "vdjc":
            p.add_argument(f"--{s}db")
        p.add_argument("--exec", dest="program", default="igblastn" if kind == "igblast" else "igblastp")
        p.add_argument("--table", action="store_true", help="the program's own table instead of blocks")
    return top


def _check(a: argparse.Namespace) -> None:
    if a.out and (a.outdir or a.outname or a.failed):
        raise SystemExit("-o cannot be combined with --outdir, --outname or --failed")
    if a.out and len(a.out) != (1 if getattr(a, "verb", "") == "merge" else len(a.files)):
        raise SystemExit("-o needs one output for each input")
    if a.tool in ("parse", "clones", "germlines", "convert", "trees") and any(os.path.splitext(f)[1] not in EXTENSIONS for f in a.files):
        raise SystemExit(f"tables end in {', '.join(EXTENSIONS)}")
    for one, two in (("fields", "values"), ("fields", "names"), ("values", "updates")):
        if a.tool == "parse" and a.verb in {"add": "add", "rename": "rename", "update": "update"} and hasattr(a, one) and hasattr(a, two) and len(getattr(a, one)) != len(getattr(a, two)):
            raise SystemExit(f"as many {one} as {two} are needed")


def _target(a: argparse.Namespace, i: int, label: str) -> str:
    return a.out[i] if a.out else output_name(a.files[i], label, None, a.outdir, a.outname)


def _store(a: argparse.Namespace, df: DataFrame, path: str, passed: str | None = None, reason: str | None = None, fields: list[str] | None = None) -> None:
    kept = df if passed is None else df.where(F.col(passed))
    drop = [c for c in (passed, reason) if c and c in df.columns]
    write_tsv(kept.drop(*drop), path, fields, single=not a.parts)
    if passed and a.failed:
        stem, ext = os.path.splitext(path)
        write_tsv(df.where(~F.coalesce(F.col(passed), F.lit(False))).drop(*drop), f"{stem.removesuffix('-pass')}-fail{ext}", fields, single=not a.parts)
    if passed:
        print("".join(f"{k.upper():>10}> {v}\n" for k, v in summary(df, F.col(passed)).items()), end="")
    if passed and reason:
        _log(a, df, F.col(passed), F.col(reason))


def _log(a: argparse.Namespace, df: DataFrame, passed: Column, reason: Column, ident: str = "sequence_id") -> None:
    """A line for each record: its id, whether it passed, and why not."""
    if a.log:
        ok = F.coalesce(passed, F.lit(False))
        df.select(F.col(ident).alias("ID"), F.when(ok, "PASS").otherwise("FAIL").alias("RESULT"), F.when(~ok, reason).otherwise("").alias("ERROR")).write.mode("append").csv(a.log, sep="\t", header=True)


def _parse(spark: SparkSession, a: argparse.Namespace) -> None:
    if a.verb == "merge":
        _store(a, verbs.merge([read_tsv(spark, f) for f in a.files], a.drop), _target(a, 0, "parse-merge"))
        return
    for i, file in enumerate(a.files):
        df = read_tsv(spark, file)
        if a.verb == "split":
            verbs.write_splits(verbs.split(df, a.field, a.threshold), _target(a, i, f"parse-split_{a.field}"))
            continue
        made = {
            "add": lambda: verbs.add(df, a.fields, a.values),
            "drop": lambda: verbs.drop(df, a.fields),
            "rename": lambda: verbs.rename(df, a.fields, a.names),
            "index": lambda: verbs.index(df, a.field),
            "delete": lambda: verbs.delete(df, a.fields, a.values, a.logic, a.regex),
            "select": lambda: verbs.select(df, a.fields, a.values, a.logic, a.regex),
            "sort": lambda: verbs.sort(df, a.field, a.num, a.descend).drop(ROW),
            "update": lambda: verbs.update(df, a.field, a.values, a.updates),
        }
        _store(a, made[a.verb](), _target(a, i, f"parse-{a.verb}"))


def _clones(spark: SparkSession, a: argparse.Namespace) -> None:
    for i, file in enumerate(a.files):
        df = read_tsv(spark, file)
        name = lambda c: R.from_attribute(R.to_attribute(c, "airr"), a.format)
        out = clones.assign_clones(df, a.dist, a.model, a.link, None if a.norm == "none" else a.norm, a.sym, a.mode, a.act, a.maxmiss, [name(f) for f in a.gf or []], name(a.sf), name(a.vf), name(a.jf))
        ident, junction = R.from_attribute("sequence_id", a.format), name(a.sf)
        why = F.when(F.col("pre").isNull(), "no group: a call or field is missing").when(F.coalesce(F.col(junction), F.lit("")) == "", "no junction").otherwise("too many missing letters in the junction")
        _log(a, out, F.col("passed"), why, ident)
        out = clones.number_clones(out, ROW).drop("pre").withColumnRenamed("clone", R.from_attribute("clone", a.format))
        _store(a, out, _target(a, i, "clone-pass"), "passed")


def _germlines(spark: SparkSession, a: argparse.Namespace) -> None:
    refs = germlines.read_germlines(spark, a.refs)
    if not germlines.gapped(refs):
        print("warning: no reference has the numbering's gaps")
    for i, file in enumerate(a.files):
        df = R.typed(read_tsv(spark, file), a.format)
        if not a.format.endswith("-aa") and germlines.looks_like_protein(df, a.sf):
            raise SystemExit("the sequences look like proteins")
        options = {"seq": a.sf, "v": a.vf, "d": a.df, "j": a.jf, "amino_acid": a.format.endswith("-aa")}
        out = germlines.attach_clonal_germlines(df, refs, clone=a.cf, **options) if a.cloned else germlines.attach_germlines(df, refs, **options)
        tail = a.sf.rsplit("_", 1)[-1]
        names = {"full": f"germline_{tail}", "dmask": f"germline_{tail}_d_mask", "vonly": f"germline_{tail}_v_region", "regions": "germline_regions"}
        out = out.withColumn("passed", F.col("germline_error").isNull())
        for t in ("full", "dmask", "vonly", "regions"):
            if t in a.types:
                out = out.withColumn(names[t], F.col(f"germline_{t}"))
            if names[t] != f"germline_{t}" or t not in a.types:
                out = out.drop(f"germline_{t}")
        out = out.drop("germline_consensus")
        kept = R.texts(out.where("passed").drop("passed", "germline_error"), a.format)
        write_tsv(kept, _target(a, i, "germ-pass"), single=not a.parts)
        if a.failed:
            write_tsv(R.texts(out.where("not passed").drop("passed", "germline_error"), a.format), _target(a, i, "germ-fail"), single=not a.parts)


def _make(spark: SparkSession, a: argparse.Namespace) -> None:
    refs = germlines.read_germlines(spark, a.refs) if a.refs else None
    seqs = aligners.read_fasta(spark, a.seqs) if a.seqs else None
    cells = aligners.read_cell_ranger(spark, a.cells) if a.cells else None
    aa = a.report == "igblast-aa"
    for i, file in enumerate(a.files):
        with tempfile.TemporaryDirectory() as folder:
            ids = None
            if a.report == "imgt":
                df = aligners.read_tables(spark, share(spark, aligners.unpack_tables(file, folder)))
                ids = aligners.short_ids(seqs, a.imgt_id_len) if seqs is not None else None
            elif a.report == "igblast":
                df = aligners.read_blocks(spark, file, seqs, refs, a.asis_calls, a.regions, a.infer_junction)
            elif aa:
                df = aligners.read_protein_blocks(spark, file, seqs, refs, a.asis_calls, a.regions)
            else:
                df = aligners.read_semicolon(spark, file, seqs, refs)
            out = aligners.finish(df, refs, ids, cells, not a.asis_id, "partial" if a.partial else "strict", aa)
            there = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) != ""
            if not aa:
                why = F.concat_ws("; ", *[F.when(~there(c), f"no {c}") for c in ("v_call", "j_call", "functional", "sequence_imgt", "junction")], F.when(there("junction") & there("sequence_imgt") & ~aligners.junction_agrees(out), "the junction does not stand at its place"))
                _log(a, out, F.col("passed"), why)
            extra = aligners.EXTENDED["ihmmune" if a.report == "ihmm" else a.report] if a.extended else []
            fields = list(dict.fromkeys([*R.REQUIRED[a.format], *(R.from_attribute(x, a.format) for x in extra)]))
            passed = R.texts(out.where("passed").drop("passed", "annotations"), a.format, fields)
            write_tsv(passed, _target(a, i, "db-pass"), fields, single=not a.parts)
            if a.failed:
                write_tsv(R.texts(out.where("not passed").drop("passed", "annotations"), a.format, fields), _target(a, i, "db-fail"), fields, single=not a.parts)


def _convert(spark: SparkSession, a: argparse.Namespace) -> None:
    for i, file in enumerate(a.files):
        df = read_tsv(spark, file)
        if a.target in ("airr", "legacy"):
            source = "legacy" if a.target == "airr" else "airr"
            write_tsv(R.convert(df, source, a.target), output_name(file, a.target, R.EXTENSION[a.target], a.outdir, a.outname), single=not a.parts)
        elif a.target == "fasta":
            export.write_fasta(df.orderBy(ROW), _target(a, i, "sequences"), ident=a.ident, seq=a.sf, fields=a.mf)
        elif a.target == "baseline":
            export.clonal_fasta(df, a.ident, a.sf, a.gf, a.cf, a.mf).orderBy(ROW).select("fasta").coalesce(1).write.text(_target(a, i, "sequences"))
        else:
            sample = (export.read_features(a.features) if a.features else {}) | dict(x.split("=", 1) for x in a.sample)
            out = export.submission(R.typed(df, a.format), label=a.gb_label, count_field=a.gb_nf, index_field=a.gb_if, molecule=a.gb_mol, sample=sample, product=a.gb_product, inference=a.gb_inf, db_xref=a.gb_db, c_field=a.gb_cf, allow_stop=a.allow_stop, as_is=a.asis_calls)
            ok = out.where("features is not null").orderBy(ROW)
            ok.select("fasta").coalesce(1).write.text(_target(a, i, "genbank") + ".fsa")
            ok.select("table").coalesce(1).write.text(_target(a, i, "genbank") + ".tbl")


def _trees(spark: SparkSession, a: argparse.Namespace) -> None:
    for i, file in enumerate(a.files):
        df = R.typed(read_tsv(spark, file), a.format)
        if a.append:
            df = df.withColumn("sequence_id", F.concat_ws("_", "sequence_id", *a.append))
        masked = lineage.mask_records(clones.sized(df, a.minseq, only=a.only), mask=not a.nmask)
        if a.depth:
            masked = clones.subsample(masked, a.depth, passed=F.col("fail_reason").isNull())
        out = lineage.align_clones(masked, a.md, a.collapse, a.ncdr3, a.minseq, order=ROW)
        manifest = lineage.write_clone_files(out, _target(a, i, "lineages"))
        if a.igphyml:
            external.run_igphyml(manifest, clean=a.clean, threads=a.nproc or 1, optimize=a.optimize, omega=a.omega, kappa=a.kappa, motifs=a.motifs, hotness=a.hotness, oformat=a.oformat, asr=a.asr, hlp=not a.nohlp)


def _align(spark: SparkSession, a: argparse.Namespace) -> None:
    for i, file in enumerate(a.files):
        out = external.align_records(read_tsv(spark, file), a.sf, external.muscle(a.program), a.how, getattr(a, "calls", None), getattr(a, "gf", None), getattr(a, "mode", "gene"))
        _store(a, out, _target(a, i, "align-pass"), "passed")


def _assign(spark: SparkSession, a: argparse.Namespace) -> None:
    external.check_version(external.version(a.program), "constant" if a.cdb else "table" if a.table else "blocks")
    for i, file in enumerate(a.files):
        seqs = aligners.read_fasta(spark, file)
        command = lambda query, output: external.igblast_command(a.program, query, output, a.base, a.organism, a.loci, vdb=a.vdb, ddb=a.ddb, jdb=a.jdb, cdb=a.cdb, protein=a.kind.endswith("aa"), fmt="table" if a.table else "blocks")
        external.run_partitions(seqs, command).write.text(_target(a, i, "igblast"))


RUN = {"parse": _parse, "clones": _clones, "germlines": _germlines, "make": _make, "convert": _convert, "trees": _trees, "align": _align, "assign": _assign}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    _check(a)
    RUN[a.tool](spark or session(master=f"local[{a.nproc}]" if a.nproc else None), a)


if __name__ == "__main__":
    main()
