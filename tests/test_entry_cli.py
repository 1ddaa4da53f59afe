from __future__ import annotations

import csv
import glob
import os
import subprocess
import sys
from pathlib import Path

import pytest

from clonarium import catalog, cli

ROOT = Path(__file__).resolve().parents[1]


def read(path):
    part = glob.glob(f"{path}/part-*") if os.path.isdir(path) else [path]
    with open(part[0], newline="") as f:
        return list(csv.DictReader(f, delimiter="\t"))


@pytest.fixture
def table(tmp_path):
    path = tmp_path / "in.tsv"
    base = "TGTGCGAGAGGTAACTACTACGGTATGGACGTCTGG"
    rows = [("s1", base, "IGHV1-1*01"), ("s2", base[:-4] + "ATGG", "IGHV1-1*02"), ("s3", base[::-1], "IGHV1-1*01"), ("s4", "", "IGHV1-1*01")]
    path.write_text("sequence_id\tjunction\tv_call\tj_call\n" + "".join("\t".join((*r, "IGHJ1*01")) + "\n" for r in rows))
    return str(path)


def test_verbs_chain(spark, table, tmp_path):
    out = str(tmp_path / "sel.tsv")
    cli.main(["parse", "select", "-d", table, "-f", "v_call", "-u", r"\*01$", "--regex", "-o", out], spark)
    assert [r["sequence_id"] for r in read(out)] == ["s1", "s3", "s4"]
    out = str(tmp_path / "sort.tsv")
    cli.main(["parse", "sort", "-d", table, "-f", "sequence_id", "--descend", "-o", out], spark)
    assert [r["sequence_id"] for r in read(out)] == ["s4", "s3", "s2", "s1"]
    cli.main(["parse", "index", "-d", table, "--outdir", str(tmp_path / "o")], spark)
    assert [r["INDEX"] for r in read(str(tmp_path / "o" / "in_parse-index.tsv"))] == ["1", "2", "3", "4"]
    cli.main(["parse", "split", "-d", table, "-f", "v_call", "--outdir", str(tmp_path / "o")], spark)
    assert len(glob.glob(str(tmp_path / "o" / "in_parse-split_v_call.tsv" / "_split=*"))) == 2


def test_clones_and_germlines(spark, table, tmp_path):
    out = str(tmp_path / "c")
    cli.main(["clones", "-d", table, "--dist", "0.1", "--outdir", out, "--failed"], spark)
    assert {r["sequence_id"]: r["clone_id"] for r in read(f"{out}/in_clone-pass.tsv")} == {"s1": "1", "s2": "1", "s3": "2"}
    assert [r["sequence_id"] for r in read(f"{out}/in_clone-fail.tsv")] == ["s4"]


def test_arguments_are_checked(table):
    for args in (["parse", "add", "-d", table, "-f", "a", "b", "-u", "c"], ["parse", "drop", "-d", table, "-f", "a", "-o", "x", "--failed"], ["parse", "drop", "-d", "x.csv", "-f", "a"]):
        with pytest.raises(SystemExit):
            cli._check(cli.parser().parse_args(args))


def test_flagship_and_catalog():
    assert set(catalog.SQL) <= set(catalog.QUERIES) and len(catalog.QUERIES) > 40


def test_rest_imports_without_the_corpus_operators(tmp_path):
    """As the driver deletes them: the entry still imports, with the other queries."""
    for p in ROOT.rglob("*.py"):
        rel = p.relative_to(ROOT)
        if "llm" in rel.parts or rel.name == "corpus_pipeline.py" or rel.parts[0] == "tests":
            continue
        (tmp_path / rel).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / rel).write_text(p.read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and 'pipeline' not in q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_clones_log_and_parts(spark, table, tmp_path):
    out, log = str(tmp_path / "c.tsv"), str(tmp_path / "log")
    cli.main(["clones", "-d", table, "--dist", "0.1", "-o", out, "--log", log, "--parts"], spark)
    rows = [r for part in glob.glob(f"{log}/part-*") for r in csv.DictReader(open(part, newline=""), delimiter="\t")]
    assert {r["ID"]: (r["RESULT"], r["ERROR"] or "") for r in rows} == {"s1": ("PASS", ""), "s2": ("PASS", ""), "s3": ("PASS", ""), "s4": ("FAIL", "no junction")}


def test_features_file_and_tree_options(tmp_path):
    from clonarium.sources import export, external

    (tmp_path / "f.yaml").write_text("# sample\norganism: Homo sapiens\nsex: 'female'  # as told\n\ncell-type: B cell\n")
    assert export.read_features(str(tmp_path / "f.yaml")) == {"organism": "Homo sapiens", "sex": "female", "cell-type": "B cell"}
    files = [tmp_path / x for x in ("c.fasta", "c.part.txt", "lineages.tsv")]
    for f in files:
        f.write_text("x")
    files[2].write_text(f"1\n{files[0]}\tN\tc_GERM\t{files[1]}\n")
    ran = []
    external.run_igphyml(str(files[2]), run=lambda c, check: ran.append(c), clean="all", hlp=False, threads=3)
    assert len(ran) == 1 and ran[0][-1] == "3" and not files[0].exists() and not files[1].exists()
    assert external.igphyml_commands("m", kappa="1.5")[1].count("1.5") == 1


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from clonarium.plans import store

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        store.scratch_root(Session())
