from __future__ import annotations

from pyspark.sql import functions as F

from clonarium.functions import genes as G
from clonarium.operators import germlines, verbs
from clonarium.sources.tsv import read_tsv
from clonarium.streaming.tables import read_stream, run_batches, write_stream

COLUMNS = ["sequence_id", "v_call", "sequence_imgt", "v_germ_start_imgt", "v_germ_length_imgt"]


def test_stateless_operators_run_on_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        rows = [f"s{k}{i}\tIGHV1-{i % 2 + 1}*01\tCAGG\t1\t4" for i in range(5)]
        (tmp_path / "in" / f"{k}.tsv").write_text("\n".join(["\t".join(COLUMNS), *rows]) + "\n")
    stream = read_stream(spark, str(tmp_path / "in"), COLUMNS, files_per_trigger=1)
    df = verbs.update(verbs.select(stream, ["sequence_id"], ["[0-3]$"], regex=True), "sequence_id", ["s00"], ["first"])
    refs = spark.createDataFrame([("IGHV1-1*01", "CAGGTG")], "allele string, sequence string")
    df = df.withColumn("gene", G.gene("v_call")).withColumns({"j_call": F.lit(None).cast("string"), "d_call": F.lit(None).cast("string")})
    out = germlines.attach_germlines(df, refs).select("sequence_id", "gene", "germline_full", "germline_error")
    write_stream(out, str(tmp_path / "out"), str(tmp_path / "check"), once=True).awaitTermination()
    got = {r.sequence_id: r for r in read_tsv(spark, str(tmp_path / "out")).collect()}
    assert len(got) == 12 and got["first"].germline_full == "CAGG" and got["s11"].germline_error.startswith("Allele IGHV1-2*01") and got["s11"].gene == "IGHV1-2"
    seen = []
    run_batches(stream, lambda batch, n: seen.append(batch.orderBy("sequence_id").first().sequence_id), str(tmp_path / "check2")).awaitTermination()
    assert sorted(seen) == ["s00", "s10", "s20"]
