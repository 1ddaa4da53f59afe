from __future__ import annotations

import pytest
from pyspark.errors import PySparkException

from clonarium.operators import verbs as V
from clonarium.sources.tsv import ROW, check_fields, count_rows, output_name, read_tsv, write_tsv

ROWS = [("b", "1", ""), ("a", "10", "NA"), ("B", "2", "x y"), ("a", "", "q\"t"), ("é", "-3", "x")]


@pytest.fixture
def df(spark):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(ROWS)], "id string, n string, c string, _row int")


def ids(df):
    return [r.id for r in df.orderBy(ROW).collect()]


def test_add_keeps_existing_columns(df):
    out = V.add(df, ["c", "d"], ["gone", "new"]).orderBy(ROW).collect()
    assert [r.c for r in out] == [r[2] for r in ROWS] and {r.d for r in out} == {"new"}


def test_drop_and_rename_check_names(df):
    assert V.drop(df, ["n"]).columns == ["id", "c", ROW]
    with pytest.raises(ValueError, match="missing"):
        V.drop(df, ["nope"])
    assert V.rename(df, ["id", "n"], ["x", "y"]).columns == ["x", "y", "c", ROW]
    with pytest.raises(ValueError, match="there already"):
        V.rename(df, ["id", "n"], ["n", "id"])


def test_select_and_delete_are_complements(df):
    for options in ({"values": ["a", "x"]}, {"values": ["a", "10"], "logic": "all"}, {"values": ["^x", "a$"], "regex": True}):
        fields = ["id", "n"] if options.get("logic") else ["id", "c"]
        kept, gone = ids(V.select(df, fields, **options)), ids(V.delete(df, fields, **options))
        assert sorted(kept + gone) == sorted(r[0] for r in ROWS) and kept
    assert ids(V.delete(df, ["c"])) == ["B", "a", "é"]


def test_update_applies_pairs_in_turn(df):
    assert [r.id for r in V.update(df, "id", ["a", "b"], ["b", "c"]).orderBy(ROW).collect()] == ["c", "c", "B", "c", "é"]


def test_sort_is_stable_both_ways(df):
    place = lambda x: [r[ROW] for r in x.collect()]
    assert place(V.sort(df, "id")) == [2, 1, 3, 0, 4]
    assert place(V.sort(df, "id", descend=True)) == [4, 0, 1, 3, 2]
    assert place(V.sort(df, "n", numeric=True)) == [4, 3, 0, 2, 1]
    assert place(V.sort(df, "n", numeric=True, descend=True)) == [1, 2, 0, 3, 4]
    with pytest.raises(PySparkException):
        V.sort(df, "id", numeric=True).collect()


def test_index_runs_from_one_in_order(spark):
    df = spark.range(1000).selectExpr("id", "999 - id AS _row").repartition(7)
    assert sorted((r.id, r.INDEX) for r in V.index(df).collect()) == [(i, 1000 - i) for i in range(1000)]


def test_merge(spark, df):
    other = spark.createDataFrame([("z", "w", 0)], "id string, extra string, _row int")
    out = V.merge([df, other])
    assert [c for c in out.columns if c != ROW] == ["id", "n", "c", "extra"]
    assert [(r.id, r.n, r.extra) for r in out.orderBy(ROW).collect()][-1] == ("z", "", "w")
    assert [c for c in V.merge([df, other], drop=True).columns if c != ROW] == ["id"]


def test_split(df):
    assert {r._split for r in V.split(df, "c").collect()} == {"", "NA", "x_y", "q_t", "x"}
    assert [r._split for r in V.split(V.delete(df, ["n"]), "n", 2).orderBy(ROW).collect()] == ["under", "atleast", "atleast", "under"]


def test_tsv_round_trip_keeps_order_and_cells(spark, tmp_path):
    path = tmp_path / "in.tsv"
    lines = ["id\tn\tc"] + [f"r{i}\t{'' if i % 3 else i}\t\"a \"\"{i}\"\" b\"" for i in range(500)] + ["short"]
    path.write_text("\n".join(lines) + "\n")
    df = read_tsv(spark, str(path))
    got = df.orderBy(ROW).collect()
    assert [r.id for r in got] == [f"r{i}" for i in range(500)] + ["short"]
    assert got[1].n == "" and got[3].n == "3" and got[7].c == 'a "7" b' and got[-1].c == ""
    write_tsv(df, str(tmp_path / "out"), ["id", "c", "none"], single=True)
    back = read_tsv(spark, str(tmp_path / "out")).orderBy(ROW).collect()
    assert [(r.id, r.c, r.none) for r in back] == [(r.id, r.c, "") for r in got]
    assert count_rows(df) == 501
    with pytest.raises(ValueError):
        count_rows(df.where("false"))
    with pytest.raises(ValueError):
        check_fields(df, ["x"])


def test_output_names():
    assert output_name("/a/b.tab", "parse-select") == "/a/b_parse-select.tab"
    assert output_name("/a/b.tab", "airr", "tsv", "/o", "c") == "/o/c_airr.tsv"
