"""Registered queries over the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clonarium.datasets import REPERTOIRE, repertoire, table
from clonarium.functions import genes as G
from clonarium.functions import records as R
from clonarium.functions import sequences as S
from clonarium.operators import clones as C
from clonarium.operators import germlines as L
from clonarium.operators import lineage as T
from clonarium.operators import verbs as V
from clonarium.sources import export as X

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The threshold of clonal distance that the examples use.
THRESHOLD = 0.16
# Fixed values of the demonstrations: a small reference, and a coding sequence.
ALLELES = {
    **{f"IGHV{a}-{b}*0{n}": ("CAGGTGCAG...CTGGTGCAGTCT" * 2)[a : a + 30] for a in range(1, 6) for b in range(1, 8) for n in range(1, 4)},
    **{f"IGHJ{a}*01": ("ACTACTTTGACTACTGGGGCCAAGGAACC")[a - 1 : a + 20] for a in range(1, 6)},
}
_RX = {k: p.replace("(IG[HLK]|TR[ABGD])", "(?:IG[HLK]|TR[ABGD])") for k, p in G.PATTERNS.items()}


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _rep(body: str) -> str:
    return f"WITH rep AS ({REPERTOIRE}) {body}"


def _part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr("p_partkey", "p_name", "p_brand", "p_type", "cast(p_size as string) p_size")


# Verbs.


@query("SELECT o_orderkey, o_orderstatus, 'IGH' AS locus FROM orders")
def parse_add(spark, sf_dir):
    return V.add(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), ["locus", "o_orderstatus"], ["IGH", "kept"])


@query("SELECT o_orderkey, o_custkey, o_orderpriority FROM orders")
def parse_drop(spark, sf_dir):
    return V.drop(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_totalprice", "o_orderdate"])


@query("SELECT o_orderkey AS sequence_id, o_orderpriority AS isotype FROM orders")
def parse_rename(spark, sf_dir):
    return V.rename(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), ["o_orderkey", "o_orderpriority"], ["sequence_id", "isotype"])


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS nth FROM orders")
def parse_index(spark, sf_dir):
    return V.index(table(spark, sf_dir, "orders").select("o_orderkey"), "nth", "o_orderkey").select("o_orderkey", F.col("nth").cast("long").alias("nth"))


@query("SELECT p_partkey, p_brand, p_size FROM (SELECT p_partkey, p_brand, cast(p_size AS varchar) AS p_size FROM part) WHERE p_brand IN ('Brand#11', '7') OR p_size IN ('Brand#11', '7')")
def parse_select_any(spark, sf_dir):
    return V.select(_part(spark, sf_dir), ["p_brand", "p_size"], ["Brand#11", "7"]).select("p_partkey", "p_brand", "p_size")


@query("SELECT p_partkey FROM (SELECT p_partkey, p_brand, cast(p_size AS varchar) AS p_size FROM part) WHERE p_brand IN ('Brand#11', 'Brand#12', 'Brand#23', '7', '9', '11') AND p_size IN ('Brand#11', 'Brand#12', 'Brand#23', '7', '9', '11')")
def parse_select_all(spark, sf_dir):
    return V.select(_part(spark, sf_dir), ["p_brand", "p_size"], ["Brand#11", "Brand#12", "Brand#23", "7", "9", "11"], logic="all").select("p_partkey")


@query("SELECT p_partkey, p_type FROM part WHERE regexp_matches(p_type, '^(ECONOMY|STANDARD)') OR regexp_matches(p_type, 'TIN$')")
def parse_select_regex(spark, sf_dir):
    return V.select(_part(spark, sf_dir), ["p_type"], ["^(ECONOMY|STANDARD)", "TIN$"], regex=True).select("p_partkey", "p_type")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE NOT (coalesce(c_mktsegment, '') IN ('', 'NA') OR coalesce(c_name, '') IN ('', 'NA'))")
def parse_delete(spark, sf_dir):
    return V.delete(table(spark, sf_dir, "customer"), ["c_mktsegment", "c_name"]).select("c_custkey", "c_mktsegment")


@query("SELECT c_custkey FROM customer WHERE NOT (regexp_matches(c_mktsegment, 'BUILD') AND regexp_matches(c_name, 'BUILD'))")
def parse_delete_regex_all(spark, sf_dir):
    return V.delete(table(spark, sf_dir, "customer"), ["c_mktsegment", "c_name"], ["BUILD"], logic="all", regex=True).select("c_custkey")


def _sorted(df: DataFrame, numeric: bool, descend: bool, field: str) -> DataFrame:
    """Places of the rows after a stable sort; ties keep the order of their keys."""
    rows = V.sort(df.select("o_orderkey", F.col(field).cast("string").alias(field)), field, numeric, descend, order="o_orderkey")
    return V.place(rows, "place").select("o_orderkey", "place")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority, o_orderkey) AS place FROM orders")
def parse_sort_text(spark, sf_dir):
    return _sorted(table(spark, sf_dir, "orders"), False, False, "o_orderpriority")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY cast(o_custkey AS double) DESC, o_orderkey) AS place FROM orders")
def parse_sort_numeric_desc(spark, sf_dir):
    return _sorted(table(spark, sf_dir, "orders"), True, True, "o_custkey")


_CHAIN = "CASE WHEN x = 'F' THEN 'O' ELSE x END"
_CHAIN2 = f"(CASE WHEN ({_CHAIN}) = 'O' THEN 'P' ELSE ({_CHAIN}) END)"


@query(f"SELECT o_orderkey, {_CHAIN2} AS o_orderstatus FROM (SELECT o_orderkey, o_orderstatus AS x FROM orders)")
def parse_update_chain(spark, sf_dir):
    return V.update(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["F", "O"], ["O", "P"])


@query("SELECT cast(s_suppkey AS varchar) AS id, s_name AS name, cast(s_nationkey AS varchar) AS nation, '' AS segment FROM supplier UNION ALL SELECT cast(c_custkey AS varchar), c_name, '', c_mktsegment FROM customer")
def parse_merge_union(spark, sf_dir):
    a = table(spark, sf_dir, "supplier").selectExpr("s_suppkey id", "s_name name", "s_nationkey nation")
    b = table(spark, sf_dir, "customer").selectExpr("c_custkey id", "c_name name", "c_mktsegment segment")
    return V.merge([a, b])


@query("SELECT cast(s_suppkey AS varchar) AS id, s_name AS name FROM supplier UNION ALL SELECT cast(c_custkey AS varchar), c_name FROM customer")
def parse_merge_drop(spark, sf_dir):
    a = table(spark, sf_dir, "supplier").selectExpr("s_suppkey id", "s_name name", "s_nationkey nation")
    b = table(spark, sf_dir, "customer").selectExpr("c_custkey id", "c_name name", "c_mktsegment segment")
    return V.merge([a, b], drop=True)


@query("SELECT regexp_replace(o_orderpriority, '[^A-Za-z0-9.+=@-]+', '_', 'g') AS part, count(*) AS n FROM orders GROUP BY 1")
def parse_split_text(spark, sf_dir):
    return V.split(table(spark, sf_dir, "orders"), "o_orderpriority").groupBy(F.col("_split").alias("part")).agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN o_totalprice < 150000 THEN 'under' ELSE 'atleast' END AS part, count(*) AS n FROM orders GROUP BY 1")
def parse_split_number(spark, sf_dir):
    return V.split(table(spark, sf_dir, "orders"), "o_totalprice", 150000).groupBy(F.col("_split").alias("part")).agg(F.count("*").alias("n"))


# Gene names.


def _named(name: str, spark_form: Callable, sql_form: str) -> None:
    def run(spark, sf_dir):
        return repertoire(spark, sf_dir).select("sequence_id", spark_form().alias("call"))

    run.__name__ = name
    query(_rep(f"SELECT sequence_id, {sql_form} AS call FROM rep"))(run)


_named("gene_allele", lambda: G.allele("v_call"), f"nullif(regexp_extract(v_call, '{_RX['allele']}'), '')")
_named("gene_gene", lambda: G.gene("v_call"), f"nullif(regexp_extract(v_call, '{_RX['gene']}'), '')")
_named("gene_family", lambda: G.family("v_call"), f"nullif(regexp_extract(v_call, '{_RX['family']}'), '')")
_named("gene_locus", lambda: G.locus("j_call"), "nullif(regexp_extract(j_call, '(?:IG[HLK]|TR[ABGD])'), '')")
_named("gene_number", lambda: G.allele_number("v_call"), r"nullif(regexp_extract(v_call, '\*([\.\w]+)', 1), '')")
_named("gene_set", lambda: F.array_join(G.gene("v_call", "set"), ","), f"array_to_string(list_sort(list_distinct(regexp_extract_all(v_call, '{_RX['gene']}'))), ',')")
_named("gene_list", lambda: F.array_join(G.allele_number("v_call", "list"), ","), r"array_to_string(list_sort(regexp_extract_all(v_call, '\*([\.\w]+)', 1)), ',')")
_named("gene_j_allele", lambda: G.j_allele("j_call"), f"nullif(regexp_extract(j_call, '{_RX['j_allele']}'), '')")
_named("gene_first_as_is", lambda: G.first_as_is("v_call"), "split_part(v_call, ',', 1)")


# Clones.

_GENE = lambda c: f"regexp_extract({c}, '{_RX['gene']}')"
_PRE = f"SELECT *, {_GENE('v_call')} AS v, {_GENE('j_call')} AS j, length(junction) AS n FROM rep"


@query(_rep(f"SELECT v, j, n AS length, count(*) AS size FROM ({_PRE}) GROUP BY v, j, n"))
def preclone_first(spark, sf_dir):
    df = C.key_first(repertoire(spark, sf_dir)).groupBy("pre").agg(F.count("*").alias("size"))
    parts = F.from_json("pre", "v string, j string, length long")
    return df.select(parts["v"].alias("v"), parts["j"].alias("j"), parts["length"].alias("length"), "size")


@query(
    f"""WITH RECURSIVE rep AS ({REPERTOIRE}),
 pairs AS (SELECT DISTINCT length(junction) AS n, {_GENE('j_call')} AS j, unnest(regexp_extract_all(v_call, '{_RX['gene']}')) AS v, v_call AS cell FROM rep),
 ids AS (SELECT n, j, v, min(v) OVER (PARTITION BY n, j, cell) AS u FROM pairs),
 e AS (SELECT DISTINCT n, j, v AS a, u AS b FROM ids UNION SELECT DISTINCT n, j, u, v FROM ids),
 walk AS (SELECT DISTINCT n, j, a AS v, a AS r FROM e UNION SELECT e.n, e.j, e.b, walk.r FROM walk JOIN e ON walk.n = e.n AND walk.j = e.j AND walk.v = e.a),
 root AS (SELECT n, j, v, min(r) AS r FROM walk GROUP BY n, j, v)
SELECT root.n AS length, root.j AS j, root.r AS least_v, count(*) AS size FROM rep JOIN root ON root.n = length(junction) AND root.j = {_GENE('j_call')} AND root.v = {_GENE('v_call')} GROUP BY 1, 2, 3"""
)
def preclone_set(spark, sf_dir):
    df = C.key_set(repertoire(spark, sf_dir)).withColumn("v", F.array_min(G.gene("v_call", "set"))).withColumn("length", F.length("junction").cast("long"))
    return df.groupBy("pre").agg(F.min("length").alias("length"), F.min(G.gene("j_call")).alias("j"), F.min("v").alias("least_v"), F.count("*").alias("size")).drop("pre")


@query(_rep("SELECT sequence_id, junction <> '' AND length(regexp_replace(junction, '[ACGT]', '', 'g')) <= 0 AS passed FROM rep"))
def missing_filter(spark, sf_dir):
    return repertoire(spark, sf_dir).select("sequence_id", C.few_missing(F.col("junction")).alias("passed"))


_NODES = f"nodes AS (SELECT DISTINCT v, j, n, junction AS s FROM ({_PRE}) WHERE productive = 'T' AND regexp_matches(junction, '^[ACGT]+$'))"


def _nodes(spark, sf_dir) -> DataFrame:
    df = C.key_first(V.select(repertoire(spark, sf_dir), ["productive"], ["T"]))
    return df.where(C.few_missing(F.col("junction"))).select("pre", F.col("junction").alias("seq")).distinct()


@query(f"WITH rep AS ({REPERTOIRE}), {_NODES} SELECT a.v AS v, a.j AS j, a.s AS a, b.s AS b, round(hamming(a.s, b.s) / cast(a.n AS double), 6) AS distance FROM nodes a JOIN nodes b ON a.v = b.v AND a.j = b.j AND a.n = b.n AND a.s < b.s WHERE hamming(a.s, b.s) / cast(a.n AS double) <= {THRESHOLD}")
def distance_pairs(spark, sf_dir):
    found = C.close_pairs(_nodes(spark, sf_dir), "ham", THRESHOLD, "len")
    parts = F.from_json("pre", "v string, j string")
    return found.select(parts["v"].alias("v"), parts["j"].alias("j"), F.col("u").alias("a"), F.col("v").alias("b"), F.round("distance", 6).alias("distance"))


_WEIGHTS = "VALUES ('A','G',0.64),('C','T',0.64),('A','T',1.16),('C','G',1.16),('A','C',1.21),('G','T',1.21)"


@query(
    f"WITH rep AS ({REPERTOIRE}), {_NODES}, w(x, y, d) AS ({_WEIGHTS}), both_w AS (SELECT x, y, d FROM w UNION ALL SELECT y, x, d FROM w), "
    "near AS (SELECT a.v, a.j, a.n, a.s AS a, b.s AS b, unnest(range(1, a.n + 1)) AS i FROM nodes a JOIN nodes b ON a.v = b.v AND a.j = b.j AND a.n = b.n AND a.s < b.s WHERE hamming(a.s, b.s) <= 7), "
    "summed AS (SELECT near.v, near.j, a, b, n, sum(d) AS s FROM near JOIN both_w ON substr(a, cast(i AS int), 1) = x AND substr(b, cast(i AS int), 1) = y GROUP BY 1, 2, 3, 4, 5) "
    "SELECT v, j, a, b, round(cast(s / n AS double), 6) AS distance FROM summed WHERE s / n <= 0.12"
)
def distance_weighted_pairs(spark, sf_dir):
    found = C.close_pairs(_nodes(spark, sf_dir), "hh_s1f", 0.12, "len")
    parts = F.from_json("pre", "v string, j string")
    return found.select(parts["v"].alias("v"), parts["j"].alias("j"), F.col("u").alias("a"), F.col("v").alias("b"), F.round("distance", 6).alias("distance"))


def _clones(spark, sf_dir, linkage: str = "single", large: int = C.LARGE) -> DataFrame:
    df = V.select(repertoire(spark, sf_dir), ["productive"], ["T"])
    return C.assign_clones(df, THRESHOLD, action="first", linkage=linkage, large=large)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clones_single(spark, sf_dir)


_WALK = (
    f"WITH RECURSIVE rep AS ({REPERTOIRE}), {_NODES}, "
    f"e AS (SELECT a.v, a.j, a.n, a.s AS a, b.s AS b FROM nodes a JOIN nodes b ON a.v = b.v AND a.j = b.j AND a.n = b.n AND a.s <> b.s WHERE hamming(a.s, b.s) / cast(a.n AS double) <= {THRESHOLD}), "
    "walk AS (SELECT v, j, n, s, s AS r FROM nodes UNION SELECT e.v, e.j, e.n, e.b, walk.r FROM walk JOIN e ON walk.v = e.v AND walk.j = e.j AND walk.n = e.n AND walk.s = e.a), "
    "root AS (SELECT v, j, n, s, min(r) AS r FROM walk GROUP BY v, j, n, s) "
)


@query(_WALK + f"SELECT sequence_id, root.v AS v, root.j AS j, root.r AS clone_junction FROM ({_PRE}) p JOIN root ON p.v = root.v AND p.j = root.j AND p.n = root.n AND p.junction = root.s WHERE productive = 'T'")
def clones_single(spark, sf_dir):
    df = _clones(spark, sf_dir).where("passed")
    parts = F.from_json("pre", "v string, j string")
    return df.select("sequence_id", parts["v"].alias("v"), parts["j"].alias("j"), F.substring_index("clone", "|", -1).alias("clone_junction"))


@query(SQL["clones_single"])
def clones_single_segments(spark, sf_dir):
    """The same clones without any matrix, as for groups too large for one task."""
    df = _clones(spark, sf_dir, large=0).where("passed")
    parts = F.from_json("pre", "v string, j string")
    return df.select("sequence_id", parts["v"].alias("v"), parts["j"].alias("j"), F.substring_index("clone", "|", -1).alias("clone_junction"))


@query(_WALK + f"SELECT size, count(*) AS clones FROM (SELECT root.v, root.j, root.n, root.r, count(*) AS size FROM ({_PRE}) p JOIN root ON p.v = root.v AND p.j = root.j AND p.n = root.n AND p.junction = root.s WHERE productive = 'T' GROUP BY 1, 2, 3, 4) GROUP BY size")
def clone_sizes(spark, sf_dir):
    return _clones(spark, sf_dir).where("passed").groupBy("clone").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("clones"))


# Each of these groups has one J and one length, so a clone is told by its least junction and the least V of its group.
_SET_GROUPS = SQL["preclone_set"].split("SELECT root.n AS length")[0]


@query(
    _SET_GROUPS
    + f""", p AS (SELECT rep.*, root.r AS g, {_GENE('j_call')} AS j, length(junction) AS n FROM rep JOIN root ON root.n = length(junction) AND root.j = {_GENE('j_call')} AND root.v = {_GENE('v_call')}),
 nodes AS (SELECT DISTINCT g, j, n, junction AS s FROM p WHERE regexp_matches(junction, '^[ACGT]+$')),
 near AS (SELECT a.g, a.j, a.n, a.s AS a, b.s AS b FROM nodes a JOIN nodes b ON a.g = b.g AND a.j = b.j AND a.n = b.n AND a.s <> b.s WHERE hamming(a.s, b.s) / cast(a.n AS double) <= {THRESHOLD}),
 walk2 AS (SELECT g, j, n, s, s AS r FROM nodes UNION SELECT near.g, near.j, near.n, near.b, walk2.r FROM walk2 JOIN near ON walk2.g = near.g AND walk2.j = near.j AND walk2.n = near.n AND walk2.s = near.a),
 top AS (SELECT g, j, n, s, min(r) AS r FROM walk2 GROUP BY 1, 2, 3, 4)
SELECT p.sequence_id, top.r AS clone_junction, p.g AS least_v, top.r IS NOT NULL AS passed FROM p LEFT JOIN top ON top.g = p.g AND top.j = p.j AND top.n = p.n AND top.s = p.junction"""
)
def clones_set(spark, sf_dir):
    """End to end with the defaults: groups by sets of calls, single linkage, rows with missing letters fail."""
    df = C.assign_clones(repertoire(spark, sf_dir), THRESHOLD)
    least = F.array_min(F.split(F.element_at(F.split("pre", r"\|"), 2), ","))
    return df.select("sequence_id", F.when(F.col("passed"), F.substring_index("clone", "|", -1)).alias("clone_junction"), least.alias("least_v"), "passed")


@query()
def clones_average(spark, sf_dir):
    return _clones(spark, sf_dir, "average").groupBy("pre", "clone", "passed").agg(F.count("*").alias("size"))


@query()
def clones_complete(spark, sf_dir):
    return _clones(spark, sf_dir, "complete").groupBy("pre", "clone", "passed").agg(F.count("*").alias("size"))


@query(_rep(f"SELECT sample_id, v, j, count(*) AS size FROM (SELECT sample_id, {_GENE('v_call')} AS v, {_GENE('j_call')} AS j FROM rep) GROUP BY 1, 2, 3"))
def call_groups(spark, sf_dir):
    df = C.call_groups(repertoire(spark, sf_dir), ["v", "j"], fields=["sample_id"])
    parts = F.from_json("group", "v string, j string, sample_id string")
    return df.groupBy(parts["sample_id"].alias("sample_id"), parts["v"].alias("v"), parts["j"].alias("j")).agg(F.count("*").alias("size"))


@query(_rep("SELECT r.sequence_id FROM rep r JOIN (SELECT junction, count(*) AS c FROM rep GROUP BY junction) k ON r.junction = k.junction WHERE c >= 12"))
def clone_size_gate(spark, sf_dir):
    return C.sized(repertoire(spark, sf_dir), 12, clone="junction").select("sequence_id")


# Germlines. A record's alignment is 12 letters of V, 2 between, none of D, and 9 of J; a few are one letter short.

_ALIGNED = """SELECT sequence_id, v_call, j_call, 1 AS v_germ_start_imgt, 12 AS v_germ_length_imgt, 2 AS np1_length, 0 AS np2_length, 1 AS j_germ_start, 9 AS j_germ_length,
 substr(concat(junction, junction), 1, CASE WHEN length(junction) % 2 = 1 THEN 22 ELSE 23 END) AS sequence_imgt, junction FROM rep"""


def _aligned(spark, sf_dir) -> DataFrame:
    return spark.sql(_ALIGNED.replace("FROM rep", "FROM {rep}"), rep=repertoire(spark, sf_dir)).withColumn("d_call", F.lit(None).cast("string"))


def _references(spark) -> DataFrame:
    return spark.createDataFrame(sorted(ALLELES.items()), "allele string, sequence string")


_VALUES = ", ".join(f"('{a}', '{s}')" for a, s in sorted(ALLELES.items()))
_FIRST = lambda c: f"regexp_extract({c}, '{_RX['allele']}')"
_GERM = (
    f"WITH rep AS ({REPERTOIRE}), ref(allele, s) AS (VALUES {_VALUES}), al AS ({_ALIGNED}), "
    f"met AS (SELECT al.*, {_FIRST('v_call')} AS va, {_FIRST('j_call')} AS ja, v.s AS vs, j.s AS js FROM al LEFT JOIN ref v ON v.allele = {_FIRST('v_call')} LEFT JOIN ref j ON j.allele = {_FIRST('j_call')}), "
    "cut AS (SELECT *, rpad(substr(vs, 1, 12), 12, 'N') AS vg, rpad(substr(js, 1, 9), 9, 'N') AS jg FROM met), "
    "judged AS (SELECT *, CASE WHEN vs IS NULL THEN concat('Allele ', va, ' is not in the provided germline database.') WHEN js IS NULL THEN concat('Allele ', ja, ' is not in the provided germline database.') "
    "WHEN length(sequence_imgt) <> 23 THEN concat('Germline sequence differs in length from input sequence by ', abs(23 - length(sequence_imgt)), ' characters.') END AS germline_error FROM cut) "
)
_OUT = "SELECT sequence_id, germline_error, CASE WHEN germline_error IS NULL THEN {} END AS germline FROM judged"


@query(_GERM + _OUT.format("upper(concat(vg, 'NN', jg))"))
def germline_full(spark, sf_dir):
    return L.attach_germlines(_aligned(spark, sf_dir), _references(spark)).select("sequence_id", "germline_error", F.col("germline_full").alias("germline"))


@query(_GERM + _OUT.format("upper(concat(vg, 'NN', jg))"))
def germline_dmask(spark, sf_dir):
    return L.attach_germlines(_aligned(spark, sf_dir), _references(spark)).select("sequence_id", "germline_error", F.col("germline_dmask").alias("germline"))


@query(_GERM + _OUT.format("concat(repeat('V', 12), 'NN', repeat('J', 9))"))
def germline_regions(spark, sf_dir):
    return L.attach_germlines(_aligned(spark, sf_dir), _references(spark)).select("sequence_id", "germline_error", F.col("germline_regions").alias("germline"))


@query(
    f"WITH rep AS ({REPERTOIRE}), al AS ({_ALIGNED}), a AS (SELECT junction AS clone, sequence_id, {_FIRST('v_call')} AS v, {_FIRST('j_call')} AS j, length(sequence_imgt) AS n FROM al), "
    "vc AS (SELECT clone, v, count(*) AS c, max(count(*)) OVER (PARTITION BY clone) AS m FROM a GROUP BY clone, v), jc AS (SELECT clone, j, count(*) AS c, max(count(*)) OVER (PARTITION BY clone) AS m FROM a GROUP BY clone, j), "
    "k AS (SELECT a.clone, max(n) AS longest FROM a GROUP BY clone), "
    "cand AS (SELECT a.*, longest, row_number() OVER (PARTITION BY a.clone ORDER BY n <> longest, sequence_id) AS r FROM a JOIN k ON a.clone = k.clone JOIN vc ON vc.clone = a.clone AND vc.v = a.v AND vc.c = vc.m JOIN jc ON jc.clone = a.clone AND jc.j = a.j AND jc.c = jc.m) "
    "SELECT k.clone, cand.sequence_id AS consensus, (SELECT string_agg(v, ',' ORDER BY v) FROM vc WHERE vc.clone = k.clone AND c = m) AS v_cons FROM k LEFT JOIN cand ON cand.clone = k.clone AND r = 1"
)
def clone_consensus(spark, sf_dir):
    return L.consensus(_aligned(spark, sf_dir), clone="junction").select(F.col("junction").alias("clone"), F.col("_cons.sequence_id").alias("consensus"), "v_cons")


# The steps of clone_consensus behind those that it shares with the germlines.
_CONSENSUS = SQL["clone_consensus"].split(f"al AS ({_ALIGNED}), ", 1)[1]
_STEPS, _CHOSEN = _CONSENSUS.rsplit("SELECT k.clone, ", 1)


@query(
    _GERM.rstrip() + ", " + _STEPS + f", cons AS (SELECT k.clone, {_CHOSEN}) "
    "SELECT al.sequence_id, al.sequence_imgt, 9 AS j_germ_length, cons.consensus AS germline_consensus, CASE WHEN judged.sequence_id IS NOT NULL AND judged.germline_error IS NULL THEN upper(concat(vg, 'NN', jg)) END AS germline_dmask, "
    "CASE WHEN cons.consensus IS NULL THEN 'No sequence found with both consensus V and J calls.' ELSE judged.germline_error END AS germline_error "
    "FROM al JOIN cons ON cons.clone = al.junction LEFT JOIN judged ON judged.sequence_id = cons.consensus"
)
def clonal_germlines(spark, sf_dir):
    out = L.attach_clonal_germlines(_aligned(spark, sf_dir), _references(spark), clone="junction")
    return out.select("sequence_id", "sequence_imgt", "j_germ_length", "germline_consensus", "germline_dmask", "germline_error")


# Sequence functions.


@query(_rep("SELECT sequence_id, substr(s, 1, 78) AS fwr1, substr(s, 79, 36) AS cdr1, substr(s, 115, 51) AS fwr2, substr(s, 166, 30) AS cdr2, substr(s, 196, 117) AS fwr3, substr(s, 313, n - 6) AS cdr3, substr(s, 307 + n) AS fwr4 FROM (SELECT sequence_id, repeat(junction, 14) AS s, length(junction) AS n FROM rep)"))
def regions_slice(spark, sf_dir):
    df = repertoire(spark, sf_dir).select("sequence_id", F.repeat("junction", F.lit(14)).alias("s"), F.length("junction").alias("n"))
    return df.select("sequence_id", *[c.alias(r) for r, c in S.regions("s", F.col("n")).items()])


@query(_rep("SELECT sequence_id, cast(10 + length(junction) - 1 AS int) AS v_seq_end, cast(3 + 12 - 1 AS int) AS j_seq_end FROM rep"))
def coords_end(spark, sf_dir):
    df = repertoire(spark, sf_dir).select("sequence_id", F.lit(10).alias("v_seq_start"), F.length("junction").alias("v_seq_length"), F.lit(3).alias("j_seq_start"), F.lit(12).alias("j_seq_length"))
    return R.with_ends(df).select("sequence_id", "v_seq_end", "j_seq_end")


_CODON = f"substr('{S.CODONS}', cast(((instr('{S.CODES}', substr(junction, 3 * i + 1, 1)) - 1) * 15 + instr('{S.CODES}', substr(junction, 3 * i + 2, 1)) - 1) * 15 + instr('{S.CODES}', substr(junction, 3 * i + 3, 1)) AS int), 1)"


@query(_rep(f"SELECT sequence_id, array_to_string(list_transform(range(0, cast(length(junction) // 3 AS int)), lambda i: {_CODON.replace('3 * i', 'cast(3 * i AS int)')}), '') AS protein FROM rep"))
def translate(spark, sf_dir):
    return repertoire(spark, sf_dir).select("sequence_id", S.translate("junction").alias("protein"))


@query(_rep("SELECT sequence_id, reverse(translate(junction, 'ACGTN', 'TGCAN')) AS rc FROM rep"))
def reverse_complement(spark, sf_dir):
    return repertoire(spark, sf_dir).select("sequence_id", S.reverse_complement("junction").alias("rc"))


@query(_rep("SELECT sequence_id, cast(coalesce(list_min(list_filter(range(0, length(junction), 3), lambda i: substr(junction, cast(i AS int) + 1, 3) IN ('TAA', 'TGA', 'TAG', 'TRA', 'TRG', 'TAR', 'TGR', 'TRR'))), -1) AS int) AS stop FROM rep"))
def first_stop(spark, sf_dir):
    return repertoire(spark, sf_dir).select("sequence_id", S.first_stop("junction").alias("stop"))


@query("SELECT o_orderkey, concat(CASE WHEN o_orderkey % 9 > 0 THEN concat(o_orderkey % 9, 'S') ELSE '' END, o_orderkey % 90 + 1, '=2X') AS cigar, cast(o_orderkey % 9 AS int) AS q_start, cast(o_orderkey % 90 + 3 AS int) AS q_length FROM orders")
def btop_cigar(spark, sf_dir):
    """Where the alignment starts with the query, no soft clip is put before it."""
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.expr("o_orderkey % 90 + 1"), F.lit("AGTC")).alias("btop"), F.expr("cast(o_orderkey % 9 as int)").alias("q"))
    df = df.withColumn("a", S.pad_alignment(S.decode_btop("btop"), F.col("q"), F.lit(0))).withColumn("p", S.alignment_positions("a"))
    return df.select("o_orderkey", S.encode_cigar("a").alias("cigar"), F.col("p.q_start").alias("q_start"), F.col("p.q_length").alias("q_length"))


@query("SELECT o_orderkey, try_cast(replace(cast(o_orderpriority AS varchar), '-', '') AS int) AS as_int, CASE WHEN o_orderstatus IN ('T', 'TRUE', 'True') THEN true WHEN o_orderstatus IN ('F', 'FALSE', 'False') THEN false END AS as_bool, upper(o_orderpriority) AS as_seq FROM orders")
def types_parse(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    return df.select("o_orderkey", R.parse(F.replace("o_orderpriority", F.lit("-"), F.lit("")), "integer").alias("as_int"), R.parse(F.col("o_orderstatus"), "logical").alias("as_bool"), R.parse(F.col("o_orderpriority"), "nucleotide").alias("as_seq"))


@query(_rep("SELECT sequence_id AS \"SEQUENCE_ID\", v_call AS \"V_CALL\", junction AS \"JUNCTION\", productive AS \"FUNCTIONAL\" FROM rep"))
def convert_legacy(spark, sf_dir):
    return R.convert(repertoire(spark, sf_dir).select("sequence_id", "v_call", "junction", "productive"), "airr", "legacy")


# Export and trees.


@query(_rep("SELECT concat('>', sequence_id, '|SAMPLE_ID=', sample_id, '|PRODUCTIVE=', productive, chr(10), junction) AS fasta FROM rep"))
def fasta_export(spark, sf_dir):
    return X.fasta(repertoire(spark, sf_dir), seq="junction", fields=["sample_id", "productive"]).where("passed").select("fasta")


_OWN = "'>', sequence_id, chr(10), junction"


@query(_rep(f"SELECT CASE WHEN row_number() OVER (PARTITION BY sample_id ORDER BY sequence_id) = 1 THEN concat('>>', sample_id, chr(10), v_call, chr(10), {_OWN}) ELSE concat({_OWN}) END AS fasta FROM rep"))
def clonal_fasta(spark, sf_dir):
    """Records sorted by cluster."""
    return X.clonal_fasta(repertoire(spark, sf_dir), seq="junction", germline="v_call", cluster="sample_id", order=["sample_id", "sequence_id"]).select("fasta")


@query(_rep(f"SELECT CASE WHEN sample_id IS DISTINCT FROM lag(sample_id) OVER (ORDER BY sequence_id) THEN concat('>>', sample_id, chr(10), v_call, chr(10), {_OWN}) ELSE concat({_OWN}) END AS fasta FROM rep"))
def clonal_fasta_unsorted(spark, sf_dir):
    """A germline wherever the cluster changes, also back to one that was there before."""
    return X.clonal_fasta(repertoire(spark, sf_dir), seq="junction", germline="v_call", cluster="sample_id", order="sequence_id").select("fasta")


@query(_rep(f"SELECT concat('>>', sequence_id, chr(10), v_call, chr(10), {_OWN}) AS fasta FROM rep"))
def clonal_fasta_by_record(spark, sf_dir):
    return X.clonal_fasta(repertoire(spark, sf_dir), seq="junction", germline="v_call", order="sequence_id").select("fasta")


@query(_rep("SELECT junction, sample_id, cast(sum(1) AS bigint) AS dupcount, min(sequence_id) AS sequence_id FROM rep GROUP BY junction, sample_id"))
def dup_collapse(spark, sf_dir):
    return T.collapse_exact(repertoire(spark, sf_dir).withColumn("dupcount", F.lit(1)), ["junction", "sample_id"]).select("junction", "sample_id", "dupcount", "sequence_id")


_STOP = "len(list_filter(range(0, length(junction), 3), lambda i: substr(junction, cast(i AS int) + 1, 3) IN ('TAA', 'TGA', 'TAG', 'TRA', 'TRG', 'TAR', 'TGR', 'TRR'))) > 0"
_FILLED = "concat(substr(junction, 1, length(junction) - length(junction) % 3), CASE WHEN length(junction) % 3 > 0 THEN 'NNN' ELSE '' END)"


@query(
    _rep(
        f"SELECT junction AS clone, sequence_id, {_FILLED} AS sequence, CASE WHEN r = 1 THEN n ELSE 1 END AS dupcount, r = 1 AS kept, CASE WHEN r > 1 THEN concat('Duplication of ', lead_id) END AS fail_reason, cast(1 AS int) AS clone_size FROM ("
        f"SELECT *, row_number() OVER (PARTITION BY junction ORDER BY sequence_id) AS r, count(*) OVER (PARTITION BY junction) AS n, min(sequence_id) OVER (PARTITION BY junction) AS lead_id FROM rep WHERE productive = 'T' AND NOT ({_STOP}))"
    )
)
def lineage_input(spark, sf_dir):
    """Codon masking and clone alignment over the repertoire, each junction a clone: an incomplete last codon is masked, duplicates are merged."""
    df = repertoire(spark, sf_dir).select("sequence_id", "v_call", "j_call", "junction", F.col("junction").alias("clone"), (F.col("productive") == "T").alias("functional"), F.length("junction").alias("junction_length"), F.lit(1).alias("v_seq_start"))
    df = df.withColumn("sequence_input", F.concat(F.col("junction"), F.lit("GGCCAA"))).withColumn("sequence_imgt", F.concat(F.substring("junction", 1, 9), F.lit("..."), F.expr("substring(junction, 10)")))
    df = df.withColumn("germline_imgt_d_mask", F.concat(F.substring("junction", 1, 9), F.lit("..."), F.expr("repeat('N', length(junction) - 9)")))
    masked = T.mask_records(df)
    return T.align_clones(masked, collapse=True).select("clone", "sequence_id", "sequence", "dupcount", "kept", "fail_reason", "clone_size")
