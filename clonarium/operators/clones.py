"""Clonal assignment: grouping by gene calls and junction length, then clustering of distinct junctions by distance."""

from __future__ import annotations

from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clonarium.functions import distance as D
from clonarium.functions import genes as G
from clonarium.functions.sequences import translate
from clonarium.operators.verbs import index
from clonarium.plans.components import components
from clonarium.plans.store import partitions, ship, stash

#: Distinct junctions up to which a group is clustered by its distance matrix in one task: 8 * 1000 ** 2 bytes are 8 MB.
LARGE = 1000
#: Distinct junctions beyond which no matrix is made, whatever the linkage: 8 * 16000 ** 2 bytes are 2 GB.
MOST = 16_000


def _calls(mode: str, action: str):
    if mode not in ("allele", "gene"):
        raise ValueError("mode is allele or gene")
    return lambda c: (G.allele if mode == "allele" else G.gene)(c, action)


def _named(fields: list[str] | None) -> list[str]:
    return list(fields or [])


def key_first(df: DataFrame, mode: str = "gene", fields: list[str] | None = None, v: str = "v_call", j: str = "j_call", junction: str = "junction") -> DataFrame:
    """Adds ``pre``: (V, J, junction length, further fields) by first calls; null where any part is missing or empty.

    The length is that of the junction text; 0 is a length like others.
    """
    call = _calls(mode, "first")
    parts = [call(v).alias("v"), call(j).alias("j"), F.length(F.coalesce(F.col(junction), F.lit(""))).alias("length"), *[F.nullif(F.col(f).cast("string"), F.lit("")).alias(f) for f in _named(fields)]]
    whole = reduce(and_, [p.isNotNull() for p in parts])
    return df.withColumn("pre", F.when(whole, F.to_json(F.struct(*parts))))


def key_set(df: DataFrame, mode: str = "gene", fields: list[str] | None = None, v: str = "v_call", j: str = "j_call", junction: str = "junction") -> DataFrame:
    """Adds ``pre`` by ambiguous calls: records of one length (and further fields) that share a V and a J are together, and so on along chains.

    Distinct calls are few beside records, so names are parsed, linked and grouped once for each distinct combination of calls, length and fields, and
    records are joined to the outcome. Two cells share a V and a J if they have a (V, J) pair in common, so the groups are the components of
    cells and pairs. Order of rows plays no part.
    """
    call = _calls(mode, "set")
    raw = [F.coalesce(F.col(v).cast("string"), F.lit("")), F.coalesce(F.col(j).cast("string"), F.lit("")), F.length(F.coalesce(F.col(junction), F.lit(""))), *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in _named(fields)]]
    names = ["_v", "_j", "_n", *[f"_f{i}" for i in range(len(raw) - 3)]]
    distinct = stash(df.select(*[c.alias(n) for c, n in zip(raw, names, strict=True)]).distinct(), "cells")
    whole = reduce(and_, [call("_v").isNotNull(), call("_j").isNotNull(), *[F.col(n) != "" for n in names[3:]]])
    scope = F.to_json(F.struct(F.col("_n").alias("length"), *[F.col(n).alias(f) for n, f in zip(names[3:], _named(fields), strict=True)]))
    cells = distinct.where(whole).select(*names, scope.alias("_scope"), call("_v").alias("_vs"), call("_j").alias("_js"))
    cells = cells.withColumn("_cell", F.concat_ws("|", "_scope", F.array_join("_vs", ","), F.array_join("_js", ",")))
    pairs = cells.select("_scope", "_cell", F.explode("_vs").alias("_a"), "_js").withColumn("_b", F.explode("_js")).select("_cell", F.concat_ws("|", "_scope", "_a", "_b").alias("_pair")).distinct()
    # Links run from each cell to the least cell of each of its pairs: a star for each pair, however many cells hold it.
    least = pairs.groupBy("_pair").agg(F.min("_cell").alias("v"))
    links = pairs.join(least, "_pair").where("_cell <> v").select(F.col("_cell").alias("u"), "v").distinct()
    group = components(links).select(F.col("u").alias("_cell"), F.col("v").alias("_least"))
    found = cells.select(*names, "_cell").join(group, "_cell", "left").select(*[F.col(n).alias(f"_{n}") for n in names], F.coalesce("_least", "_cell").alias("pre"))
    same = reduce(and_, [c == F.col(f"_{n}") for c, n in zip(raw, names, strict=True)])
    return df.join(found, same, "left").drop(*[f"_{n}" for n in names])


def key_sequential(df: DataFrame, order: str, mode: str = "gene", fields: list[str] | None = None, v: str = "v_call", j: str = "j_call", junction: str = "junction") -> DataFrame:
    """Adds ``pre`` by a fold over the rows of a length in their order: a row joins every group whose V names and J names both
    overlap with its own, and the joined groups pool their names. Depends on the order; kept for parity with tools that fold."""
    ship(df.sparkSession)
    call = _calls(mode, "set")
    length = F.length(F.coalesce(F.col(junction), F.lit("")))
    fixed = [F.nullif(F.col(f).cast("string"), F.lit("")) for f in _named(fields)]
    whole = reduce(and_, [call(v).isNotNull(), call(j).isNotNull(), *[c.isNotNull() for c in fixed]])
    scope = F.to_json(F.struct(length.alias("length"), *[c.alias(f) for c, f in zip(fixed, _named(fields), strict=True)]))
    d = df.withColumn("_scope", F.when(whole, scope))
    cells = d.where("_scope is not null").groupBy("_scope", call(v).alias("_vs"), call(j).alias("_js")).agg(F.min(order).alias("_first"))

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        groups: list[tuple[set, set, list]] = []
        for i in rows.sort_values("_first").index:
            own = ({*rows.at[i, "_vs"]}, {*rows.at[i, "_js"]}, [i])
            rest = []
            for g in groups:
                if g[0] & own[0] and g[1] & own[1]:
                    own = (own[0] | g[0], own[1] | g[1], g[2] + own[2])
                else:
                    rest.append(g)
            groups = [*rest, own]
        out = rows[["_scope", "_vs", "_js"]].copy()
        out["pre"] = ""
        for g in groups:
            out.loc[g[2], "pre"] = f"{rows.at[g[2][0], '_scope']}|{','.join(sorted(g[0]))}|{','.join(sorted(g[1]))}"
        return out

    folded = cells.groupBy("_scope").applyInPandas(fold, "_scope string, _vs array<string>, _js array<string>, pre string")
    d = d.withColumn("_vs", call(v)).withColumn("_js", call(j))
    return d.join(folded, ["_scope", "_vs", "_js"], "left").drop("_scope", "_vs", "_js")


def few_missing(sequence: Column, most: int = 0) -> Column:
    """Whether a sequence is there and has ``most`` letters other than ACGT at most."""
    text = F.coalesce(sequence, F.lit(""))
    return (text != "") & (F.length(F.regexp_replace(text, "[ACGT]", "")) <= most)


def node(sequence: Column, model: str) -> Column:
    """What is compared: gaps as N; under the amino acid model translated, after padding with N to whole codons."""
    masked = F.translate(sequence, "-.", "NN")
    if model != "aa":
        return masked
    return translate(F.concat(masked, F.repeat(F.lit("N"), F.pmod(-F.length(masked), F.lit(3)))))


def _by_matrix(nodes: DataFrame, model: str, threshold: float, linkage: str, norm: str | None, sym: str, by: str = "pre") -> DataFrame:
    """(pre, seq) -> with ``root``, the least member of its cluster: one task for the members of one ``by``, ``MOST`` at most."""
    most = MOST

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        if len(rows) > most:
            raise ValueError(f"{len(rows)} distinct junctions need one distance matrix; {most} can: lower the threshold, or use single linkage")
        rows = rows.sort_values("seq", ignore_index=True)
        label = D.cluster(rows["seq"].tolist(), D.model(model), threshold, linkage, norm, sym)
        least = pd.Series(rows["seq"]).groupby(label).transform("min")
        return pd.DataFrame({"pre": rows["pre"], "seq": rows["seq"], "root": least})

    return nodes.groupBy(*dict.fromkeys(("pre", by))).applyInPandas(run, "pre string, seq string, root string")


def unlike_weight(model: str) -> float:
    """Least distance of two unlike letters among ACGT; 0 if some unlike letters are at no distance."""
    m = D.model(model)
    if m.size > 1:
        return 0.0
    if model == "aa":
        return 1.0  # whole codons of ACGT give single residues
    at = [m.letters.index(c) for c in "ACGT"]
    return float(min(m.table[i, j] for i in at for j in at if i != j))


# Letters of a packed sequence and the bits of each, by kind of sequence; a word holds the largest whole number of letters
# below 64 bits.
PACKED = {"bases": ("ACGT", "0123", 2), "residues": ("*ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdefghijklmnopq", 5)}


def _pack(seq: str, words: int, kind: str) -> list[Column]:
    """Columns of 64-bit words that hold a sequence's letters as digits."""
    letters, digits, bits = PACKED[kind]
    size = 62 // bits
    text = F.translate(F.col(seq), letters, digits)
    # A short last word counts as filled up with the first letter; sequences of one length are filled up alike.
    return [F.coalesce(F.conv(F.nullif(F.substring(text, i * size + 1, size), F.lit("")), 1 << bits, 10).cast("long"), F.lit(0)) for i in range(words)]


def _packed_distance(words: int, model: str, kind: str) -> str:
    """Distance of two packed sequences (columns a0.. and b0..) by counts of bits: of unlike letters, or of unlike bases by the kind of pair."""
    bits = PACKED[kind][2]
    ones = sum(1 << (bits * i) for i in range(62 // bits))
    x = [f"(a{i} ^ b{i})" for i in range(words)]
    if kind == "residues":
        return " + ".join(f"bit_count(({' | '.join(f'shiftright({w}, {k})' for k in range(bits))}) & {ones}L)" for w in x)
    m = D.model(model)
    weight = [float(m.table[m.letters.index("A"), m.letters.index(c)]) for c in "CGT"]
    if weight[0] == weight[1] == weight[2]:
        return f"{weight[0]!r}D * (" + " + ".join(f"bit_count(({w} | shiftright({w}, 1)) & {ones}L)" for w in x) + ")"
    # As digits, A-C and G-T differ by 1, A-G and C-T by 2, A-T and C-G by 3.
    low, high = [f"({w} & {ones}L)" for w in x], [f"(shiftright({w}, 1) & {ones}L)" for w in x]
    count = lambda f: " + ".join(f"bit_count({f(lo, hi)})" for lo, hi in zip(low, high, strict=True))
    kinds = (count(lambda lo, hi: f"{lo} & ~{hi}"), count(lambda lo, hi: f"{hi} & ~{lo}"), count(lambda lo, hi: f"{lo} & {hi}"))
    return " + ".join(f"{w!r}D * ({k})" for w, k in zip(weight, kinds, strict=True))


def packed_kind(model: str) -> str | None:
    """How sequences of a model are packed; None if its distances do not follow from packed letters."""
    if model == "aa":
        return "residues"
    m = D.model(model)
    if m.size > 1:
        return None
    d = lambda a, b: m.table[m.letters.index(a), m.letters.index(b)]
    alike = all(d(*p) == d(*q) == d(*reversed(p)) == d(*reversed(q)) for p, q in (("AC", "GT"), ("AG", "CT"), ("AT", "CG")))
    return "bases" if alike else None


def close_pairs(nodes: DataFrame, model: str, threshold: float, norm: str | None) -> DataFrame:
    """Pairs (pre, u, v) of distinct junctions within the threshold, without a matrix: exact, by shuffles only.

    Within the threshold two junctions differ in k places at most, with k from the least weight of an unlike place. Dealt into
    k + 1 segments, they agree in one at least; so segments are joined. Places are dealt in turn, so that what all junctions have in common, such
    as their ends, is spread over all segments, and each has places that tell junctions apart. Candidates are measured by bit counts on packed
    letters within the join, and a pair counts in the first segment that it shares, so only pairs within the threshold are shuffled.
    """
    least = unlike_weight(model)
    kind = packed_kind(model)
    if least <= 0 or norm == "mut" or kind is None:
        raise ValueError("segments need a positive weight of every unlike place, and a norm that does not depend on the pair")
    scale = "length(seq)" if norm == "len" else "1"
    spark = nodes.sparkSession
    # Read several times below: written once, and cut off from the expressions that made it, so that none of them is evaluated by letter.
    nodes = stash(nodes.select("pre", "seq").repartition(partitions(spark), "pre", "seq"), "nodes")
    d = nodes.where("length(seq) > 0").withColumn("_k", F.expr(f"cast(floor({threshold}D * {scale} / {least}D + 1e-9D) as int)"))
    longest = d.agg(F.max(F.length("seq"))).first()[0] or 1
    words = -(-longest // (62 // PACKED[kind][2]))
    # Where every place may be unlike, some segments are empty: such junctions are all compared.
    parts = d.withColumn("_texts", F.expr("transform(sequence(0, least(_k, length(seq))), p -> case when p < length(seq) then array_join(transform(sequence(p + 1, length(seq), _k + 1), i -> substring(seq, i, 1)), '') else '' end)"))
    parts = parts.select("pre", "seq", F.length("seq").alias("_n"), "_texts", *[c.alias(f"w{i}") for i, c in enumerate(_pack("seq", words, kind))])
    parts = parts.select("*", F.posexplode("_texts").alias("_part", "_text"))
    side = lambda name, letter: parts.select("pre", "_n", "_part", "_text", F.col("seq").alias(name), F.col("_texts").alias(f"_{letter}"), *[F.col(f"w{i}").alias(f"{letter}{i}") for i in range(words)])
    over = "_n" if norm == "len" else "1"
    distance = F.expr(f"({_packed_distance(words, model, kind)}) / {over}")
    first = F.expr("not exists(sequence(0, _part), p -> p < _part and _a[p] = _b[p])")
    met = side("u", "a").join(side("v", "b"), ["pre", "_n", "_part", "_text"]).where((F.col("u") < F.col("v")) & (distance <= threshold) & first)
    return met.select("pre", "u", "v", distance.alias("distance"))


def _by_segments(nodes: DataFrame, model: str, threshold: float, norm: str | None) -> DataFrame:
    name = lambda c: F.concat("pre", F.lit("|"), c)
    links = close_pairs(nodes, model, threshold, norm).select(name("u").alias("u"), name("v").alias("v"))
    found = components(links).select(F.col("u").alias("_node"), F.substring_index("v", "|", -1).alias("root"))
    return nodes.join(found, name("seq") == F.col("_node"), "left").select("pre", "seq", F.coalesce("root", "seq").alias("root"))


def assign_clones(
    df: DataFrame, threshold: float = 0.0, model: str = "ham", linkage: str = "single", norm: str | None = "len", sym: str = "avg", mode: str = "gene", action: str = "set",
    max_missing: int = 0, fields: list[str] | None = None, junction: str = "junction", v: str = "v_call", j: str = "j_call", grouping: str = "components", order: str | None = None,
    large: int = LARGE,
) -> DataFrame:
    """The rows with ``pre`` (their group), ``clone`` (null for rows that fail) and ``passed``.

    ``clone`` names a clone by its group and least junction, whatever the order of rows; ``number_clones`` gives running numbers.
    Rows without a group, without a junction, or with more than ``max_missing`` letters other than ACGT fail. Groups with more than ``large``
    distinct junctions are linked by segments, by shuffles only; that is single linkage. Average and complete linkage never join what single
    linkage keeps apart at the threshold, so a matrix then needs only the members of one such component. Other groups have a matrix
    in one task each, as do all groups where segments do not apply (missing letters, norm ``mut``, tables by windows); beyond ``MOST``
    junctions a matrix is refused.

    ``action``: first calls, or sets of calls joined by ``grouping`` components (default) or sequential (needs ``order``).
    """
    spark = df.sparkSession
    ship(spark)
    names = {"mode": mode, "fields": fields, "v": v, "j": j, "junction": junction}
    # All that follows depends on the calls, the junction and the fields: it is done once for each distinct combination.
    raw = list(dict.fromkeys([v, j, junction, *_named(fields)]))
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in raw}
    cells = df.select(*[text[c].alias(c) for c in raw], *([F.col(order)] if order else []))
    cells = stash(cells.groupBy(*raw).agg(F.min(order).alias(order)) if order else cells.distinct(), "cells")
    if action == "first":
        keyed = key_first(cells, **names)
    elif grouping == "components":
        keyed = key_set(cells, **names)
    else:
        keyed = key_sequential(cells, order, **names)
    keyed = keyed.withColumn("_seq", F.when(F.col("pre").isNotNull() & few_missing(F.col(junction), max_missing), node(F.col(junction), model)))
    keyed = stash(keyed.select(*raw, "pre", "_seq"), "keyed")
    nodes = stash(keyed.where("_seq is not null").select("pre", F.col("_seq").alias("seq")).distinct(), "nodes")
    segments = max_missing == 0 and norm != "mut" and packed_kind(model) is not None and unlike_weight(model) > 0
    big = nodes.groupBy("pre").count().where(F.col("count") > large).select("pre")
    if segments and big.limit(1).count():
        found = _by_matrix(nodes.join(big, "pre", "left_anti"), model, threshold, linkage, norm, sym)
        linked = _by_segments(nodes.join(big, "pre", "left_semi"), model, threshold, norm)
        if linkage != "single":
            parted = stash(linked.withColumnRenamed("root", "part"), "parts")
            alone = parted.groupBy("pre", "part").agg(F.count("*").alias("n")).where("n = 1").select("pre", "part")
            linked = _by_matrix(parted.join(alone, ["pre", "part"], "left_anti"), model, threshold, linkage, norm, sym, "part")
            linked = linked.unionByName(alone.select("pre", F.col("part").alias("seq"), F.col("part").alias("root")))
        found = found.unionByName(linked)
    else:
        found = _by_matrix(nodes, model, threshold, linkage, norm, sym)
    found = keyed.join(found.withColumnRenamed("seq", "_seq"), ["pre", "_seq"], "left").select(*[F.col(c).alias(f"_raw{i}") for i, c in enumerate(raw)], "pre", "root")
    same = reduce(and_, [text[c] == F.col(f"_raw{i}") for i, c in enumerate(raw)])
    out = df.join(found, same, "left").drop(*[f"_raw{i}" for i in range(len(raw))])
    return out.withColumn("clone", F.when(F.col("root").isNotNull(), F.concat_ws("|", "pre", "root"))).withColumn("passed", F.col("root").isNotNull()).drop("root")


def number_clones(df: DataFrame, order: str, clone: str = "clone") -> DataFrame:
    """Replaces clone names by running numbers, as text, in the order of each clone's first row; no task sees all clones."""
    first = df.where(F.col(clone).isNotNull()).groupBy(clone).agg(F.min(order).alias("_first"))
    numbers = index(first, "_number", ["_first", clone]).select(F.col(clone).alias("_clone"), F.col("_number").cast("string").alias("_number"))
    return df.join(numbers, F.col(clone) == F.col("_clone"), "left").withColumn(clone, F.col("_number")).drop("_number", "_clone")


def sized(df: DataFrame, least: int, clone: str = "clone", only: list[str] | None = None) -> DataFrame:
    """Rows of clones with ``least`` rows at least, all rows counted; of the listed clones, if any are listed."""
    if only:
        df = df.where(F.col(clone).isin(*only))
    return df.join(df.groupBy(clone).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(clone), clone, "left_semi")


def subsample(df: DataFrame, depth: int, seed: int = 0, passed: Column | None = None) -> DataFrame:
    """``depth`` of the rows that pass, at random by seed."""
    return (df if passed is None else df.where(passed)).orderBy(F.rand(seed)).limit(depth)


def call_groups(df: DataFrame, calls: list[str] | None = None, mode: str = "gene", fields: list[str] | None = None) -> DataFrame:
    """Adds ``group``: first calls of the chosen segments and further fields; null where a part is null (not where it is empty)."""
    call = _calls(mode, "first")
    parts = [call(f"{s}_call").alias(s) for s in calls or []] + [F.col(f).cast("string").alias(f) for f in _named(fields)]
    if not parts:
        return df.withColumn("group", F.lit("{}"))
    return df.withColumn("group", F.when(reduce(and_, [p.isNotNull() for p in parts]), F.to_json(F.struct(*parts))))
