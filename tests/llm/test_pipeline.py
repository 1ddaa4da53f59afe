from __future__ import annotations

from collections import Counter

import corpus_pipeline
from clonarium.llm.mixing import mix
from clonarium.llm.packing import CAPACITIES, word_ids
from clonarium.llm.quality import assess
from tests.llm.fixtures import corpus
from tests.llm.test_ngram_join import brute
from tests.llm.test_packing import check, cut

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_take_effect_in_turn(spark, tmp_path):
    rows = [(d, t, "en", s, len(t or "")) for d, t, s in corpus()]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    made = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        made.append((docs, docs := spark.read.parquet(f"{tmp_path}/{name}")))
    (all_, good), (_, single), (_, mixed), (_, packed) = made
    assert all(x.columns == all_.columns for x in (good, single, mixed))
    ids = lambda df: Counter(r.doc_id for r in df.select("doc_id").collect())
    kept = {r.doc_id for r in assess(all_).where("kept").select("doc_id").collect()}
    assert set(ids(good)) - {None} == kept - {None}
    have = [(r.doc_id, r.text) for r in good.collect()]
    assert {d for d in ids(single) if d is not None} == {c for d, _, c in brute(have, 5, 4, 5) if d is not None}
    assert ids(mixed) == Counter({r.doc_id: len(r.shards) for r in mix(single).collect() if len(r.shards) and r.doc_id is not None})
    rows = packed.collect()
    ids_of = [(r.doc_id, r.t) for r in mixed.select("doc_id", word_ids().alias("t")).collect()]
    assert check(rows, CAPACITIES) == cut(ids_of, max(CAPACITIES))
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(str, again.collect())) == sorted(map(str, rows))
