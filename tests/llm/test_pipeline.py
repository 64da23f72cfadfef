from collections import Counter

import corpus_pipeline
from cadenza.llm import common, quality_classifier, quality_rules, tokens

from .cases import documents
from .test_resemblance import brute_kept


def test_stages_in_turn(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    given = {r["doc_id"]: r["text"] for r in docs.collect()}
    model = quality_classifier.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    compressors = quality_classifier.Compressors(model.good, model.bad)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = common.cut(stage(spark, docs, sf), name)
        if k < 3:
            assert out.columns == names
            left = {r["doc_id"] for r in out.collect()}
        if name == "quality_classifier":
            score = quality_classifier.logistic(quality_classifier.expand(compressors.features(list(given.values())), model.centre, model.scale) @ model.weights)
            assert left == {i for i, s in zip(given, score) if s >= 0.3}
        elif name == "quality_rules":
            found = quality_rules.measure(list(given.values()), quality_rules.Limits(), {})
            assert left == {i for i, kept in zip(given, found["kept"]) if kept}
        elif name == "simhash_dedup":
            ids = sorted(given)
            assert left == {ids[i] for i in brute_kept([given[i] for i in ids])}
        else:
            library = tokens.load(tokens.public_path("byte_bpe_50k.json"))
            size = Counter()
            for r in out.collect():
                size[r["doc_id"]] += r["length"]
            assert size == Counter({i: 1 + len(library.encode(t, add_special_tokens=False).ids) for i, t in given.items()})
        docs = out
        if k < 3:
            given = {i: t for i, t in given.items() if i in left}
    assert corpus_pipeline.run(spark, sf).count() == docs.count()


def test_stages_on_odd_and_no_rows(spark, tmp_path):
    spark.createDataFrame([(1, 1, 0), (9, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for rows in (None, []):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, documents(spark, rows), str(tmp_path)).collect()
