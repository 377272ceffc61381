import hashlib

import numpy as np
from conftest import DATA
from test_decontam import brute as brute_hits
from test_resemblance import brute as brute_kept

import corpus_pipeline
from surprisal.llm import bpe, decontam, quality
from surprisal.llm.queries import oracle_sql, queries, vocabulary


def test_pipeline_by_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    model = quality.fit(docs, labels)
    texts = {i: t for i, t in texts.items() if model.score(t) >= 0.5}
    stays = brute_kept(texts)
    texts = {i: t for i, t in texts.items() if i in stays}
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    hits = brute_hits(texts, items)
    index = decontam.Index.build((i, min(13, len(ws)), ws) for i, t in items if (ws := decontam.words(t)))
    texts = {i: decontam.cut(t, index.hits(decontam.words(t))[0]) for i, t in texts.items() if not hits[i][-1]}
    masked = {r.doc_id: r.text for r in corpus_pipeline.mask_personal_data(spark, spark.createDataFrame(list(texts.items()), "doc_id bigint, text string"), DATA).collect()}
    coder = bpe.load(vocabulary())
    want = {i: coder.encode([t])[0] for i, t in masked.items()}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, DATA).collect()}
    assert set(got) == set(want) and 0 < len(got) < docs.count()
    for i, r in got.items():
        assert r.ids == want[i].tolist() and r.n_tokens == len(r.ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(masked[i].encode()).hexdigest()


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, DATA).columns == docs.columns
        assert stage(spark, docs.where("false"), DATA).count() == 0
    assert set(oracle_sql()) <= set(queries())
    assert len(queries()) == 11
