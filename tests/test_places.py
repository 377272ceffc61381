"""Places of symbols, made in Arrow batches."""

from pyspark.sql import functions as F

from surprisal.alphabet import ENGLISH, ROMANIAN_32
from surprisal.plans import queries

TEXTS = ["", "Hello, World!", None, "Bună ziua", "é" * 2500]


def test_places_are_those_of_the_plain_definition(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string").coalesce(1)
    for a in (ENGLISH, ROMANIAN_32):
        ix = a.index_column(F.col("text"))
        assert "transform(" not in rows.select(ix.alias("ix"))._jdf.queryExecution().optimizedPlan().toString()
        got = rows.select("id", ix.alias("ix")).select("id", "ix", a.symbols_column(F.col("ix")).alias("back")).orderBy("id").collect()
        assert [r.ix for r in got] == [t if t is None else a.to_indices(t) for t in TEXTS]
        assert [r.back for r in got] == [t if t is None else a.normalize(t) for t in TEXTS]
    odd = spark.createDataFrame([([0, -1, 27, None, 26, 2],), ([],), (None,)], "ix array<int>").coalesce(1)
    assert [r[0] for r in odd.select(ENGLISH.symbols_column(F.col("ix"))).collect()] == ["a c", "", None]


def test_checksums_of_whole_texts(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {i: (None if t is None else len(t), sum(x * (k % 1000 + 1) for k, x in enumerate(ENGLISH.to_indices(t or "")))) for i, t in enumerate(TEXTS)}
    found = queries.to_indices(spark, str(tmp_path))
    assert {r.doc_id: (r.n, r.checksum) for r in found.collect()} == want
    assert found.dtypes == [("doc_id", "bigint"), ("n", "bigint"), ("checksum", "bigint")]


def test_texts_are_gone_over_once_for_their_places_in_a_row(spark):
    from surprisal.operators import segments

    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text(i):
        made.add(1)
        return "" if i % 7 == 3 else "abc" * i

    rows = spark.range(20).select(F.col("id").alias("seg_id"), text.asNondeterministic()("id").alias("text"))
    texts = {i: "" if i % 7 == 3 else "abc" * i for i in range(20)}
    start, left, n, held = {}, {}, 0, ""
    for i, t in texts.items():
        if t:
            start[i], left[i] = n, held[-5:]
        n, held = n + len(t), held + t
    found = segments.offsets(rows)
    assert {r.seg_id: r.start for r in found.collect()} == start and made.value == 20
    assert {r.seg_id: r.left for r in segments.carried(rows, 5).collect()} == left and made.value == 60
