import numpy as np
import pytest

from surprisal.alphabet import ENGLISH
from surprisal.models import Unigram
from surprisal.operators import validation


def test_draws_in_pieces_are_one_stream(monkeypatch):
    r = np.random.default_rng(1)
    events, bits = r.integers(1, 2000, 1001).astype(float), r.random(1001)
    drawn = validation.draws(1001, 7, 42)
    want = bits[drawn].sum(axis=1) / events[drawn].sum(axis=1)
    for piece in (1 << 20, 1000, 33):
        monkeypatch.setattr(validation, "DRAWS_AT_ONCE", piece)
        assert np.allclose(validation.resampled(events, bits, 7, 42), want, rtol=1e-12)


def test_more_draws_than_were_allowed():
    n = 250_100  # times 200 draws: over 50 million
    got = validation.resampled(np.full(n, 2.0), np.full(n, 3.0), 200, 42)
    assert len(got) == 200 and np.allclose(got, 1.5)


def test_many_blocks_are_resampled_distributed(spark, segs, monkeypatch):
    test = segs("hello world this is a bootstrap test " * 250, "quite another text with zebras and jazz " * 100)
    model = Unigram(ENGLISH).fit(test)
    few = validation.block_bootstrap(test, model, 50, 300)
    monkeypatch.setattr(validation, "BLOCKS_MOST", 10)
    many = validation.block_bootstrap(test, model, 50, 300)
    assert set(many) == set(few) and many["n_blocks"] == few["n_blocks"] > 10
    for k in ("mean_bpc", "std_bpc", "ci_lower_bpc", "ci_upper_bpc"):
        assert many[k] == pytest.approx(few[k], abs=0.01)


def test_queries_draw_as_often_as_the_configuration():
    from surprisal.config import Config
    from surprisal.plans import queries

    assert queries.RESAMPLES == Config().resamples == 1000


def test_poisson_draws_are_those_of_the_digests(spark):
    from hashlib import md5

    rows = [(k, i, float(10 + i), 3.5 * i + k) for k in (1, 2) for i in range(30)]
    costs = spark.createDataFrame(rows, "source int, block_id int, events double, bits double").repartition(3)
    bounds = np.cumsum([np.exp(-1.0) / np.prod(np.arange(1, k + 1)) for k in range(12)])
    for by in ([], ["source"]):
        got = {tuple(r[k] for k in by): r.mean_bpc for r in validation.poisson_bootstrap(costs, 10, by=by).collect()}
        for key in {(r[0],) if by else () for r in rows}:
            h = []
            for r in range(10):
                sums = np.zeros(2)
                for k, i, events, bits in rows:
                    if not by or (k,) == key:
                        u = int(md5(f"{k}:{i}:{r // 4}:42".encode()).hexdigest()[r % 4 * 8 : r % 4 * 8 + 8], 16) / 2**32
                        sums += np.array([bits, events]) * (u >= bounds).sum()
                h.append(sums[0] / sums[1])
            assert got[key] == pytest.approx(np.mean(h), rel=1e-12)


def test_poisson_rows_are_not_made_for_each_draw(spark, segs):
    costs = validation.block_costs(segs("ab " * 5000), Unigram(ENGLISH).fit(segs("ab ")), 50)
    assert "Generate explode(sequence" not in validation.poisson_bootstrap(costs, 1000)._jdf.queryExecution().optimizedPlan().toString()
