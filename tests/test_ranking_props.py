"""Property tests: the distributed rank / quantile operator equals pandas and numpy."""
import numpy as np
import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from churnwise.operators import ranking

values = st.lists(st.integers(min_value=-50, max_value=50).map(lambda v: v / 4.0), min_size=1, max_size=60)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(vals=values, buckets=st.sampled_from([1, 3, 16, 256]))
def test_avg_rank_pct_matches_pandas(spark, vals, buckets):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "id int, v double")
    got = ranking.avg_rank_pct(df, "v", "p", buckets=buckets).orderBy("id").toPandas()["p"].to_numpy()
    want = pd.Series(vals).rank(pct=True).to_numpy()
    assert np.allclose(got, want, rtol=0, atol=1e-15)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(vals=values, buckets=st.sampled_from([1, 5, 64]),
       probs=st.lists(st.sampled_from([0.0, 0.05, 0.25, 0.5, 0.8, 0.95, 1.0]), min_size=1, max_size=4))
def test_exact_quantiles_match_numpy(spark, vals, buckets, probs):
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    row = ranking.exact_quantiles(df, "v", probs, buckets=buckets).collect()[0]
    assert np.allclose(list(row), np.percentile(vals, [p * 100 for p in probs]), rtol=1e-12, atol=1e-12)
