import datetime as dt
import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from panelcast.operators import splits
from panelcast.operators.fitting import ModelSpec, fit
from panelcast.plans.common import prep
from panelcast.sources import io
from panelcast.streaming.scoring import score_stream
from tests.conftest import SF_SMALL


def test_stream_equals_batch(spark, tmp_path):
    d = prep(spark, SF_SMALL, ["y_prev", "x_qty", "y"])
    m = fit(ModelSpec("s", "ridge", ["y_prev", "x_qty"], {"alpha": 1.0}, degree=2), d)
    path = io.save_model(m.model, str(tmp_path / "m"))
    d.repartition(3).write.parquet(str(tmp_path / "in"))
    score_stream(spark, str(tmp_path / "in"), path, str(tmp_path / "out"), str(tmp_path / "chk"),
                 schema=d.schema, keep=["series", "day"]).awaitTermination()
    got = {(r.series, r.day): r.prediction for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.series, r.day): r.prediction for r in io.score_batch(d, path, keep=["series", "day"]).collect()}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in got) < 1e-12


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(n=st.integers(1, 60), k=st.integers(2, 7), seed=st.integers(0, 10 ** 6), parts=st.integers(1, 9))
def test_exact_folds_property(spark, n, k, seed, parts):
    rows = [(f"s{i % 3}", dt.date(2000, 1, 1) + dt.timedelta(days=i), i) for i in range(n)]
    df = spark.createDataFrame(rows, "series string, day date, y long").repartition(parts)
    f = splits.kfold(df, k, seed, "exact").collect()
    sizes = [sum(1 for r in f if r.fold == j) for j in range(k)]
    q, big = divmod(n, k)
    assert sizes == [q + 1 if j < big else q for j in range(k)]
    h = splits.holdout(df, 0.3, seed, "exact").where("is_test").count()
    assert h == math.ceil(0.3 * n)
