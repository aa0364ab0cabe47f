"""Property: on noise-free series the relational fit recovers A, tau and offset, wherever they lie in the box."""
import datetime as dt

import numpy as np
from hypothesis import HealthCheck, given, settings, strategies as st

from soilcast.operators import decay
from soilcast.schema import READINGS


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(a=st.floats(0.2, 1.5), tau=st.floats(15.0, 400.0), offset=st.floats(0.0, 0.4),
       n=st.integers(12, 60), step=st.sampled_from([1.0, 2.0, 6.0]))
def test_fit_recovers_parameters(spark, a, tau, offset, n, step):
    t0 = dt.datetime(2025, 1, 1)
    rows = [(i, "p", t0 + dt.timedelta(hours=step * i), 20.0, 50.0, float(a * np.exp(-step * i / tau) + offset), None)
            for i in range(n)]
    f = decay.decay_fit(spark.createDataFrame(rows, READINGS)).collect()[0]
    span = step * (n - 1)
    # the curve itself must be reproduced to within the grid resolution
    tt = np.arange(n) * step
    got = f.A * np.exp(-tt / f.tau) + f.offset
    want = a * np.exp(-tt / tau) + offset
    assert np.max(np.abs(got - want)) < 1e-4, (f, a, tau, offset)
    if span / tau > 0.3:          # the decay is visible in the window: parameters are identified
        assert abs(f.tau - tau) / tau < 0.02 and abs(f.A - a) < 0.02 and abs(f.offset - offset) < 0.02
    assert f.r_squared > 0.999 and f.confidence == 0.95
