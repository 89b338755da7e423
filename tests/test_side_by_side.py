from pyspark.sql import functions as F

from kinetrail.catalog.base import KEY, reps, samples
from kinetrail.operators import fit, whatif
from kinetrail.plans.blocks import BLOCK, settle

SF = "/root/testdata/sf0.001"
AXES = {"bias_x": (-0.02, 0.02)}
TERMS = {"bias": ("bias_x", 0.01, 0.0), "tilt": (0.0, "bias_x", 0.0), "lever": ("bias_x", 0.0, 0.02)}


def test_side_by_side_equals_a_copy_each(spark):
    """A sample is one row under all candidates, and their moments are those of rebuild, candidate by candidate."""
    s = settle(samples(spark, SF).filter("capture_id < 4").withColumn(fit.REFEREE, F.col("t") * 0.1))
    grid, each = whatif.parameter_grid(spark, AXES), [*KEY, "param_id"]
    spans = reps(spark, SF).drop("n", BLOCK)
    own = whatif.grid_candidates(AXES, TERMS)
    paths = whatif.rebuild_each(s, KEY, own, [fit.REFEREE])
    assert paths.count() == s.count()
    new = fit.each_moments(paths, spans, KEY, len(own))
    old = fit.rep_moments(whatif.rebuild(whatif.with_params(s, grid), each, TERMS),
                          whatif.with_params(spans, grid.select("param_id")), each)
    a, b = ({(r.capture_id, r.param_id, r.rep): r.asDict() for r in x.collect()} for x in (old, new))
    assert len(a) >= 8 and a.keys() == b.keys()
    for k, row in a.items():
        for c, v in row.items():
            assert v == b[k][c] or abs(v - b[k][c]) <= 1e-9 * max(1.0, abs(v)), (k, c, v, b[k][c])
