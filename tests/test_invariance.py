import numpy as np
import pandas as pd

from cohortlab.operators import moments, sampling
from cohortlab.operators.quantiles import exact_modes, exact_quantiles


def test_results_do_not_depend_on_partitioning(spark):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"id": np.arange(3000), "x": np.round(rng.normal(size=3000), 2),
                        "y": rng.normal(size=3000), "s": rng.integers(0, 3, 3000), "c": rng.choice(list("abcd"), 3000)})
    base = spark.createDataFrame(pdf)
    outs = []
    for parts in (1, 16):
        df = base.repartition(parts)
        q = sorted((r["column"], r["prob"], r["value"]) for r in exact_quantiles(df, ["x", "y"], [0.1, 0.5, 0.9]).collect())
        m = sorted((r["column"], r["value"]) for r in exact_modes(df, ["c"]).collect())
        split = sorted(r["id"] for r in sampling.stratified_split(df, "id", "s", 0.3, 42).where("is_test").select("id").collect())
        g = moments.gram(df, ["x"], "y")[None]
        outs.append((q, m, split, round(g.sxx[0, 0], 6), round(g.sxy[0], 6)))
    assert outs[0] == outs[1]
