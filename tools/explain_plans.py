"""Print the formatted physical plans of the main data passes (PLANS.md)."""

from __future__ import annotations

import contextlib
import io
import sys

sys.path.insert(0, "/root/repo")

from pyspark.sql import functions as F  # noqa: E402

from cohortlab.operators import moments, quantiles, tree  # noqa: E402
from cohortlab.plans import model_queries as M  # noqa: E402
from cohortlab.plans import queries as Q  # noqa: E402
from cohortlab.plans.pipeline import pipeline  # noqa: E402
from cohortlab.session import get_session  # noqa: E402
from cohortlab.sources.fixtures import entity_view  # noqa: E402


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    text = buf.getvalue()
    tree_part, _, details = text.partition("\n\n(1)")
    scans = []
    for block in ("(1)" + details).split("\n\n"):
        if "Scan parquet" in block.split("\n")[0]:
            keep = [ln for ln in block.split("\n") if ln.startswith(("(", "PushedFilters", "ReadSchema"))]
            scans.append("\n".join(keep))
    return tree_part.strip() + ("\n\n" + "\n".join(scans) if scans else "")


def main(sf: str) -> None:
    spark = get_session()
    p = pipeline(spark, sf)
    sections = [
        ("Entity view: lineitem per-order aggregate ⟕ orders ⟕ (customer ⋈ broadcast nation)", entity_view(spark, sf)),
        ("Rate by department (partial + final hash aggregate over the clean table)", Q.q_rate_by(spark, sf)),
        ("Value histogram feeding exact quantiles", quantiles.value_histogram(p.clean, ["gross", "tenure"])),
        ("Per-fold Gram statistics (one aggregation for every linear model)",
         p.reg_data.groupBy("grp").agg(*[F.sum(F.col(a) * F.col(b)) for a, b in [("gross", "n_lines"), ("n_lines", "qty")]])),
        ("Tree leaf counts (the only row pass behind the depth curve)",
         tree.with_leaf(p.tree, p.tree_data).groupBy("is_test", "leaf", "target").count()),
        ("Master score frame (tree transform + lasso expression, a projection)", M.master(p)),
    ]
    out = ["# Physical plans (sf=%s, local mode)\n" % sf.rsplit("sf", 1)[-1]]
    for title, df in sections:
        out.append(f"## {title}\n\n```\n{plan(df)}\n```\n")
    print("\n".join(out))


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01")
