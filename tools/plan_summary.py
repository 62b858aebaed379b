"""Summarise the physical plans of headline queries (``explain("formatted")``).

Usage: python tools/plan_summary.py [sf_dir] > PLANS.md
Counts shuffles, broadcasts, aggregate / window / Python nodes of the main
plan, lists each scan's read schema and pushed filters (main plan and
subqueries), and runs the query once to count the Spark jobs it takes.  Run with broadcast joins disabled (``--scale``) to see the
plan shape of large inputs.
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

NODES = ("Exchange", "BroadcastExchange", "SortMergeJoin", "BroadcastHashJoin", "HashAggregate", "SortAggregate",
         "ObjectHashAggregate", "Window", "MapInPandas", "FlatMapGroupsInPandas", "TakeOrderedAndProject")


def summarise(name: str, df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    plan = buf.getvalue()
    head = plan.split("\n\n")[0]
    counts = {n: len(re.findall(rf"[ +-]{n} \(", head)) for n in NODES}
    counts["Exchange"] -= counts["BroadcastExchange"]
    scans = []
    for block in plan.split("\n\n"):
        if "Scan parquet" in block and "ReadSchema" in block:
            rs = re.search(r"ReadSchema: (.*)", block)
            pf = re.search(r"PushedFilters: (.*)", block)
            scans.append(f"`{rs.group(1) if rs else '?'}`" + (f" pushed {pf.group(1)}" if pf else ""))
    # jobs actually run (subquery reuse is applied at execution, so count at runtime)
    sc = df.sparkSession.sparkContext
    group = f"plan-{abs(hash(name))}"
    sc.setJobGroup(group, name)
    df.write.mode("overwrite").format("noop").save()
    jobs = len(sc.statusTracker().getJobIdsForGroup(group))
    sc.setJobGroup("none", "none")
    shown = ", ".join(f"{k} {v}" for k, v in counts.items() if v)
    out = [f"### {name}", f"- main plan: {shown or 'no operators counted'}; Spark jobs when run: {jobs}"]
    out += [f"- scan {s}" for s in sorted(set(scans))[:8]]
    return "\n".join(out)


def main() -> None:
    args = [a for a in sys.argv[1:] if not a.startswith("--")]
    sf = args[0] if args else "/root/testdata/sf0.1"
    from churnwise.session import build_session
    from churnwise.operators import actions, features, histogram, orders, reports
    from churnwise.plans import batch
    from churnwise.sources.testdata import load_test_tables
    extra = {"spark.sql.autoBroadcastJoinThreshold": "-1"} if "--scale" in sys.argv else {}
    spark = build_session("local[8]", shuffle_partitions=8, extra=extra)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="plans-"))
    t = load_test_tables(spark, sf)
    kept = orders.keep_orders(orders.merge_orders(t))
    clean = batch.order_stage(t)
    feat = batch.feature_stage(clean)
    scored = batch.proxy_scores(feat, cut=True)
    items = [("merge + filters (kept orders stage)", kept),
             ("median fill + delay (clean orders)", clean),
             ("customer features (fused two-level aggregate)", features.customer_features(clean)),
             ("monetary percentile (distributed exact rank)", actions.add_monetary_percentile(feat)),
             ("churn histogram", histogram.histogram(scored, "churn_probability")),
             ("rfm box stats (grouped exact quantiles)", reports.rfm_box_stats(scored)),
             ("top 20 by predicted value", reports.top_clv(scored)),
             ("export customers (filtered, sorted)", reports.export_customers(scored, "churned", "champions"))]
    print(f"# Physical plan summary ({sf}{', broadcast joins off' if extra else ''})\n")
    for name, df in items:
        print(summarise(name, df) + "\n")
    spark.stop()


if __name__ == "__main__":
    main()
