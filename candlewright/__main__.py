"""Command line: list and run queries, back-test, sweep, compare."""

from __future__ import annotations

import argparse
import json

from pyspark.sql.functions import avg

from candlewright import catalog
from candlewright.operators import book, regime, simulate, sweep
from candlewright.operators.strategies import GRIDS, STRATEGIES
from candlewright.session import get_session
from candlewright.sources.bars import densify, event_bars, order_bars


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser("candlewright")
    sub = p.add_subparsers(dest="do", required=True)
    sub.add_parser("list")
    q = sub.add_parser("query")
    q.add_argument("name", choices=sorted(catalog.queries()))
    q.add_argument("data")
    for name in ("backtest", "sweep"):
        s = sub.add_parser(name)
        s.add_argument("strategy", choices=sorted(STRATEGIES))
        s.add_argument("data")
        s.add_argument("--params", type=json.loads, default={})
        s.add_argument("--bars", choices=("events", "orders"), default="events")
        s.add_argument("--metric", default="sharpe")
    c = sub.add_parser("compare")
    c.add_argument("results")
    c.add_argument("--contains", default="")
    c.add_argument("--by", default="sharpe")
    c.add_argument("-k", type=int, default=10)
    r = sub.add_parser("report")
    r.add_argument("results")
    r.add_argument("--by", default="sharpe")
    r.add_argument("--top", type=int, default=20)
    f = sub.add_parser("walkforward")
    f.add_argument("strategy", choices=sorted(STRATEGIES))
    f.add_argument("data")
    f.add_argument("--space", type=json.loads, default=None)
    f.add_argument("--bars", choices=("events", "orders"), default="events")
    f.add_argument("--folds", type=int, default=4)
    f.add_argument("--ratio", type=float, default=0.6)
    f.add_argument("--metric", default="sharpe")
    g = sub.add_parser("regime")
    g.add_argument("data")
    g.add_argument("--bars", choices=("events", "orders"), default="orders")
    a = p.parse_args(argv)
    if a.do == "list":
        print("\n".join(sorted(catalog.queries())))
        return
    spark = get_session()
    if a.do == "query":
        catalog.queries()[a.name](spark, a.data).show(50, False)
    elif a.do == "compare":
        # broken files are skipped
        book.compare(spark.read.option("mode", "DROPMALFORMED").json(a.results), a.contains, a.by, a.k).show(a.k, False)
    elif a.do == "report":
        print(book.report_markdown(spark.read.option("mode", "DROPMALFORMED").json(a.results), a.by, a.top))
    elif a.do == "walkforward":
        panel = densify((event_bars if a.bars == "events" else order_bars)(spark, a.data))
        folds, oos = sweep.walk_forward(panel, a.space or GRIDS[a.strategy], a.folds, a.ratio, metric=a.metric, strategy=a.strategy)
        folds.join(sweep.oos_significance(oos), "fold_id", "left").orderBy("fold_id").show(a.folds, False)
        sweep.degradation(folds).show(1, False)
        sweep.oos_inference(oos).show(1, False, True)
    elif a.do == "regime":
        panel = densify((event_bars if a.bars == "events" else order_bars)(spark, a.data))
        regime.causal_labels(panel.groupBy("date").agg(avg("close").alias("close")), 3, 21, 756).orderBy("date").show(400, False)
    else:
        panel = densify((event_bars if a.bars == "events" else order_bars)(spark, a.data))
        if a.do == "sweep":
            sweep.sweep(panel, a.strategy, a.params or None, metric=a.metric).orderBy("rank").show(50, False)
        else:
            sig = sweep.grid_signals(panel, a.strategy, [a.params])
            eq = simulate.simulate(sig)
            simulate.metrics(eq).join(simulate.trade_metrics(simulate.simulate(sig, what="trades")), "run_id", "left").show(1, False, True)


if __name__ == "__main__":
    main()
