"""Command line: ``python -m graphfold GRAPH [--out DIR] [--results CSV] [--profile CSV] [--audit CSV] [--SETTING VALUE]...``

Settings are the fields of SummarizeConfig, with dashes. Prints one ``metric.key=value`` line per metric.
"""

from __future__ import annotations

import argparse
from dataclasses import fields

from graphfold.plans.engine import SummarizeConfig, summarize
from graphfold.sources import graphs, sinks


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="graphfold", description="Summarize one undirected graph given as an edge list.")
    p.add_argument("graph", help="text file of edges, any path that Spark reads")
    p.add_argument("--duplicates", choices=("raise", "drop"), default="raise")
    p.add_argument("--out", help="folder for G, P, Cp and Cm")
    p.add_argument("--form", choices=("text", "parquet"), default="text")
    for name in ("results", "profile", "audit"):
        p.add_argument(f"--{name}", help="CSV folder to append to")
    for f in fields(SummarizeConfig):
        kind = type(f.default)
        p.add_argument(f"--{f.name.replace('_', '-')}", default=f.default, **({"action": argparse.BooleanOptionalAction} if kind is bool else {"type": kind}))
    return p


def run(spark, argv: list[str]) -> dict:
    a = parser().parse_args(argv)
    cfg = SummarizeConfig(**{f.name: getattr(a, f.name) for f in fields(SummarizeConfig)})
    s, label = summarize(graphs.read_edge_list(spark, a.graph, a.duplicates), cfg), sinks.dataset_label(a.graph)
    if a.out:
        sinks.write_summary(s.encoding, a.out, a.form)
    if a.results:
        sinks.append_csv(s.result_frame(label, cfg), a.results)
    if a.profile and s.profile:
        sinks.append_csv(s.profile_frame(), a.profile)
    if a.audit and s.audit:
        sinks.append_csv(s.audit_frame(label, cfg.commit_policy), a.audit)
    for k, v in s.metrics.items():
        print(f"metric.{k}={v}")
    return s.metrics


def main() -> None:
    from pyspark.sql import SparkSession

    run(SparkSession.builder.appName("graphfold").getOrCreate(), None)


if __name__ == "__main__":
    main()
