"""Command line: python -m assaykit.cli analyze|detect-leakage|select-features|report."""

from __future__ import annotations

import argparse
import json
import sys

from .columns import NUMERIC, columns_of, normalise_missing
from .operators import features, leakage
from .pipeline import Pipeline
from .session import session
from .sources.loader import load, plain


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="assaykit", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("analyze", "report", "select-features"):
        c = sub.add_parser(name)
        c.add_argument("data")
        c.add_argument("--target")
        c.add_argument("--output")
        c.add_argument("--format", choices=["json", "html", "text"], default="json" if name == "analyze" else "html")
    c = sub.add_parser("detect-leakage")
    c.add_argument("train")
    c.add_argument("test")
    c.add_argument("--entity")
    c.add_argument("--target")
    args = p.parse_args(argv)
    spark = session()
    if args.command == "detect-leakage":
        train, test = load(spark, args.train), load(spark, args.test)
        out = {"contamination": leakage.contamination(train, test).first()}
        if args.entity:
            out["groups"] = leakage.group_overlap(train, test, args.entity).first()
        found = leakage.detect_all(train, test, args.target, args.entity)
        out |= {"findings": [plain(r) for r in found.collect()], "severities": leakage.severity_counts(found).first()}
        print(json.dumps(plain(out)))
        return int(out["contamination"]["n_contaminated"] > 0)
    df = normalise_missing(load(spark, args.data))
    if args.command == "select-features":
        cols = columns_of(df, NUMERIC, but=(args.target,) if args.target else ())
        print(json.dumps([plain(r) for r in features.correlation_filter(df, cols).collect()]))
        return 0
    pipe = Pipeline()
    for m in ("completeness", "distribution", "outlier_detection", "leakage_detection", "advice"):
        pipe.add_step(m)
    result = pipe.run(df, args.target)
    if args.output:
        pipe.export(args.output, args.format)
    else:
        print(json.dumps(plain(result.summary())))
    return int(bool(result.errors))


if __name__ == "__main__":
    sys.exit(main())
