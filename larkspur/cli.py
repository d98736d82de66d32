"""Command line: check settings, list strategies, score stored pools."""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence
from pathlib import Path

from larkspur import config
from larkspur.operators.scoring import default_registry


def validate(args: argparse.Namespace) -> int:
    settings = config.load(args.config)
    print(json.dumps({"name": settings.name, "fingerprint": settings.fingerprint(), "strategies": list(settings.acquisition.strategies)}))
    if args.manifest:
        Path(args.manifest).write_text(json.dumps(settings.manifest(), indent=2, sort_keys=True) + "\n", encoding="utf-8")
    return 0


def strategies(args: argparse.Namespace) -> int:
    registry = default_registry()
    for name in registry.qualified_names():
        print(name, dict(registry.resolve(name).weights) or "random")
    return 0


def diagnose(args: argparse.Namespace) -> int:
    """Images chosen by each strategy and seed from Parquet pools, and their stability over seeds, as Parquet."""
    from larkspur.plans.diagnose import diagnose_pool
    from larkspur.session import local_session

    spark = local_session()
    c, r = spark.read.parquet(args.candidates), spark.read.parquet(args.references)
    diagnose_pool(c, r, args.output, strategies=args.strategies, budget=args.budget, seeds=args.seeds, label=args.label)
    print(args.output)
    return 0


def main(argv: Sequence[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="larkspur")
    commands = parser.add_subparsers(required=True)
    one = commands.add_parser("validate", help="check a settings file")
    one.add_argument("--config", required=True)
    one.add_argument("--manifest", help="write the resolved settings here")
    one.set_defaults(run=validate)
    commands.add_parser("strategies", help="list the strategies").set_defaults(run=strategies)
    pool = commands.add_parser("diagnose", help="compare strategies on stored proposals")
    for name in ("candidates", "references", "output"):
        pool.add_argument(f"--{name}", required=True)
    pool.add_argument("--strategies", nargs="+", default=["v2:full", "v2:full_no_coherence", "v2:uncertainty"])
    pool.add_argument("--budget", type=int, default=10)
    pool.add_argument("--seeds", type=int, nargs="+", default=[0, 1, 2])
    pool.add_argument("--label", help="a column with labels; k-means without one")
    pool.set_defaults(run=diagnose)
    args = parser.parse_args(argv)
    return args.run(args)


if __name__ == "__main__":
    raise SystemExit(main())
