"""Command line: run a step, verify a run, or write its charts' tables."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from . import __version__


def _arguments(argv: Sequence[str]) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="scenalyx")
    parser.add_argument("--version", action="version", version=__version__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("run", "verify", "assets"):
        c = commands.add_parser(name)
        c.add_argument("--input", required=True, help="folder of the source tables")
        c.add_argument("--folder", required=True, help="folder of the run's tables")
        c.add_argument("--config", help="YAML file of settings")
    commands.choices["run"].add_argument("--step", default="all")
    mode = commands.choices["run"].add_mutually_exclusive_group()
    mode.add_argument("--resume", action="store_true")
    mode.add_argument("--plan", action="store_true")
    commands.choices["verify"].add_argument("--scope", choices=("core", "full"), default="full")
    commands.choices["assets"].add_argument("--destination", help="folder of the charts' tables (the run's by default)")
    return parser.parse_args(argv)


def main(argv: Sequence[str] | None = None) -> int:
    """0 if all went well, 1 if a check failed, 2 for wrong arguments."""
    args = _arguments(sys.argv[1:] if argv is None else argv)
    from . import charts, steps, verification
    from .config import Settings
    from .runtime import session
    from .sources.sinks import OrderPrices

    settings = Settings.load(args.config) if args.config else Settings()
    run = steps.Run(session(), args.folder.rstrip("/"), OrderPrices(args.input.rstrip("/")), settings)
    if args.command == "run":
        try:
            steps.sequence(args.step)
        except ValueError as error:
            print(error, file=sys.stderr)
            return 2
        if args.plan:
            for stage, what, why in steps.plan(run, args.step):
                print(f"{stage:12} {what:8} {why}".rstrip())
        else:
            for stage in steps.execute(run, args.step, args.resume):
                print(f"ran {stage}")
        return 0
    if args.command == "assets":
        for path in charts.write(run, (args.destination or args.folder).rstrip("/")):
            print(path)
        return 0
    rows = verification.verify(run, args.scope).collect()
    for r in rows:
        print(f"{'ok  ' if r['passed'] else 'FAIL'} {r['check_name']} {r['detail']}")
    return 0 if all(r["passed"] for r in rows) else 1
