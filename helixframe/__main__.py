"""Command line: ``python -m helixframe qc reads.fastq``."""

from __future__ import annotations

import argparse
import sys

from . import __version__, api
from .plans.config import DEFAULT_STAGES, PipelineConfig
from .plans.report import to_json, to_ndjson, to_text

_STAGES = {"qc": list(DEFAULT_STAGES), "fastq-stats": list(DEFAULT_STAGES), "entropy": ["entropy"], "n50": ["n50", "nx_statistics"], "adapter-detect": ["adapter_detect"]}
COMMANDS = (*_STAGES, "bamstats", "pipeline", "run")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="helixframe")
    p.add_argument("--version", action="version", version=__version__)
    sub = p.add_subparsers(dest="command", required=True)
    for name in COMMANDS:
        c = sub.add_parser(name)
        if name in ("pipeline", "run"):
            c.add_argument("config")
        c.add_argument("input")
        c.add_argument("--threads", type=int, default=8)
        c.add_argument("--max-memory", type=int, metavar="MB", help="heap of a session that this command starts")
        c.add_argument("--mode", choices=("exact", "fast", "approx"), default="exact")
        c.add_argument("--fast", action="store_true", help="the same as --mode fast")
        c.add_argument("--gzip-backend", dest="gzip_mode", default="auto")
        c.add_argument("--reference-length", type=int, default=0)
        form = c.add_mutually_exclusive_group()
        for kind in ("json", "ndjson", "text"):
            form.add_argument(f"--{kind}", dest="form", action="store_const", const=kind, default="json")
        c.add_argument("--quiet", action="store_true")
        c.add_argument("--perf", action="store_true", help="elapsed seconds and reads a second on standard error")
    return p


def main(argv: list[str] | None = None) -> int:
    args = list(sys.argv[1:] if argv is None else argv)
    if args and args[0] not in COMMANDS and not args[0].startswith("-"):
        args.insert(0, "qc")  # a bare path
    a = parser().parse_args(args)
    if a.max_memory:
        api.session(a.threads, a.max_memory)
    if a.command == "bamstats":
        work = (api.bamstats, a.input, a.reference_length, a.threads)
    elif a.command in ("pipeline", "run"):
        work = (api.pipeline, a.config, a.input)
    else:
        mode = "fast" if a.fast else a.mode
        config = PipelineConfig(pipeline=_STAGES[a.command], mode=mode, threads=a.threads, gzip_mode=a.gzip_mode)
        work = (api.pipeline, config, a.input)
    report, metrics = api.timed(*work)
    if not a.quiet:
        print({"json": to_json, "ndjson": to_ndjson, "text": to_text}[a.form](report).rstrip("\n"))
    if a.perf:
        print(f"{metrics['elapsed_s']:.3f} s, {metrics['reads_per_s']:.0f} reads/s", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
