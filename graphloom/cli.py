"""Command line: ``python -m graphloom.cli -m mapping``."""

from __future__ import annotations

import argparse
import logging
import os
import sys
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException

from .api import run, translate
from .errors import MappingError
from .options import Options


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="graphloom", description="Turns tables into RDF by a plan or a mapping.")
    p.add_argument("-m", "--mapping-file", required=True, help="a JSON plan, or a mapping if -l is given")
    p.add_argument("-l", "--mapping-lang", choices=["rml", "shexml"], help="the mapping's language")
    p.add_argument("-v", "--verbose", action="count", default=0, help="more logging; repeat for still more")
    p.add_argument("-q", "--quiet", action="store_true", help="no logging")
    p.add_argument("--force-std-out", action="store_true", help="write to standard output, whatever the plan says and --force-to-file too")
    p.add_argument("--force-to-file", metavar="FILE", help="write all to one file; a path ending in / is a directory of parts")
    p.add_argument("--message-buffer-capacity", type=int, default=128, help="accepted for compatibility; has no effect")
    p.add_argument("-d", "--deduplicate", action="store_true", help="drop repeated statements")
    p.add_argument("--dedup-scope", choices=["statement", "record"], default="statement")
    p.add_argument("--on-invalid-iri", choices=["keep", "drop", "fail"], default="keep")
    p.add_argument("--typed-literals", action="store_true", help="write datatypes and language tags")
    return p


def main(argv: Sequence[str] | None = None) -> int:
    args = parser().parse_args(argv)
    level = logging.CRITICAL if args.quiet else max(logging.DEBUG, logging.WARNING - 10 * args.verbose)
    logging.basicConfig(level=level)
    options = Options(
        force_to_std_out=args.force_std_out, force_to_file=args.force_to_file, working_dir_hint=os.path.dirname(os.path.abspath(args.mapping_file)),
        message_buffer_capacity=args.message_buffer_capacity, deduplicate=args.deduplicate, dedup_scope=args.dedup_scope,
        on_invalid_iri=args.on_invalid_iri, typed_literals=args.typed_literals,
    )
    try:
        with open(args.mapping_file, encoding="utf-8") as f:
            text = f.read()
        run(translate(text, args.mapping_lang) if args.mapping_lang else text, options)
    except (MappingError, PySparkException, Py4JJavaError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
