"""Command line: ``python -m quillmill export | info | index | review``."""

from __future__ import annotations

import argparse
import os
import sys
from dataclasses import replace

from .session import build_session
from .sources.config import as_list, load_file, merged
from .sources.files import find_root
from .sources.remotes import repo_name


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillmill")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("export", "info", "index", "review"):
        c = sub.add_parser(name)
        c.add_argument("path", nargs="?", default=".")
        c.add_argument("--config")
        if name in ("export", "index"):
            c.add_argument("--include-extensions", type=as_list)
            c.add_argument("--exclude-globs", type=as_list)
            for n in ("max-file-bytes", "max-total-bytes", "max-tokens", "chunk-tokens", "chunk-overlap", "min-chunk-tokens", "tree-depth"):
                c.add_argument("--" + n, type=int)
            c.add_argument("--redaction-mode", choices=("fast", "standard", "paranoid", "structure-safe"))
            c.add_argument("--follow-symlinks", action="store_true", default=None)
            c.add_argument("--include-minified", action="store_true", default=None)
            c.add_argument("--no-ignore-files", dest="use_ignore_files", action="store_false", default=None)
        if name == "export":
            c.add_argument("--output-dir", default="out")
            c.add_argument("--task")
        if name == "index":
            c.add_argument("--index-dir")
        if name == "review":
            c.add_argument("--base", default="HEAD")
            c.add_argument("--head")
            c.add_argument("--format", choices=("text", "json"), default="text")
            c.add_argument("--output")
            c.add_argument("--no-redact", action="store_true")
            c.add_argument("--max-related-files", type=int, default=128)
    return p


def index_location(root: str) -> str:
    """Where the index of a root lies unless another place is named: the user's cache folder, by the root's fingerprint."""
    import hashlib

    cache = os.environ.get("XDG_CACHE_HOME") or os.path.expanduser("~/.cache")
    return os.path.join(cache, "quillmill", hashlib.sha256(os.path.realpath(root).encode()).hexdigest()[:16])


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if not os.path.isdir(args.path):
        print(f"no such folder: {args.path}", file=sys.stderr)
        return 2
    from .plans import export as plans

    spark = build_session()
    root = find_root(args.path) if args.command in ("index", "review") else args.path
    config = merged({k: v for k, v in vars(args).items() if v is not None}, load_file(args.config, root))
    if args.command == "info":
        print(plans.report_text(plans.info(spark, root)), end="")
    elif args.command == "export":
        name = repo_name(os.path.realpath(root))
        out = os.path.join(args.output_dir, name)
        report = plans.export(spark, root, out, config, args.task, name)
        print(f"{out}: {report['stats']['files']} files, {report['stats']['chunks']} chunks, {report['stats']['tokens']} tokens")
    elif args.command == "index":
        where = args.index_dir or index_location(root)
        counts = plans.build_index(spark, root, where, replace(config, max_tokens=None))
        print(f"{where}: " + ", ".join(f"{n} {k}" for k, n in counts.items()))
    else:
        from .plans.review import impact_json, impact_text, review

        report = review(spark, root, args.base, args.head, args.max_related_files, not args.no_redact)
        text = impact_json(report) if args.format == "json" else impact_text(report)
        if args.output:
            from .operators.render import write_atomic

            write_atomic(args.output, text)
        else:
            print(text, end="")
    return 0


if __name__ == "__main__":
    sys.exit(main())
