"""python -m barloom --registry R --dataset ID --mode M --capture C --out A [--engine-commit SHA]: exit 0 done, 1 wrong usage, 2 refused, 3 unexpected failure."""

from __future__ import annotations

import argparse
import re
import sys


def main(argv: list[str] | None = None) -> int:
    from barloom.plans import Mode

    p = argparse.ArgumentParser(prog="barloom", exit_on_error=False)
    for name in ("registry", "dataset", "capture", "out"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--mode", required=True, choices=[m.value for m in Mode])
    p.add_argument("--engine-commit", default="")
    try:
        a = p.parse_args(argv)
        if a.engine_commit and not re.fullmatch(r"[0-9a-f]{40}", a.engine_commit):
            raise argparse.ArgumentError(None, "--engine-commit must be 40 hex digits")
    except (argparse.ArgumentError, SystemExit) as e:
        if isinstance(e, SystemExit) and e.code == 0:
            return 0
        print(f"argument error: {e}", file=sys.stderr)
        return 1
    from barloom.session import local_session
    from barloom.sinks.export import ExportError, export

    try:
        m = export(local_session(), a.registry, a.dataset, Mode(a.mode), a.capture, a.out, a.engine_commit)
        print(f"{m['row_count']} rows, {m['artifact_sha256']}")
        return 0
    except ExportError as e:
        print(f"export refused: {e}", file=sys.stderr)
        return 2
    except Exception as e:  # noqa: BLE001
        print(f"unexpected failure: {e}", file=sys.stderr)
        return 3


if __name__ == "__main__":
    sys.exit(main())
