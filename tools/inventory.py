"""Print the registered queries as a markdown table (README inventory)."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from riskspark.plans import catalog  # noqa: E402


def main():
    q, o = catalog.load()
    print("| Query key | Operator (module.function) | Check |")
    print("|---|---|---|")
    for name in sorted(q, key=lambda n: (int("".join(ch for ch in n.split("_")[0][1:] if ch.isdigit()) or 0), n)):
        fn = q[name]
        mod = fn.__module__.rsplit(".", 1)[-1]
        doc = (fn.__doc__ or "").strip().split("\n")[0]
        print(f"| `{name}` | {mod}.{fn.__name__}{' — ' + doc if doc else ''} | {'SQL' if name in o else 'PROP'} |")
    print(f"\n{len(q)} queries, {len(o)} with a DuckDB twin.")


if __name__ == "__main__":
    main()
