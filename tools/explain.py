"""Print the physical plan of registered queries (``explain("formatted")``).

    python tools/explain.py [sf_dir] name [name ...]
"""

from __future__ import annotations

import sys

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])

from corpusprep.plans.catalog import REGISTRY  # noqa: E402
from corpusprep.session import get_spark  # noqa: E402


def main(argv):
    sf = argv[0] if argv and argv[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv if not a.startswith("/")] or list(REGISTRY)
    spark = get_spark()
    for name in names:
        print(f"===== {name}")
        REGISTRY[name](spark, sf).explain("formatted")


if __name__ == "__main__":
    main(sys.argv[1:])
