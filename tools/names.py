"""Print the names of the queries of some groups: ``python tools/names.py charts analyses``."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tabulary.plans import load  # noqa: E402

wanted = {f"tabulary.plans.{group}" for group in sys.argv[1:]}
print(" ".join(n for n, build in load().QUERIES.items() if build.__module__ in wanted))
