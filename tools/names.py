"""Print the query names of one catalogue module, comma separated."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tickloom.catalog import QUERIES  # noqa: E402

print(",".join(n for n, f in QUERIES.items() if f.__module__.endswith(sys.argv[1])))
