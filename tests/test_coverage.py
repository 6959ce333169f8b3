"""COVERAGE.md names registered queries and existing functions only."""

import importlib
import pkgutil
import re
from pathlib import Path

import millrace
from millrace.queries import QUERIES

ROWS = [line.strip("|").split("|") for line in (Path(__file__).parents[1] / "COVERAGE.md").read_text().splitlines() if line.startswith("| ") and not line.startswith("| Rows")]


def test_queries_exist():
    cited = {name for row in ROWS for name in re.findall(r"`([a-z0-9_]+)`", row[2])}
    functions = {"fetchable", "alternatives_within", "availableNow", "as_table"}
    assert len(cited) > 120 and cited - functions <= set(QUERIES)


def test_every_query_is_cited():
    cited = {name for row in ROWS for name in re.findall(r"`([a-z0-9_]+)`", row[2])}
    assert set(QUERIES) - cited == set()


def test_rows_are_all_there():
    numbers: set[int] = set()
    for row in ROWS:
        for part in re.findall(r"\d+(?:–\d+)?", row[0].split("  ")[0].split(" ")[1] if not row[0][1].isdigit() else re.match(r" ([\d–, ]+)", row[0])[1]):
            first, _, last = part.partition("–")
            numbers |= set(range(int(first), int(last or first) + 1))
    assert numbers == set(range(1, 330))


def test_functions_exist():
    modules = {m.name: importlib.import_module(m.name) for m in pkgutil.walk_packages(millrace.__path__, "millrace.") if ".llm" not in m.name}
    known = {name for module in modules.values() for name in vars(module)} | {m.rsplit(".", 1)[-1] for m in modules}
    known |= {name for module in modules.values() for value in vars(module).values() if isinstance(value, type) for name in vars(value)}
    cited = {name.rsplit(".", 1)[-1] for row in ROWS for name in re.findall(r"`([A-Za-z_.]+)`", row[1]) if "/" not in name}
    assert cited - known - {"py", "availableNow"} == set()
