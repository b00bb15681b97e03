"""All telemetry queries by name, and their SQL equivalents."""

from __future__ import annotations

from wayline.plans import arrays, basics, combined, full, more, pairs, records, reports, robots, studies, vision

_ALL = {**basics.Q, **robots.Q, **vision.Q, **studies.Q, **more.Q, **arrays.Q, **records.Q, **pairs.Q, **reports.Q, **combined.Q, **full.Q}
QUERIES = {name: f for name, (f, _) in _ALL.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in _ALL.items() if sql}
