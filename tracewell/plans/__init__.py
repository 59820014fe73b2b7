"""Every query of the library over the test tables, and its DuckDB SQL."""

from tracewell.plans import arrays, curation, evaluation, files, scans, statistics, telemetry, texts

_MODULES = (evaluation, statistics, curation, texts, arrays, telemetry, files, scans)


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
