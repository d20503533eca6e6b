"""Queries over the driver's tables, each beside the SQL that must give the same rows."""


def groups() -> list:
    from workload import files, fixes, reports, retrieval, rows, schema

    return [rows, schema, reports, fixes, files, retrieval]
