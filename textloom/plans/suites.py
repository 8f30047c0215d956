"""Imports the modules that register queries."""


def load() -> None:
    from textloom.plans import custom_suite, domain_suite, edge_suite, rule_suite, scale_suite, search_suite, source_suite, sql_suite  # noqa: F401
