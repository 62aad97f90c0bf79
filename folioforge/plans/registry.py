"""All queries of the page-archive operators: name to (function, SQL twin or None)."""

from folioforge.plans import catalogue, pages, reports, rules

ALL = {**pages.QUERIES, **rules.QUERIES, **reports.QUERIES, **catalogue.QUERIES}
