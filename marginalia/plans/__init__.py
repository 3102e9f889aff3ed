"""Named queries; importing this package registers all of them."""

from marginalia.plans import data_queries, link_queries, operator_queries, span_queries, table_queries, text_queries

__all__ = ["data_queries", "link_queries", "operator_queries", "span_queries", "table_queries", "text_queries"]
