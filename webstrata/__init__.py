"""Analytics over web-capture corpora, as DataFrame, SQL and Structured Streaming operators."""
