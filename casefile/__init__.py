"""Analytics over large collections of text and media evidence, as Spark DataFrame operators."""
