"""DataFrame operators: ``f(df, ..., params) -> DataFrame``, lazy unless stated."""
