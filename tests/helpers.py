def rows(df):
    """A DataFrame's rows in an order of their own."""
    return sorted((tuple(r) for r in df.collect()), key=repr)
