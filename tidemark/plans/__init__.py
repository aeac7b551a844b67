"""Report plans: ``report(repo, begin, end) -> DataFrame`` over a snapshot pair."""
