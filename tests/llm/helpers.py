from __future__ import annotations

import random

DOCS = "doc_id long, text string"


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=lambda r: [(v is None, v if v is not None else 0) for v in r])


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def with_clashes(df):
    """The same rows with further columns, of names that operators use themselves."""
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("x") for c in ("node", "root", "key", "spans", "size", "toxic", "_salt", "n", "row")
                           if c not in df.columns})


def roots(n_nodes, links):
    parent = {n: n for n in n_nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in parent}
