"""Small tables and brute force."""

from itertools import combinations

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, row string, kept boolean"


def docs_of(spark, rows):
    """(doc_id, text[, lang[, source]]) with extra columns whose names operators use themselves."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or ""), 0.5, "x", True) for r in rows]
    return spark.createDataFrame(full, DOCS)


def smallest(nodes, links):
    """By node, the smallest node that it can reach."""
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_sets(sets, percent):
    return [(a, b) for a, b in combinations(sorted(sets), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
