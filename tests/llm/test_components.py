import random

from palimpsest.llm import components
from palimpsest.llm.simhash import near_fingerprints


def test_buckets_are_joined_once_a_pass(spark, monkeypatch):
    """Large groups of near copies are not sought a second time among what pivots leave open."""
    rng = random.Random(3)
    texts = [rng.getrandbits(62) for _ in range(12)]
    nodes = sorted({t ^ (1 << rng.randrange(62)) ^ (1 << rng.randrange(62)) for t in texts for _ in range(15)})
    written = []
    cut = components.cut_lineage
    monkeypatch.setattr(components, "cut_lineage", lambda df, name, **how: written.append(name) or cut(df, name, **how))
    found = {r.node: r.component for r in near_fingerprints(spark.createDataFrame([(n,) for n in nodes], "node long")).collect()}
    assert "unsettled" not in written and written.count("buckets") == 2

    label = {n: n for n in nodes}
    for a in nodes:
        for b in nodes:
            if (a ^ b).bit_count() <= 4 and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = {n: low if c == high else c for n, c in label.items()}
    assert {n: found.get(n, n) for n in nodes} == label


def test_degrees_given_are_not_joined_for(spark, monkeypatch):
    """Rows that bring their degree are joined to nothing for it, and the first pivot is the one of most members."""
    rows = [(b, n, n, 5 if n == 7 else 1) for b in (1, 2) for n in range(5 * b, 5 * b + 5)]
    given = spark.createDataFrame(rows, "bucket long, node long, label long, degree long")
    counted = {r["node"]: r["degree"] for r in components.bucket_degrees(given).collect()}
    assert counted == {n: 5 for _, n, *_ in rows}
    monkeypatch.setattr(components, "bucket_degrees", None)
    held = []

    def verify(candidates):
        held.extend(candidates.collect())
        return candidates

    stars, _ = components.pivot_links(given, verify, 1)
    assert {(r["bucket"], r["a"]) for r in held} == {(1, 7), (2, 10)} and len(held) == 8
    assert {(r["a"], r["b"]) for r in stars.collect() if r["a"] != r["b"]} == {(n, 5 * b) for b, n, *_ in rows if n != 5 * b}
