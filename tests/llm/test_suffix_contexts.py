"""Only anchors beside equal bytes are fetched for the suffix sort."""

import random

from marginalia.llm import substrings


def test_short_repeats_fetch_no_bytes(spark):
    rng = random.Random(5)
    noise = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    shared = [noise(30) for _ in range(20)]  # too short for a string of 50 bytes, and for a side of an anchor
    long = noise(80)
    rows = [(i, "".join(noise(60) + s for s in shared) + noise(60) + (long if i in (3, 7) else "") + noise(60)) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    marked = substrings._marked(docs).select("_doc", "_part", "_data")
    found = substrings._met(substrings._anchored(marked, 8), 8).where("kind = 2").collect()
    assert {r.doc for r in found} <= {3, 7}  # every document holds anchors in the short pieces
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in substrings.remove_repeats(docs).collect()}
    assert got == {i: ((80, 1) if i == 7 else (0, 0)) for i in range(12)}
