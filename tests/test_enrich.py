from __future__ import annotations

import random
import re

from atlasweave.operators import enrich


def letters(s):
    return None if s is None else re.sub("[^a-z0-9]", "", s.lower())


def brute(names, registry, fix):
    out = {}
    for name in names:
        n, found = letters(name), None
        if name is not None:
            ranked = sorted((o, e) for e, o in registry)
            found = next((e for _, e in ranked if e == name), None)
            if found is None and (n or not fix):
                found = next((e for _, e in ranked if letters(e) in n or n in letters(e)), None)
        out[name] = found
    return out


def test_fuzzy_names_against_plain_loops(spark):
    rng = random.Random(3)
    words = ["Boston", "New York", "Los Angeles", "Canada", "the West", "West", "Alaska", "A", "Sitka and Alaska", "Mid-America", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaab"]
    make = lambda: rng.choice(["Diocese of ", "Archdiocese of ", "", "Holy Metropolis of "]) + rng.choice(words) + rng.choice(["", " (OCA)", ", USA"])
    names = [make() for _ in range(300)] + [None, "", "Епархия", "!?", "a", "io", "x" * 70, "Diocese"]
    for extra in ([], [("Митрополия", -5)], [("", 7)]):
        registry = [(e, k) for k, e in enumerate(dict.fromkeys(make() for _ in range(40)))] + extra
        df = spark.createDataFrame([(x,) for x in names], "name string")
        reg = spark.createDataFrame(registry, "entry string, ord int")
        for fix in (False, True):
            rows = enrich.fuzzy_names(df, reg, fix=fix).collect()
            assert len(rows) == len(set(names)) and {r.name: r.match for r in rows} == brute(set(names), registry, fix)
    assert {r.match for r in enrich.fuzzy_names(df, reg.limit(0)).collect()} == {None}
    assert enrich.fuzzy_names(df.limit(0), reg).count() == 0


def test_common_beginnings_bring_no_strings_together(spark):
    entries = spark.range(3000).selectExpr("concat('dioceseof', lpad(cast(id AS string), 6, '0')) AS needle")
    hays = spark.range(3000).selectExpr("concat('holydioceseof', lpad(cast(id + 1500 AS string), 6, '0'), 'usa') AS hay")
    assert enrich.contained(entries, hays).count() == 1500
    assert enrich.containment_candidates(entries, hays).count() < 3000  # of 9 million
