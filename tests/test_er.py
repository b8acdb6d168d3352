from __future__ import annotations

import random

from pyspark.sql import functions as F

from atlasweave.functions.values import SOURCE_PRIORITY
from atlasweave.operators import er

COLUMNS = ["ord", "source", *er.FIELDS]


def merged(rows):
    """One group by the rule: in order of trust, a field takes the trimmed value of a more trusted source, or a longer one of an equal; sources each once."""
    out, trust = dict.fromkeys(er.FIELDS, ""), dict.fromkeys(er.FIELDS, -1)
    for r in sorted(rows, key=lambda r: (SOURCE_PRIORITY.get(r["source"], 0), r["ord"])):
        for f in er.FIELDS:
            value, mine = (r[f] or "").strip(), SOURCE_PRIORITY.get(r["source"], 0)
            if value and (not out[f] or mine > trust[f] or len(value) > len(out[f])):
                out[f], trust[f] = value, mine
    sources = []
    for r in sorted(rows, key=lambda r: r["ord"]):
        sources += [s for s in ((r["source"] or "").split(",")) if s.strip() and s.strip() not in [x.strip() for x in sources]]
    return out | {"source": ", ".join(s.strip() for s in sources)}


def test_winner_rule_against_brute_force(spark):
    rng = random.Random(4)
    rows = [{"ord": k, "source": rng.choice([*SOURCE_PRIORITY, "other", None, "", " ", "oca ,acrod"])} | {f: rng.choice(["", " ", None, "a", " bb\u00a0", "ccc", "dd", "  St. A  "]) for f in er.FIELDS} | {"g": rng.randrange(80)} for k in range(800)]
    df = spark.createDataFrame([(*[r[c] for c in COLUMNS], r["g"]) for r in rows], ", ".join(f"{c} {'long' if c == 'ord' else 'string'}" for c in COLUMNS) + ", g long")
    got = {r.g: r.asDict() for r in er.merge_groups(df, ["g"], er.FIELDS).collect()}
    for g in got:
        want = merged([r for r in rows if r["g"] == g])
        assert {k: got[g][k] for k in want} == want


def test_passes(spark):
    names = ("name", "city", "state", "lat", "lng", "phone")
    data = [(0, "oca", "St. A", "X", "NY", "1.0", "2.0", "1"), (1, "goarch", "st a", "x", "", "", "", ""), (2, "oca", "B", "Y", "NY", "1.00001", "2.0", "22"), (3, "oca", "", "Z", "NY", "", "", ""), (4, "oca", "C", "Q", "NY", "0", "5", "")]
    df = spark.createDataFrame(data, "ord long, source string, name string, city string, state string, lat string, lng string, phone string")
    df = df.select("*", *[F.lit("").alias(c) for c in er.FIELDS if c not in names])
    assert er.by_name(df).count() == 3
    out = er.resolve(df).collect()
    assert sorted(r.name for r in out) == ["B", "C"]  # a list of sources has no priority in the second pass
    assert er.stats(df).first().asDict() == {"total": 5, "unique_rows": 2, "merged": 2}
    assert er.first_wins(df, [F.lower("city")]).count() == 4
    assert er.resolve(df.limit(0)).count() == 0
