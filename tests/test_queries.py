"""Every registered query with SQL gives the same rows in DuckDB."""

import pytest
from compare import oracle, spark_rows

from parley import plans

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_sql_gives_the_same_rows(spark, name):
    names, got = spark_rows(plans.QUERIES[name](spark, SF))
    want_names, want = oracle(SF, plans.SQL[name])
    assert names == want_names
    assert got == want


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_other_queries_run(spark, name):
    assert plans.QUERIES[name](spark, SF).count() > 0


def test_cer_against_python(spark):
    said = {(r.conv_id, r.turn): r.text for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        return row[-1]

    got = plans.QUERIES["cer"](spark, SF).orderBy("conv_id", "turn").limit(12).collect()
    for r in got:
        a, b = said[r.conv_id, r.turn], said[r.conv_id, r.turn + 1]
        assert r.cer == pytest.approx(distance(a, b) / len(a))
    words = {(r.conv_id, r.turn): r.wer for r in plans.QUERIES["wer"](spark, SF).collect()}
    for (c, t), wer in list(words.items())[:12]:
        a, b = said[c, t].split(), said[c, t + 1].split()
        assert wer == pytest.approx(distance(a, b) / len(a))


def test_lexical_hits_against_python(spark):
    import re

    from parley.functions import signals

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in plans.QUERIES["lexical_tactics"](spark, SF).collect():
        for k, patterns in signals.LEXICAL_TACTICS.items():
            assert r[k] == sum(len(re.findall(p, texts[r.doc_id], re.I)) for p in patterns)


def naive_entities(text):
    """Every rule on every text, without the guards before patterns; then the best of what is
    left, again and again."""
    from parley.functions import entities

    left = []
    for n, (kind, pattern, rule, sure, secret, _) in enumerate(entities.RULES):
        for m in pattern.finditer(text):
            made = rule(text, m)
            if made:
                left.append((entities.RANK[kind], sure, -m.start(), -n, kind, m.start(), m.start() + len(made[0]), secret))
    out = []
    while left:
        best = max(left, key=lambda e: e[:3])
        out.append(best[4:])
        left = [e for e in left if e is not best and not (e[5] < best[6] and best[5] < e[6])]
    return sorted(out, key=lambda e: e[1])


ODD_TEXTS = [
    "Pay ₹ 5,000 or Rs.200 to asha@okaxis, then asha@okaxis.example.com; OTP 1234, PIN: 99 88 77", "CASE NO: ABC-12345 ſBI İncome TAX reserve bank of india",
    "aadhaar 1234 5678 9012 account 123456789012 call +91 98765 43210 or 9876543210 www.x.in/a?b=1). https://[bad", "१२३४ ओटीपी ४५६७ पुलिस खाता 123456789 भुगतान", "", "no hint",
    "CYBER\u212aCELL cyber  crime PHONE PE phonepe G PAY google pay inr 50 50 rupees", "fir 12345 reference # XY/77-1 complaint12345",
]


def test_entities_against_brute_force(spark):
    from parley.functions import entities

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {(r.doc_id, r.entity_type, r.start, r.end, r.sensitive) for r in plans.QUERIES["entity_spans"](spark, SF).collect()}
    assert got == {(i, *e) for i, t in texts.items() for e in naive_entities(t)} and got
    for t in ODD_TEXTS:
        assert [(e.entity_type, e.start, e.end, e.sensitive) for e in entities.entities_of(t)] == naive_entities(t)
    counts = {}
    for _, kind, *_ in got:
        counts[kind] = counts.get(kind, 0) + 1
    assert {r.entity_type: r.n for r in plans.QUERIES["entity_counts"](spark, SF).collect()} == counts


def test_risk_features_against_python(spark):
    import hashlib
    import math
    import re
    import unicodedata

    from parley.functions import signals

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    steps = [["authority_impersonation"], ["accusation"], ["fear_threat", "urgency"], ["isolation", "secrecy", "surveillance_control"], ["financial_demand", "credential_otp_request"]]
    rows = plans.QUERIES["risk_features"](spark, SF).collect()
    assert len(rows) == len(texts) and len(rows[0]) == 31
    for r in rows:
        t = texts[r.doc_id]
        solid = "".join(t.split())
        letters = [c for c in solid if unicodedata.category(c).startswith("L")]
        ents = naive_entities(t)
        hits = {k: sum(len(re.findall(p, t, re.I)) for p in ps) for k, ps in signals.LEXICAL_TACTICS.items()}
        want = {
            "base_score": int(hashlib.sha256(f"17|{r.doc_id}".encode()).hexdigest()[:8], 16) / 2**32, "log_lines": math.log1p(t.count("\n") + bool(solid)), "log_tokens": math.log1p(len(t.split())),
            "log_chars": math.log1p(len(t)), "digit_share": sum(c.isdecimal() for c in solid) / max(1, len(solid)), "capital_share": sum(c.isupper() for c in letters) / max(1, len(letters)),
            "entity_share": min(10, len(ents)) / 10, "sensitive_share": min(10, sum(e[3] for e in ents)) / 10, "tactic_coverage": sum(v > 0 for v in hits.values()) / 9,
            "stage_progress": max([0.0, *((i + 1) / 6 for i, names in enumerate(steps) if any(hits[n] for n in names))]),
            **{f"tactic_{k}": min(5, v) / 5 for k, v in hits.items()}, **{c: min(3, sum(e[0] == c.removeprefix("entity_") for e in ents)) / 3 for c in r.asDict() if c.startswith("entity_") and c != "entity_share"},
        }
        assert {k: r[k] for k in want} == pytest.approx(want) and want.keys() == r.asDict().keys() - {"doc_id"}
