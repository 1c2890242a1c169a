"""Claims' ids by place, against a plain version row by row."""

import re

from ledgerline.operators import signals


def plain(rows):
    """(sheet, rec): (claim_id, stage), a field at a time."""
    cut = lambda x: {w for w in re.split(r"\s+", re.sub("[_/#+]", " ", x.lower()).strip()) if len(w) > 1 and w not in ("of", "the", "a", "an", "and", "or", "to", "in", "for")}
    alike = lambda a, b: len(a & b) / len(a | b) if a and b else 0.0
    out = {}
    for sheet, rec, pos, field, value in rows:
        name, v = field.lower().replace("_", " ").strip(" "), (value or "").strip(" ")
        if any(w in name for w in signals.CHECK_NAMES):
            place = 0
        elif any(w in name for w in signals.ID_NAMES):
            place = 1
        elif len(v) >= 2 and max(alike(cut(name), cut(w)) for w in signals.ID_NAMES) >= signals.ID_LIKENESS:
            place = 2
        elif re.search("(?i)^[A-Z]{2,5}[-_]?[A-Z0-9]{2,15}$", v) and re.search("[0-9]", v):
            place = 3
        else:
            place = 9
        out.setdefault((sheet, rec), []).append((place, pos, value) if v and place < 9 else (9, pos, None))
    best = {k: min(v, key=lambda x: x[:2]) for k, v in out.items()}
    return {k: (value, p if p < 2 else p - 1) if p < 9 else (str(k[1] + 1), 3) for k, (p, _, value) in best.items()}


def test_claim_ids_in_one_pass(spark):
    names = ["Number of the Claim", "Claim/Number", "claim_no", "Check Number", "Loss\tRef", "ref loss", "#Clm Nr", "File+Numbers", "Record", "the id of Record", "Other", "Loss Date", " ", "Number Claim Paid", "number Claim"]
    values = ["77-A", "AB-1234", " ", "", None, "7", " XY99 ", "plain"]
    rows = [(f"s{r % 3}", r, p, names[(r * 7 + p * 11 + r // 5) % len(names)], values[(r * 3 + p * 5 + r // 8) % len(values)]) for r in range(200) for p in range(1, 5)]
    df = spark.createDataFrame(rows, "sheet string, rec int, pos int, field string, value string")
    found = signals.claim_ids(df)
    assert {(r.sheet, r.rec): (r.claim_id, r.stage) for r in found.collect()} == plain(rows)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" not in plan
