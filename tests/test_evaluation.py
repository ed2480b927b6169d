"""All systems of an evaluation against a loop over questions, and the registered ones end to end."""

import datetime as dt
import math
import random
import re
from collections import Counter

import pytest

from arbiter.operators import evaluation
from arbiter.plans.rules import COMPLIANCE

RULES = [r for r in COMPLIANCE if set(r.scope) <= {"employee_id", "security_ticker"}]
KINDS = sorted({k for r in RULES for k in (r.trigger_type, r.target_type)})
KEYS = ("employee_id", "security_ticker")
START = dt.datetime(2024, 1, 1)
rng = random.Random(11)
EVENTS = [
    (i, rng.choice(KINDS), START + dt.timedelta(hours=rng.randrange(40)), f"{rng.choice(['ann', 'bob', 'cy'])} deals {rng.choice(['much', 'little', 'ann'])}", rng.choice(["E1", "E2"]), rng.choice(["T1", "T2", None]))
    for i in range(70)
]
QUESTIONS = [(0, "what of ann", "E1", "T1", "compliant"), (1, "bob bob much", "E2", "T2", "non_compliant"), (2, "nothing named", None, None, "active"), (3, "cy little", "E1", None, "requires_review"), (4, "zz", "E9", "T1", "compliant")]
KNOWN = [(q, e) for q, *_ in QUESTIONS for e in rng.sample(range(70), 25)]
GOLD = [(q, e, p) for q, *_ in QUESTIONS for p, e in enumerate(rng.sample(range(70), 3))]
INITIAL = [(q, e, r + 1) for q, *_ in QUESTIONS for r, e in enumerate(rng.sample(range(70), 70))]
PRIORITY = [("blackout_announced", "no"), ("emergency_exception", "yes")]


def overriders(ids, of):
    """Of each overridden event of a set its triggers by time and id, with their rules."""
    out = {}
    for r in RULES:
        for t in ids:
            for g in ids:
                a, b = of[t], of[g]
                same = all(a[c] is not None and a[c] == b[c] for c in (4 if s == "employee_id" else 5 for s in r.scope))
                if a[1] == r.target_type and b[1] == r.trigger_type and same and b[2] > a[2]:
                    out.setdefault(t, []).append((b[2], g, r.rule_id))
    return {t: sorted(x) for t, x in out.items()}


def bm25(query):
    docs = {e[0]: re.findall(r"[a-z0-9]+", e[3]) for e in EVENTS}
    mean = sum(map(len, docs.values())) / len(docs)
    df = Counter(t for d in docs.values() for t in set(d))
    scores = {}
    for i, d in docs.items():
        terms = [t for t in query.split() if t in d]
        if terms:
            scores[i] = sum(math.log((len(docs) - df[t] + 0.5) / (df[t] + 0.5) + 1) * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / mean)) for t in terms)
    ranked = sorted(scores, key=lambda i: (-round(scores[i], 6), i))
    return ranked + [i for i in sorted(docs) if i not in scores]


def ranking(system, q, of, known, gone, found):
    initial = [e for p, e, _ in INITIAL if p == q[0]]
    top, tail = initial[:20], initial[20:]
    if system == "bm25":
        return bm25(q[1])
    if system == "dense":
        return initial
    if system == "oracle":
        gold = [e for p, e, _ in GOLD if p == q[0]]
        return gold + [e for e in sorted(of) if e not in gold]
    if system == "temporal_audit":
        called = {gone[e][0][1] for e in top if e in gone}
        return [e for e in top if e not in gone] + [e for e in tail if e in called] + [e for e in top if e in gone] + [e for e in tail if e not in called]
    if system == "temporal_audit_proactive":
        new = sorted((e for e in found if e not in top), key=lambda e: (-of[e][2].timestamp(), e))
    else:
        first = {e: min((k for k, c in enumerate(top) if of[c][2] < of[e][2]), default=None) for e in found if e not in top}
        new = sorted((e for e, k in first.items() if k is not None), key=lambda e: (first[e], of[e][2], e))
    fine = lambda e: e in known and e not in gone
    rest = [e for e in top if fine(e)], [e for e in top if e not in known], [e for e in top if e in known and e in gone]
    return new, fine, rest, [e for e in tail if e not in new], [e for e in tail]


def brute(systems, priority, keep):
    of = {e[0]: e for e in EVENTS}
    for q in QUESTIONS:
        known = {e for p, e in KNOWN if p == q[0]}
        gone = overriders(known, of)
        found = [e[0] for e in EVENTS if q[2] is not None and e[4] == q[2] and e[5] == q[3]]
        for s in systems:
            order = ranking(s, q, of, known, gone, found)
            if isinstance(order, tuple):
                new, fine, rest, after, tail = order
                if keep:
                    order = [e for e in new if fine(e)] + [e for e in new if not fine(e)] + sum(rest, []) + after
                else:
                    front = [e for e in new if fine(e)]
                    order = front + sum(rest, []) + [e for e in tail if e not in front]
            top = order[:5]
            judged = overriders(found, of) if s in ("temporal_audit_plus", "temporal_audit_proactive") and found else gone
            if priority:
                inside = [e for e in top if all(v is None or of[e][c] == v for c, v in ((4, q[2]), (5, q[3])))]
                kinds = {of[e][1] for e in inside if e not in judged}
                said = next((a for k, a in priority if k in kinds), min(kinds, default="__no_active_events__"))
            else:
                inside = [e for e in top if q[2] is None or q[3] is None or (of[e][4], of[e][5]) == (q[2], q[3])]
                kinds = {of[e][1] for e in inside if e not in judged}
                said = (
                    "compliant" if "emergency_exception" in kinds else "non_compliant" if kinds & {"blackout_announced", "watchlist_added"}
                    else "active" if "pre_clearance_approved" in kinds else "non_compliant" if "blackout_lifted" in kinds else "requires_review"
                )
            gold = {e for p, e, _ in GOLD if p == q[0]}
            clean = all(max(gone[e])[1] in top for e in top if e in gone)
            right = said == q[4]
            yield s, q[0], round(len(gold & set(top)) / len(gold), 6), right, clean, float(right and clean)


@pytest.mark.parametrize(("systems", "priority", "keep"), [(evaluation.SYSTEMS, None, True), (evaluation.DOMAIN_SYSTEMS, PRIORITY, False)])
def test_against_a_loop(spark, systems, priority, keep):
    world = evaluation.World(
        spark.createDataFrame(QUESTIONS, "qid long, query string, employee_id string, security_ticker string, expected string"),
        spark.createDataFrame(EVENTS, "event_id long, event_type string, ts timestamp, text string, employee_id string, security_ticker string"),
        spark.createDataFrame(KNOWN, "qid long, event_id long"), spark.createDataFrame(GOLD, "qid long, doc_id long, pos int"),
        spark.createDataFrame(INITIAL, "qid long, doc_id long, rank int"), RULES, KEYS,
    )
    out = evaluation.evaluate(world, systems, priority=priority, keep_superseded=keep)
    got = sorted(map(tuple, out.select("system", "qid", "recall", "answer_correct", "no_ignored_supersession", "tca").collect()))
    assert got == sorted(brute(systems, priority, keep))
    with pytest.raises(ValueError):
        evaluation.evaluate(world, ("none",))


def test_registered(spark, sf):
    from arbiter.queries import QUERIES

    out = QUERIES["systems_rollup"](spark, sf).collect()
    assert {r.system for r in out} == {"all", *evaluation.SYSTEMS}
    assert len({r.n for r in out if r.system != "all"}) == 1
    assert {r.system for r in QUERIES["domain_systems_eval"](spark, sf).select("system").distinct().collect()} == set(evaluation.DOMAIN_SYSTEMS)
