"""Filter interaction audit: brute force over every order, and the defined cases."""

import re
from itertools import permutations

import pytest

from commitgauge.llm import filter_audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, labels):
    """Every order and step by walking the documents one by one."""
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    fails = []
    for i, text, lang in docs:
        t = text or ""
        w = WORD.findall(t)
        e = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs)
        f = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": re.search("[#$%&*|]", t) is not None, "E": e,
        }
        fails.append((i, lang or "", f))
    out = {}
    for part in {p for _, p, _ in fails}:
        rows = [(i, f) for i, p, f in fails if p == part]
        for order in permutations("ABCDE"):
            for s, x in enumerate(order):
                before = order[:s]
                gone = [i for i, f in rows if f[x] and not any(f[y] for y in before)]
                out[(part, "".join(order), s + 1)] = (
                    sum(1 for _, f in rows if not any(f[y] for y in order[: s + 1])), len(gone),
                    sum(1 for _, f in rows if f[x] and any(f[y] for y in before)),
                    sum(1 for _, f in rows if f[x] and sum(f.values()) == 1),
                    sum(1 for i in gone if i in good), sum(1 for i in gone if i in toxic),
                )
    for (part, order, step), v in list(out.items()):
        x = order[step - 1]
        total = sum(w[1] for (p, o, s), w in out.items() if p == part and o[s - 1] == x)
        out[(part, order, step)] = (*v, total)
    return out


def test_audit_matches_brute_force(spark):
    caps = "ALL CAPITALS HERE " * 80
    long = " ".join(f"w{i}" for i in range(250))
    docs = [
        (1, long, "en"), (2, long, "en"), (3, long + " #", "en"), (4, caps, "de"), (5, None, None), (6, "", None),
        (None, long, "en"), (7, long, "en"), (7, long, "en"), (8, "a " * 300, "en"), (0, long, "fr"), (9, "short.", "en"),
    ]
    labels = [(2, 1, 0), (3, 0, 1), (8, 1, 1), (8, 0, 0), (None, 1, 1)]
    found = filter_audit.audit(
        spark.createDataFrame(docs, "doc_id long, text string, lang string"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    ).collect()
    want = brute(docs, labels)
    assert len(found) == len(want) == 4 * 600
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert {(r.part, r.filter_order, r.step): tuple(r[n] for n in names) for r in found} == want


def test_audit_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, mask string, shapley double")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(empty, labels).count() == 0
    clash = spark.createDataFrame([(1, None, None, "x", 1.0)], empty.schema)
    rows = filter_audit.audit(clash, labels).collect()
    assert len(rows) == 600 and {r.part for r in rows} == {""}
    first = [r for r in rows if r.filter_order == "ABCDE" and r.step == 1][0]
    assert (first.removed, first.kept, first.shapley) == (1, 0, 120)  # A removes it in every order


@pytest.mark.parametrize("k", [0, 3])
def test_orders_cover_every_permutation(k):
    orders = {o for o, *_ in filter_audit.ORDERS}
    assert len(orders) == 120 and len(filter_audit.ORDERS) == 600
    o, s, b, p = filter_audit.ORDERS[k]
    assert b == 1 << "ABCDE".index(o[s - 1]) and p == sum(1 << "ABCDE".index(x) for x in o[: s - 1])
