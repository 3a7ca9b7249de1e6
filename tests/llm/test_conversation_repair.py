"""Conversation repair: the CYK cells against an exhaustive search of edit scripts, the cubic table, and edge cases."""

import hashlib
import itertools
import re
import zlib

import pytest

from commitgauge.llm import conversation_repair as cr

SHAPE = re.compile(r"(s?(ua)+)?")


def exhaustive(rows, most_inserts=3):
    """Least (cost, audit, text) over all edit scripts with at most ``most_inserts`` inserted rows."""
    best = None

    def walk(row, inserts, initials, audit, cost, lines, state):
        nonlocal best
        if state is None:
            return
        if row == len(rows):
            if state in cr.ACCEPT:
                assert SHAPE.fullmatch(initials)
                found = (cost, audit, "\n".join(lines))
                best = found if best is None or found[:2] < best[:2] else best
        if inserts < most_inserts:
            for c in "ua":
                walk(row, inserts + 1, initials + c, audit + "I", cost + 5, [*lines, f"{cr.NAMES[c]}:"], cr.STEP.get((state, c)))
        if row < len(rows):
            role, text, fault = rows[row]
            walk(row + 1, inserts, initials, audit + "D", cost + 2, lines, state)
            if fault in (1, 2):
                return
            extra = 5 if fault == 3 else 0
            walk(row + 1, inserts, initials + role[:1], audit + "K", cost + extra, [*lines, f"{role}:{text}"], cr.STEP.get((state, role[:1])))
            for c in "ua":
                walk(row + 1, inserts, initials + c, audit + "R", cost + 1 + extra, [*lines, f"{cr.NAMES[c]}:{text}"], cr.STEP.get((state, c)))

    walk(0, 0, "", "", 0, [], 0)
    return best


def cubic(initials, faults):
    """Textbook CYK: every span and every split point."""
    n = len(initials)
    table = {(i, i + 1): cr._times(cr.CLOSURE, cr.leaf(initials[i], faults[i])) for i in range(n)}
    for length in range(2, n + 1):
        for i in range(n - length + 1):
            cell = None
            for k in range(i + 1, i + length):
                made = cr._times(table[(i, k)], table[(k, i + length)])
                cell = made if cell is None else [[cr._best(a, b) for a, b in zip(x, y)] for x, y in zip(cell, made)]
            table[(i, i + length)] = cell
    whole = cr._times(table[(0, n)], cr.CLOSURE) if n else cr.CLOSURE
    return min(whole[0][q] for q in cr.ACCEPT if whole[0][q] is not None)


ROLES = ["system", "user", "assistant", "user", "assistant", "tool", ""]


@pytest.mark.parametrize("seed", range(40))
def test_cells_match_exhaustive_search_and_cubic_table(seed):
    rng = __import__("random").Random(seed)
    rows = [(rng.choice(ROLES), f"t{rng.randint(0, 3)}", rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randint(0, 5))]
    initials, faults = [r[0][:1] for r in rows], [r[2] for r in rows]
    cost, audit = cr.parse(initials, faults)
    assert (cost, audit) == cubic(initials, faults)
    want = exhaustive(rows)
    assert (cost, audit) == want[:2]
    assert cr.repaired(audit, [r[0] for r in rows], [r[1] for r in rows]) == want[2]


def brute_rows(conversations):
    """Damage and faults of the contract, row by row."""
    out = {}
    for conv_id, turn, role, text in conversations:
        key = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = role if role is not None else " ", text if text is not None else " "
        if kind == 0:
            out.setdefault(conv_id, [])
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out.setdefault(conv_id, []).extend([(turn, role, text)] * (2 if kind == 3 else 1))
    result = {}
    for conv_id, rows in out.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, marked = set(), []
        for turn, role, text in rows:
            blank = re.search(r"[^\x20\x09-\x0D]", text) is None
            stripped = re.sub(r"[\x20\x09-\x0D]+$", "", text)
            fault = 1 if blank else 2 if (role, text) in seen else 0 if stripped[-1:] in (".", "!", "?") and stripped else 3
            seen.add((role, text))
            marked.append((role, text, fault))
        turns = [t for t, _, _ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        steps = [a[:1] + b[:1] for (a, _, _), (b, _, _) in itertools.pairwise(marked)]
        cost, audit = cr.parse([r[0][:1] for r in marked], [r[2] for r in marked]) if marked else (0, "")
        text = cr.repaired(audit, [r[0] for r in marked], [r[1] for r in marked])
        result[conv_id] = (
            gaps, sum(f == 1 for *_, f in marked), sum(f == 2 for *_, f in marked), sum(f == 3 for *_, f in marked),
            sum(s not in cr.LEGAL_STEPS for s in steps), cost, audit, hashlib.sha256(text.encode()).hexdigest(),
        )
    return result


NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def run(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return {r.conv_id: tuple(r[n] for n in NAMES) for r in cr.repair(df.withColumn("audit", df.turn)).collect()}


def test_repair_matches_row_by_row(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert run(spark, rows) == brute_rows(rows)


def test_repair_edges(spark):
    long = "word " * 50_000 + "end."
    rows = [
        (1, 0, None, None), (1, 1, "user", "Hi."), (1, 1, "user", "Hi."), (1, None, "system", "Be kind."),
        (2, 5, "assistant", long), (2, 9, "user", "  \n "), (None, 0, "user", "no id?"), (None, None, None, "x"),
    ] + [(3, t, "user" if t % 2 else "assistant", f"turn {t}!") for t in range(300)]
    found = run(spark, rows)
    assert found == brute_rows(rows)
    dropped = [k for k in range(10_000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0][0]
    assert run(spark, [(dropped, 0, "user", "gone.")]) == {dropped: (0, 0, 0, 0, 0, 0, "", cr.EMPTY_SHA)}
    assert cr.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
