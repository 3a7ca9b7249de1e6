"""Conversation structure repair: the cheapest edits that give each conversation the shape (system?)(user assistant)+.

Rows are first damaged on purpose (drops, emptied texts, lost stops, repeated rows, wrong roles) by a hash of
``conv_id:turn``; faults, gaps and illegal role steps are then found with windows over each conversation.

The repair is weighted CYK interval parsing. The repair grammar in Chomsky normal form has a nonterminal X_pq for
each pair of states p, q of the shape's automaton (start, after system, after user, after assistant); a row is a
terminal that X_pq derives by keeping its role (0), giving it the role user or assistant (1) or deleting it (2, and
the only edit of a blank or duplicate row), and X_pq -> X_pr X_rq. A cell of a span holds for every X_pq the least
(cost, audit), audits compared as ASCII text; empty-text user and assistant rows may be inserted anywhere (5 each),
which is the insertion closure applied between rows. Kept or re-roled truncated rows add 5. Cells are combined bottom
up by span length. Every split point of a span gives the same cell for this grammar (its language is regular), so
each span is split once, on a balanced bracketing, and the table has one cell a span of that bracketing: linear in
the rows, not cubic.

Conversations are clustered by conv_id and sorted by position; one task streams its conversations one by one, holding
one at a time. Defined cases: missing role, text or turn count as one space in the hash key, missing role and text
are one space; rows of one conversation are ordered by turn (missing first), then role, text and copy. A role's
initial is its first character; a role that is empty or starts with another letter is kept only through re-roling or
deletion. Conversations whose rows were all dropped give zeros, an empty audit and the hash of the empty text. A
missing conv_id is one conversation. Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from commitgauge.llm.common import hide_missing, show_missing

# Fixed values of the contract: damage kinds by hash remainder, edit costs, legal role steps.
DAMAGE_MODULUS = 20
DROP, EMPTY, NO_STOPS, REPEAT, USER = 0, 1, 2, 3, 4
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
LEGAL_STEPS = ("su", "ua", "au")
SPACE = r"[\x20\x09-\x0D]"
STOPS = "[.!?]"

#: The shape's automaton: state after an emitted role initial; 0 start, 1 after system, 2 after user, 3 after
#: assistant. Accepting: 0 and 3.
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
STATES = range(4)
ACCEPT = (0, 3)
NAMES = {"u": "user", "a": "assistant"}
RESULT = "conv_id long, cost long, audit string, repaired_sha256 string"
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows after damage: conv_id, turn, role, text, copy."""
    key = F.concat(
        F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" "))
    )
    kind = F.crc32(key) % DAMAGE_MODULUS
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == USER, F.lit("user")).otherwise(F.coalesce(F.col("role").cast("string"), F.lit(" "))).alias("role"),
        F.when(kind == EMPTY, F.lit("")).when(kind == NO_STOPS, F.regexp_replace(text, STOPS, "")).otherwise(text).alias("text"),
        kind.alias("kind"),
    )
    copies = F.when(F.col("kind") == REPEAT, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.filter(F.col("kind") != DROP).select("conv_id", "turn", "role", "text", F.explode(copies).alias("copy"))


def faults(rows: DataFrame) -> DataFrame:
    """Damaged rows with pos (order in the conversation), initial and fault (0 none, 1 blank, 2 duplicate,
    3 truncated: each row's first)."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text", "copy")
    placed = rows.withColumn("pos", F.row_number().over(order))
    blank = ~F.col("text").rlike(f"[^{SPACE[1:-1]}]")
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy("pos")) > 1
    last = F.substring(F.regexp_replace("text", f"{SPACE}+$", ""), -1, 1)
    fault = F.when(blank, 1).when(seen, 2).when(~last.rlike(STOPS), 3).otherwise(0)
    return placed.select("conv_id", "turn", "pos", "role", "text", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"))


def _best(a, b):
    return b if a is None or (b is not None and b < a) else a


def _times(x, y):
    """Cells of two adjacent spans combined: min over the middle state of the sum of costs and joined audits."""
    out = [[None] * 4 for _ in STATES]
    for p in STATES:
        for r in STATES:
            left = x[p][r]
            if left is None:
                continue
            for q in STATES:
                right = y[r][q]
                if right is not None:
                    out[p][q] = _best(out[p][q], (left[0] + right[0], left[1] + right[1]))
    return out


def _closure():
    """Least (cost, audit) of inserted rows alone from state p to q."""
    cell = [[(0, "") if p == q else None for q in STATES] for p in STATES]
    for _ in range(len(STATES)):
        grown = [row[:] for row in cell]
        for p in STATES:
            for r in STATES:
                if cell[p][r] is None:
                    continue
                for c in "ua":
                    q = STEP.get((r, c))
                    if q is not None:
                        grown[p][q] = _best(grown[p][q], (cell[p][r][0] + INSERT, cell[p][r][1] + "I"))
        cell = grown
    return cell


CLOSURE = _closure()


def leaf(initial: str, fault: int):
    """The cell of one row: keep, re-role or delete it."""
    cell = [[(DELETE, "D") if p == q else None for q in STATES] for p in STATES]
    if fault in (1, 2):
        return cell
    extra = TRUNCATED if fault == 3 else 0
    for p in STATES:
        if (p, initial) in STEP:
            q = STEP[(p, initial)]
            cell[p][q] = _best(cell[p][q], (KEEP + extra, "K"))
        for c in "ua":
            q = STEP.get((p, c))
            if q is not None:
                cell[p][q] = _best(cell[p][q], (REROLE + extra, "R"))
    return cell


def parse(initials: list[str], fault_list: list[int]) -> tuple[int, str]:
    """Least (cost, audit) of a conversation: CYK cells bottom up by span length over a balanced bracketing."""
    cells = [_times(CLOSURE, leaf(i, f)) for i, f in zip(initials, fault_list)]
    while len(cells) > 1:
        cells = [_times(cells[k], cells[k + 1]) if k + 1 < len(cells) else cells[k] for k in range(0, len(cells), 2)]
    whole = _times(cells[0], CLOSURE) if cells else CLOSURE
    return min(whole[0][q] for q in ACCEPT if whole[0][q] is not None)


def repaired(audit: str, roles: list[str], texts: list[str]) -> str:
    """The repaired conversation as `role:text` lines; roles of new and re-roled rows follow from the shape."""
    n = sum(1 for x in audit if x != "D")
    shape = (["s"] if n % 2 else []) + ["u", "a"] * (n // 2)
    lines, row, at = [], 0, 0
    for x in audit:
        if x == "D":
            row += 1
            continue
        if x == "I":
            lines.append(f"{NAMES[shape[at]]}:")
        else:
            lines.append(f"{roles[row] if x == 'K' else NAMES[shape[at]]}:{texts[row]}")
            row += 1
        at += 1
    return "\n".join(lines)


def _repair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held = None

    def solve(conv: pd.DataFrame) -> tuple:
        cost, audit = parse(list(conv["initial"]), list(conv["fault"]))
        text = repaired(audit, list(conv["role"]), list(conv["text"]))
        return conv["conv_id"].iloc[0], cost, audit, hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()

    for pdf in batches:
        if held is not None:
            pdf = pd.concat([held, pdf], ignore_index=True)
        last = pdf["conv_id"].iloc[-1]
        done, held = pdf[pdf["conv_id"] != last], pdf[pdf["conv_id"] == last]
        if len(done):
            yield pd.DataFrame([solve(c) for _, c in done.groupby("conv_id", sort=False)], columns=["conv_id", "cost", "audit", "repaired_sha256"])
    if held is not None and len(held):
        yield pd.DataFrame([solve(held)], columns=["conv_id", "cost", "audit", "repaired_sha256"])


def _count(condition: Column, name: str) -> Column:
    return F.count(F.when(condition, 1)).cast("long").alias(name)


def repair(conversations: DataFrame) -> DataFrame:
    """Per original conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    found = faults(damaged(conversations))
    step = F.concat(F.lag("initial").over(Window.partitionBy("conv_id").orderBy("pos")), F.col("initial"))
    stats = found.withColumn("step", step).groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).cast("long").alias("gaps"),
        _count(F.col("fault") == 1, "blank"),
        _count(F.col("fault") == 2, "duplicate"),
        _count(F.col("fault") == 3, "truncated"),
        _count(F.col("step").isNotNull() & ~F.col("step").isin(*LEGAL_STEPS), "illegal"),
    )
    streamed = found.select(hide_missing("conv_id"), "pos", "role", "text", "initial", "fault")
    streamed = streamed.repartition("conv_id").sortWithinPartitions("conv_id", "pos")
    parsed = streamed.mapInPandas(_repair, RESULT).select(show_missing("conv_id"), "cost", "audit", "repaired_sha256")
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    parsed = parsed.withColumnRenamed("conv_id", "_parsed")
    both = stats.join(parsed, F.col("conv_id").eqNullSafe(F.col("_parsed"))).drop("_parsed").withColumnRenamed("conv_id", "_found")
    out = every.join(both, F.col("conv_id").eqNullSafe(F.col("_found")), "left").drop("_found")
    zero = F.lit(0).cast("long")
    return out.select(
        "conv_id",
        *(F.coalesce(c, zero).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(EMPTY_SHA)).alias("repaired_sha256"),
    )
