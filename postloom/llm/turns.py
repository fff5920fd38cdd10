"""Repair of conversation structure over a suffix-shared automaton of role and fault signatures.

A conversation's rows become one letter each, its role's initial and its fault. The signatures
of all conversations, once each, are sorted from their ends, so that signatures with a common
end follow each other and every different end is one node: a task keeps the nodes of the
signature it is at, and the next one adds only those that it does not share. Nodes whose costs
to go are alike up to a constant are minimised to one class, in which the costs to go and the
best first edit of each grammar state are worked out once for all conversations; a node is its
class and the constant. Each edit letter leads from a state to one state only, so taking the
ASCII-least of the cheapest letters at every node gives the ASCII-least of the cheapest audits.
"""

from __future__ import annotations

import hashlib
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postloom.llm.frames import store

# Damage, by the remainder of a row's CRC-32.
FAULTS, DROP, EMPTY, UNSTOP, REPEAT, USER = 20, 0, 1, 2, 3, 4
# The prices of edits, and of a truncated row that stays.
RECAST, REMOVE, ADD, TRUNCATED = 2, 3, 2, 1
# States: nothing yet, after the system row, after a user row, after an answer.
START, SYSTEM, ASKED, ANSWERED = range(4)
STATES = (START, SYSTEM, ASKED, ANSWERED)
NEEDED = ("u", "u", "a", "u")
AFTER = (ASKED, ASKED, ANSWERED, ASKED)
NAMES = {"u": "user", "a": "assistant"}
LAWFUL = ("su", "ua", "au")
MUST_GO = "d"
SOLID = " \t\n\x0b\x0c\r"
MOST = (1 << 63) - 1


# ---- automaton --------------------------------------------------------------------------------


def kept_state(state: int, symbol: str) -> int | None:
    """State after keeping a row, or None where the grammar has no place for it."""
    initial = symbol.lower()
    if initial == NEEDED[state]:
        return AFTER[state]
    return SYSTEM if initial == "s" and state == START else None


class Suffixes:
    """Nodes of the ends of one signature; classes of nodes for all signatures of a task."""

    def __init__(self):
        self.costs: list[tuple] = []  # of each class, less the smallest
        self.letters: list[tuple] = []
        self.known: dict[tuple, int] = {}
        self.steps: dict[tuple, tuple[int, int]] = {}  # (symbol, class) to (class, more cost)
        end = self._settle([0 if s in (START, ANSWERED) else None for s in STATES], {})
        self.symbols = ""
        self.node = array("i", [end[0]])
        self.base = array("q", [end[1]])

    def _settle(self, without: list, options: dict) -> tuple[int, int]:
        """Class and constant of a node: costs and edits without inserts, and with them."""
        cost = list(without)
        for _ in STATES:
            for s in STATES:
                if cost[AFTER[s]] is not None:
                    added = ADD + cost[AFTER[s]]
                    cost[s] = added if cost[s] is None else min(cost[s], added)
        letters = []
        for s in STATES:
            best = [x for x, c in options.get(s, {}).items() if c == cost[s]]
            if ADD + cost[AFTER[s]] == cost[s]:
                best.append("I")
            stops = not options and without[s] == cost[s]
            letters.append("" if stops else min(best))
        least = min(cost)
        key = (tuple(c - least for c in cost), tuple(letters))
        if key not in self.known:
            self.known[key] = len(self.costs)
            self.costs.append(key[0])
            self.letters.append(key[1])
        return self.known[key], least

    def _step(self, symbol: str, after: int) -> tuple[int, int]:
        """The node before a node of class ``after``, worked out once."""
        found = self.steps.get((symbol, after))
        if found is None:
            to_go = self.costs[after]
            extra = TRUNCATED if symbol.isupper() else 0
            options = {}
            for s in STATES:
                edits = {"D": REMOVE + to_go[s]}
                if symbol != MUST_GO:
                    edits["R"] = RECAST + extra + to_go[AFTER[s]]
                    kept = kept_state(s, symbol)
                    if kept is not None:
                        edits["K"] = extra + to_go[kept]
                options[s] = edits
            found = self._settle([min(options[s].values()) for s in STATES], options)
            self.steps[(symbol, after)] = found
        return found

    def audit(self, backwards: str) -> tuple[int, str]:
        """Cost and audit of a signature, given from its end."""
        shared = 0
        for x, y in zip(backwards, self.symbols):
            if x != y:
                break
            shared += 1
        del self.node[shared + 1 :], self.base[shared + 1 :]
        for symbol in backwards[shared:]:
            node, more = self._step(symbol, self.node[-1])
            self.base.append(self.base[-1] + more)
            self.node.append(node)
        self.symbols = backwards
        at, state, out = len(backwards), START, []
        while letter := self.letters[self.node[at]][state]:
            out.append(letter)
            if letter == "K":
                state = kept_state(state, backwards[at - 1])
            elif letter != "D":
                state = AFTER[state]
            if letter != "I":
                at -= 1
        return self.base[-1] + self.costs[self.node[-1]][START], "".join(out)


def audits(signatures: DataFrame) -> DataFrame:
    """(signature, cost, audit) of distinct signatures."""

    def run(batches):
        ends = Suffixes()
        for batch in batches:
            signature = batch.column("signature").to_pylist()
            found = [ends.audit(s[::-1]) for s in signature]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("signature"),
                    pa.array([c for c, _ in found], pa.int64()),
                    pa.array([a for _, a in found], pa.string()),
                ],
                names=["signature", "cost", "audit"],
            )

    back = F.reverse("signature")
    dealt = signatures.repartitionByRange(back).sortWithinPartitions(back)
    return dealt.mapInArrow(run, "signature string, cost long, audit string")


# ---- rows -----------------------------------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows after damage; a dropped row stays as ``gone``, for its conversation's sake."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.pmod(F.crc32(F.concat_ws(":", shown("conv_id"), shown("turn"))), F.lit(FAULTS))
    text = shown("text")
    text = F.when(fault == EMPTY, "").when(
        fault == UNSTOP, F.regexp_replace(text, "[.!?]", "")
    ).otherwise(text)
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(fault == USER, "user").otherwise(shown("role")).alias("role"),
        text.alias("text"),
        (fault == DROP).alias("gone"),
        F.explode(F.when(fault == REPEAT, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))),
    ).drop("col")
    # 128 bits stand for role and text
    return rows.withColumns({"k1": F.xxhash64("role", "text"), "k2": F.xxhash64("text", "role", F.lit(1))})


ORDER = ["turn", "role", "k1", "k2"]
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal"]
SIGNED = "conv_id long, signature string, " + ", ".join(f"{c} long" for c in COUNTS)


def signed(rows: DataFrame) -> DataFrame:
    """A row for each conversation: its signature and the counts of its faults. Texts stay."""
    solid = F.rtrim("text", F.lit(SOLID))
    small = rows.select(
        "conv_id", "turn", "role", "k1", "k2", "gone",
        (solid == "").alias("blank"),
        (~F.substring(solid, -1, 1).isin(".", "!", "?")).alias("cut"),
    )
    # one shuffle: a conversation's rows are together for the window and for the run below
    same = Window.partitionBy("conv_id", "gone", "k1", "k2").orderBy(F.asc_nulls_first("turn"))
    small = small.repartition("conv_id").withColumn("seen", F.row_number().over(same) > 1)

    def run(batches):
        out = []
        state = None

        def close():
            conv, letters, turns, blank, duplicate, truncated, illegal, _, _ = state
            first, last, n = turns
            gaps = 0 if first is None else min(last - first + 1 - n, MOST)
            out.append((conv, "".join(letters), gaps, blank, duplicate, truncated, illegal))

        def batch_of(rows):
            kinds = [pa.int64(), pa.string(), *[pa.int64()] * len(COUNTS)]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), kinds)],
                names=["conv_id", "signature", *COUNTS],
            )

        names = ("conv_id", "turn", "role", "gone", "blank", "cut", "seen")
        for batch in batches:
            for conv, turn, role, gone, blank, cut, seen in zip(
                *(batch.column(c).to_pylist() for c in names)
            ):
                if state is None or state[0] != conv:
                    if state is not None:
                        close()
                    # conversation, letters, turns, three faults, illegal, initial and turn before
                    state = [conv, [], [None, None, 0], 0, 0, 0, 0, None, None]
                if gone:
                    continue
                turns = state[2]
                if turn is not None:
                    turns[2] += turn != state[8]
                    state[8] = turn
                    turns[0] = turn if turns[0] is None else turns[0]
                    turns[1] = turn
                initial = role[:1]
                if state[7] is not None and state[7] + initial not in LAWFUL:
                    state[6] += 1
                state[7] = initial
                letter = initial if initial in ("s", "u", "a") else "o"
                if blank:
                    state[3] += 1
                    letter = MUST_GO
                elif seen:
                    state[4] += 1
                    letter = MUST_GO
                elif cut:
                    state[5] += 1
                    letter = letter.upper()
                state[1].append(letter)
            if len(out) > 1000:
                yield batch_of(out)
                out.clear()
        if state is not None:
            close()
        if out:
            yield batch_of(out)

    order = [F.asc_nulls_first("turn"), *ORDER[1:], "seen"]
    small = small.sortWithinPartitions("conv_id", *order)
    return small.select("conv_id", "turn", "role", "gone", "blank", "cut", "seen").mapInArrow(
        run, SIGNED
    )


REPAIRED = (
    "conv_id long, "
    + ", ".join(f"{c} long" for c in [*COUNTS, "cost"])
    + ", audit string, repaired_sha256 string"
)


def repaired(rows: DataFrame, judged: DataFrame) -> DataFrame:
    """The rows' conversations with their audits and the hash of what the audits leave.

    ``judged`` has a row for each conversation. Rows stream past the hash one by one; of a
    conversation only the audit is held.
    """
    heads = judged.select(
        "conv_id", F.lit(0).alias("rank"), F.lit(None).cast("long").alias("turn"),
        F.lit("").alias("role"), F.lit(0).cast("long").alias("k1"),
        F.lit(0).cast("long").alias("k2"), F.col("audit").alias("text"),
        F.array(*COUNTS, "cost").alias("counts"),
    )
    rest = rows.filter("not gone").select(
        "conv_id", F.lit(1).alias("rank"), *ORDER, "text",
        F.lit(None).cast("array<long>").alias("counts"),
    )

    def run(batches):
        out = []
        head = None  # conversation, counts, audit, place in it, state, digest, whether begun

        def line(role, text):
            head[5].update(("\n" if head[6] else "").encode() + f"{role}:{text}".encode())
            head[6] = True

        def insert():
            while head[3] < len(head[2]) and head[2][head[3]] == "I":
                line(NAMES[NEEDED[head[4]]], "")
                head[4] = AFTER[head[4]]
                head[3] += 1

        def close():
            insert()
            out.append((head[0], *head[1], head[2], head[5].hexdigest()))

        def batch_of(rows):
            kinds = [pa.int64()] * (len(COUNTS) + 2) + [pa.string()] * 2
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), kinds)],
                names=[c.split()[0] for c in REPAIRED.split(", ")],
            )

        names = ("conv_id", "rank", "role", "text", "counts")
        for batch in batches:
            for conv, rank, role, text, counts in zip(*(batch.column(c).to_pylist() for c in names)):
                if rank == 0:
                    if head is not None:
                        close()
                    head = [conv, counts, text, 0, START, hashlib.sha256(), False]
                    continue
                insert()
                letter = head[2][head[3]]
                head[3] += 1
                if letter == "K":
                    line(role, text)
                    head[4] = kept_state(head[4], role[:1])
                elif letter == "R":
                    line(NAMES[NEEDED[head[4]]], text)
                    head[4] = AFTER[head[4]]
            if len(out) > 1000:
                yield batch_of(out)
                out.clear()
        if head is not None:
            close()
        if out:
            yield batch_of(out)

    order = ["conv_id", "rank", F.asc_nulls_first("turn"), *ORDER[1:]]
    dealt = heads.unionByName(rest).repartition("conv_id").sortWithinPartitions(*order)
    return dealt.select("conv_id", "rank", "role", "text", "counts").mapInArrow(run, REPAIRED)


def repair_conversations(conversations: DataFrame) -> DataFrame:
    """Faults and cheapest repair of every conversation of (conv_id, turn, role, text).

    Rows are first damaged by their CRC-32, then taken by turn, NULL first; rows of one turn
    by role, then by a hash of role and text. A row is blank, or a duplicate of an earlier row
    (role and text), or truncated; the first that holds counts. The audit is the ASCII-least
    of the cheapest ways (Keep, Rerole, Delete, Insert) to role initials ``(s?(ua)+)?``, and
    the hash is of the rows that it leaves.

    NULL stands for one space in role, text and in what the CRC-32 is taken of; rows of NULL
    conv_id are one conversation. Every conv_id comes back, with zeros, an empty audit and the
    hash of nothing where no row is left. Gaps beyond a long are the largest long. Repeated
    rows are duplicates, other columns are ignored, and an empty table gives no rows. A
    conversation's letters, a byte a row, are held by one task, and its texts run through one
    task row by row, as their one hash asks for.
    """
    rows = damaged(conversations)
    heads = store(signed(rows), "signatures")
    found = audits(heads.select("signature").distinct())
    return repaired(rows, heads.join(found, "signature"))
