"""Repair of damaged conversations by an automaton over shared suffixes of their signatures.

A conversation's signature has one symbol a row: its role's initial (``o`` for roles other than s, u, a), in upper case if
the row is truncated, or ``x`` if it must be deleted.  What a signature's rest costs depends on that rest alone, so
signatures are minimised from their ends: a node is a suffix, and suffixes shared by conversations are one node.  For each
node and each state of the grammar ``(s?(ua)+)?`` the cost-to-go and the first edit of the best audit suffix are computed
once.  Nodes whose costs-to-go differ by a constant are one class, and the step from a class by a symbol is looked up.

Signatures are dealt by ranges of their reversals (and the conversation, so that a very common one is split), and a task
walks its sorted range with a stack: it goes back to the longest suffix shared with the one before and adds nodes from
there.  What a task holds is one signature and the classes, of which there are a few dozen.

The contract's digest is a chain over all rows of a conversation, so those are streamed through one task in order, sorted
and spilled by Spark; nothing but the signature and the audit (a letter or so a row, as in the result) is held of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .textcore import row_slices, stored, tasks_for

#: Space and the control characters 9 to 13.
SPACES = " \t\n\x0b\x0c\r"
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1

#: States of the grammar: nothing yet, after the system's row, after a user's, after an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where a state goes by what it may go on with: a user's row, but an assistant's after a user's.
AFTER = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}

COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal")
LEGAL = {"su", "ua", "au"}
NEVER = 1 << 60

#: Rows and bytes that a task returns at once.
OUT_ROWS, OUT_BYTES = 4096, 4 << 20


def keep(state: int, initial: str) -> int | None:
    """The state after a row kept as it is, None where the grammar forbids it."""
    if initial == "s":
        return SYSTEM if state == START else None
    wanted = "a" if state == USER else "u"
    return AFTER[state] if initial == wanted else None


class Suffixes:
    """Classes of suffix nodes: costs-to-go by state, least the smallest, and the first edit by state."""

    def __init__(self) -> None:
        self.classes: list[tuple[tuple[int, ...], tuple[str, ...]]] = []
        self.number: dict = {}
        self.step: dict[tuple[int, str], tuple[int, int]] = {}
        self.end, self.end_cost = self._class([(0, ""), None, None, (0, "")])

    def _class(self, by_row: list[tuple[int, str] | None]) -> tuple[int, int]:
        """The class of the node that goes on as ``by_row`` says unless rows are inserted first; and its least cost."""
        best = [x or (NEVER, "~") for x in by_row]
        for _ in range(4):  # an insertion leads to a user's or an assistant's row, and those to one another
            best = [min(best[s], (INSERT + best[AFTER[s]][0], "I")) for s in range(4)]
        least = min(c for c, _ in best)
        key = tuple(c - least for c, _ in best), tuple(e for _, e in best)
        if key not in self.number:
            self.number[key] = len(self.classes)
            self.classes.append(key)
        return self.number[key], least

    def before(self, node: int, symbol: str) -> tuple[int, int]:
        """The node that ``symbol`` makes before ``node``: its class, and how much more it costs."""
        if (node, symbol) not in self.step:
            costs, options = self.classes[node][0], []
            for s in range(4):
                edits = [(DELETE + costs[s], "D")]
                if symbol != "x":
                    more, to = TRUNCATED * symbol.isupper(), keep(s, symbol.lower())
                    edits.append((REROLE + more + costs[AFTER[s]], "R"))
                    if to is not None:
                        edits.append((more + costs[to], "K"))
                options.append(min(edits))
            self.step[node, symbol] = self._class(options)
        return self.step[node, symbol]

    def audit(self, path: list[int], signature: str) -> str:
        """The best edits from the start state; ``path``: classes of the suffixes, the empty one first."""
        out, state, at = [], START, 0
        while True:
            edit = self.classes[path[len(signature) - at]][1][state]
            if not edit:
                return "".join(out)
            out.append(edit)
            if edit in "IR":
                state = AFTER[state]
            elif edit == "K":
                state = keep(state, signature[at].lower())
            at += edit != "I"


class Walk:
    """Signatures in order of their reversals: ``path`` and ``cost`` are the classes and costs of one's nodes, from the
    empty suffix on; those it shares with the one before stay."""

    def __init__(self) -> None:
        self.suffixes, self.last = Suffixes(), ""
        self.path, self.cost = [self.suffixes.end], [self.suffixes.end_cost]

    def to(self, signature: str) -> int:
        """Go on to ``signature``; how many of its nodes, the empty suffix aside, are shared with the one before."""
        n, most = 0, min(len(self.last), len(signature))
        while n < most and self.last[-1 - n] == signature[-1 - n]:
            n += 1
        del self.path[n + 1 :], self.cost[n + 1 :]
        for symbol in reversed(signature[: len(signature) - n]):
            node, more = self.suffixes.before(self.path[-1], symbol)
            self.path.append(node)
            self.cost.append(self.cost[-1] + more)
        self.last = signature
        return n

    def result(self) -> tuple[int, str]:
        """Cost and audit of the last signature."""
        return self.cost[-1] + self.suffixes.classes[self.path[-1]][0][START], self.suffixes.audit(self.path, self.last)


def best_audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: rows with a ``signature``, sorted by its reversal, get ``cost`` and ``audit``."""
    walk, before, found = Walk(), None, (0, "")
    for batch in batches:
        for part in _by_bytes(batch, "signature"):
            out = []
            for signature in part.column("signature").to_pylist():
                if signature != before:
                    walk.to(signature)
                    before, found = signature, walk.result()
                out.append(found)
            columns = [pa.array([c for c, _ in out], pa.int64()), pa.array([a for _, a in out], pa.string())]
            rest = [n for n in part.schema.names if n != "signature"]
            yield pa.RecordBatch.from_arrays([part.column(n) for n in rest] + columns, names=[*rest, "cost", "audit"])


def _by_bytes(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    return row_slices(batch, text, rows=OUT_ROWS, limit=OUT_BYTES)


def suffix_nodes(signatures: DataFrame) -> DataFrame:
    """(node, symbol, next, costs, edits) of the automaton of ``signatures`` (signature: string), each node once: a suffix's
    digest, its first symbol, the node of the rest, and cost-to-go and first edit by grammar state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, names = Walk(), [hashlib.sha256(b"").hexdigest()]
        out: list[tuple] = []
        started = False
        for batch in batches:
            for signature in batch.column("signature").to_pylist():
                n = walk.to(signature)
                del names[n + 1 :]
                new = range(n + 1, len(signature) + 1)
                for i in new if started else range(len(signature) + 1):
                    if i:
                        names.append(hashlib.sha256(f"{signature[-i]}{names[-1]}".encode()).hexdigest())
                    costs, edits = walk.suffixes.classes[walk.path[i]]
                    out.append((names[i], signature[-i] if i else None, names[i - 1] if i else None, [c + walk.cost[i] for c in costs], list(edits)))
                started = True
                if len(out) >= OUT_ROWS:
                    yield _nodes(out)
                    out = []
        if out:
            yield _nodes(out)

    found = signatures.select("signature").distinct().withColumn("_end", F.reverse("signature"))
    dealt = found.repartitionByRange(tasks_for(found), "_end").sortWithinPartitions("_end").select("signature")
    return dealt.mapInArrow(run, NODES).dropDuplicates(["node"])


NODES = "node string, symbol string, next string, costs array<long>, edits array<string>"


def _nodes(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.string()))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["node", "symbol", "next", "costs", "edits"])


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """``rows`` (conv, turn, role, text) with ``copies``, how often each is there, after damage by crc32 of its place."""
    place = F.concat(*(x for c in (conv, turn) for x in (F.coalesce(F.col(c).cast("string"), F.lit(" ")), F.lit(":"))))
    kind = F.crc32(F.expr("left(_place, length(_place) - 1)").cast("binary")) % 20
    out = rows.withColumn("_place", place).withColumn("_kind", kind)
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("_kind") == 0, 0).when(F.col("_kind") == 3, 2).otherwise(1)
    return out.withColumns({"text": text, "role": role, "copies": copies}).drop("_place", "_kind")


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: (conv, signature, counts) of rows (conv, live, turn, initial, symbol) in order."""
    now, begun, out = None, False, []
    marks, seen, previous, illegal, turns, least, most = bytearray(), {"b": 0, "d": 0, "t": 0}, None, 0, 0, None, None
    kind = None

    def closed() -> tuple:
        gaps = most - least + 1 - turns if turns else 0
        return now, marks.decode(), gaps, seen["b"], seen["d"], seen["t"], illegal

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [kind, pa.string()] + [pa.int64()] * len(COUNTS)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["conv", "signature", *COUNTS])

    held = 0
    for batch in batches:
        kind = batch.column("conv").type
        for conv, live, turn, initial, symbol in zip(*(batch.column(c).to_pylist() for c in ("conv", "live", "turn", "initial", "symbol")), strict=True):
            if not begun or conv != now:
                if begun:
                    out.append(closed())
                    held += len(marks) + 64
                now, begun = conv, True
                marks, seen, previous, illegal, turns, least, most = bytearray(), {"b": 0, "d": 0, "t": 0}, None, 0, 0, None, None
                if held >= OUT_BYTES:
                    yield batch_of(out)
                    out, held = [], 0
            if not live:
                continue
            fault = symbol if symbol in "bd" else "t" if symbol.isupper() else ""
            if fault:
                seen[fault] += 1
            marks += b"x" if symbol in "bd" else symbol.encode()
            illegal += previous is not None and previous + initial not in LEGAL
            previous = initial
            if turn is not None:
                turns += turn != most
                least, most = turn if least is None else least, turn
    if begun:
        out.append(closed())
    if out:
        yield batch_of(out)


def _applied(kind: str):
    """For mapInArrow over a conversation's header (audit, counts) and then its rows in order: the header, and a row for each
    edit that leaves one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, at, state, place, out, held = None, "", 0, START, 0, [], 0
        conv_type = None

        def batch_of() -> pa.RecordBatch:
            names = ["conv", "place", "edit", "role", "text", "audit", "cost", *COUNTS]
            kinds = [conv_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()] + [pa.int64()] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

        nothing = (None,) * 7

        def inserted() -> None:
            """The insertions that the audit has next."""
            nonlocal at, state, place
            while at < len(audit) and audit[at] == "I":
                state, at, place = AFTER[state], at + 1, place + 1
                out.append((conv, place, "I", ROLE[state], "", *nothing))

        columns = ("conv", "head", "initial", "role", "text", "audit", "cost", *COUNTS)
        for whole in batches:
            conv_type = whole.column("conv").type
            for batch in _by_bytes(whole, "text"):
                for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                    if row[1]:
                        inserted()
                        conv, audit, at, state, place = row[0], row[5], 0, START, 0
                        out.append((conv, 0, None, None, None, *row[5:]))
                        continue
                    inserted()
                    edit, at = audit[at], at + 1
                    if edit == "D":
                        continue
                    state = AFTER[state] if edit == "R" else keep(state, row[2])
                    place += 1
                    out.append((conv, place, edit, ROLE[state] if edit == "R" else row[3], row[4], *nothing))
                if out:
                    yield batch_of()
                    out = []
        inserted()
        if out:
            yield batch_of()

    return run


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: a row for each conversation, with the digest of its repaired rows."""
    header, chain, first, out = None, hashlib.sha256(), True, []
    conv_type = None

    def batch_of() -> pa.RecordBatch:
        names = ["conv", *COUNTS, "cost", "audit", "repaired_sha256"]
        kinds = [conv_type] + [pa.int64()] * 6 + [pa.string()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    for batch in batches:
        conv_type = batch.column("conv").type
        for conv, place, role, text, audit, *counts in zip(*(batch.column(c).to_pylist() for c in ("conv", "place", "role", "text", "audit", *COUNTS, "cost")), strict=True):
            if not place:
                if header:
                    out.append((*header, chain.hexdigest()))
                header, chain, first = (conv, *counts, audit), hashlib.sha256(), True
                continue
            chain.update((b"" if first else b"\n") + f"{role}:".encode())
            chain.update(text.encode())
            first = False
        if len(out) >= OUT_ROWS:
            yield batch_of()
            out = []
    if header:
        out.append((*header, chain.hexdigest()))
    if out:
        yield batch_of()


def _repaired(rows: DataFrame, conv: str, turn: str, role: str, text: str, damage) -> DataFrame:
    blank = F.lit(" ")
    plain = rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), blank).alias("role"), F.coalesce(F.col(text), blank).alias("text"))
    plain = damage(plain, "conv", "turn") if damage else plain.withColumn("copies", F.lit(1))
    same = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)
    named = plain.withColumn("same", same).withColumn("initial", F.left("role", F.lit(1)))
    kind = plain.schema["conv"].dataType.simpleString()

    # 1. signatures, from rows without their texts
    end = F.rtrim(F.col("text"), F.lit(SPACES))
    whole = F.endswith(end, F.lit(".")) | F.endswith(end, F.lit("!")) | F.endswith(end, F.lit("?"))
    known = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    mark = F.when(end == "", "b").when(whole, known).otherwise(F.upper(known))
    copy = F.explode(F.when(F.col("copies") > 0, F.sequence(F.lit(1), F.col("copies"))).otherwise(F.array(F.lit(0)))).alias("copy")
    narrow = named.select("conv", "turn", "role", "initial", "same", mark.alias("mark"), copy).withColumn("live", F.col("copy") > 0)
    narrow = narrow.repartition("conv")
    earlier = W.partitionBy("conv", "live", "same").orderBy("turn", "copy")
    narrow = narrow.withColumn("time", F.row_number().over(earlier))
    narrow = narrow.withColumn("symbol", F.when((F.col("time") > 1) & (F.col("mark") != "b"), "d").otherwise(F.col("mark")))
    ordered = narrow.sortWithinPartitions("conv", "turn", "role", "same", "time").select("conv", "live", "turn", "initial", "symbol")
    counts = ", ".join(f"{c} long" for c in COUNTS)
    signed = stored(ordered.mapInArrow(_signatures, f"conv {kind}, signature string, {counts}"), "conversation-signatures")

    # 2. audits, in order of reversed signatures
    dealt = signed.withColumn("_end", F.reverse("signature"))
    dealt = dealt.repartitionByRange(tasks_for(rows), "_end", "conv").sortWithinPartitions("_end").select(*signed.columns)
    headers = dealt.mapInArrow(best_audits, f"conv {kind}, {counts}, cost long, audit string")

    # 3. each conversation's audit and then its rows, texts and all
    copies = F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy")
    body = named.where("copies > 0").select("conv", F.lit(False).alias("head"), "turn", "role", "same", "initial", "text", copies).drop("_copy")
    both = headers.withColumn("head", F.lit(True)).unionByName(body, allowMissingColumns=True).repartition("conv")
    both = both.sortWithinPartitions("conv", F.desc("head"), "turn", "role", "same")
    both = both.select("conv", "head", "initial", "role", F.coalesce("text", F.lit("")).alias("text"), "audit", "cost", *COUNTS)
    return both.mapInArrow(_applied(kind), f"conv {kind}, place long, edit string, role string, text string, audit string, cost long, {counts}")


def repaired_rows(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", damage=None) -> DataFrame:
    """(conv, place, edit, role, text): the rows that repair leaves, numbered from 1 in each conversation; ``edit`` is K, R
    or I.  Other arguments and cases as in repair()."""
    out = _repaired(rows, conv, turn, role, text, damage).where("place > 0")
    return out.select(F.col("conv").alias(conv), "place", "edit", "role", "text")


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", damage=None) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), one row per conversation.

    ``damage`` maps rows to damaged ones with ``copies`` (see damaged(); None: rows as they are).  Rows follow each other by
    turn, null turns first; those of one turn by role and then by a digest of role and text, so that a row repeated in its
    turn stands beside itself.  A null role or text is one space, and a null conversation is one like others.  A
    conversation of which damage leaves no row has zeros, an empty audit and the empty text's digest.  Roles count by their
    first letter, in lower case only.  An empty table gives no rows; further columns are not read.
    """
    kind = rows.schema[conv].dataType.simpleString()
    counts = ", ".join(f"{c} long" for c in (*COUNTS, "cost"))
    out = _repaired(rows, conv, turn, role, text, damage).mapInArrow(_digests, f"conv {kind}, {counts}, audit string, repaired_sha256 string")
    return out.withColumnRenamed("conv", conv)
