"""Repair of conversation structure by grammar-compressed dynamic programming.

The rows of a conversation, in order, form a sequence of symbols: what matters of a row is the initial of its role (s, u, a or another) and
its fault. Over such a sequence the cheapest repair is a shortest path through an automaton of four states (nothing yet, after s, after
u, after a), so each symbol has a matrix of (cost, audit) from state to state, matrices are multiplied in the min-plus sense, and a
sequence is the product of its symbols. Ties go to the audit that is least in ASCII. As every matrix puts inserted turns before its row,
no audit of a segment is the beginning of another one of equal cost, and so the least audit of a product is made of least audits.

Re-Pair finds what conversations share: the pairs of neighbouring symbols that are commonest over all conversations become symbols of
their own, turn by turn, counted on Spark over the distinct sequences. In one turn only pairs are taken whose occurrences cannot overlap.
Each rule's matrix is the product of two others and its audits are ropes that share their parts, evaluated bottom-up and once for all
conversations. At most `rules` rules are kept and `turns` turns are made. That bounds the grammar, which is shipped to the tasks, and the
work that is shared; symbols without a rule are multiplied as they are, so results do not depend on it.

A conversation is never collected. Its rows are sorted by Spark and pass through a task as a stream, once with digests of the texts in
place of texts, for the symbols, and once with the texts, for the repaired rows. A hash over a whole conversation is sequential by nature, so
one task reads each conversation.

Nulls in a role or text count as one blank; rows without conv_id are one conversation; rows without turn come first. Rows of one turn are
in the order of role and digest of the text. A role that is an empty string has no initial and cannot be kept. Texts are told apart by 128
bits of hash. A conversation that lost all its rows has zeros and an empty audit. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import zip_longest

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from fieldlab.functions.reuse import stored

WHITE = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)  # what the repaired rows end with so far
STEPS = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
COST = 3  # of another role, an inserted row, or a truncated row that stays; a row deleted costs one more
SYMBOLS = "dsuaxSUAX"  # a row that has to go; or the initial, capital where the text is truncated
_FIRST = 0xF0000  # code point of the first rule
_FLAT = 64  # ropes up to this length are plain strings
_MEMO = 1 << 14


# The matrices


class Rope:
    """Two audits in a row."""

    __slots__ = ("left", "right", "size")

    def __init__(self, left, right):
        self.left, self.right, self.size = left, right, len(left) + len(right)

    def __len__(self):
        return self.size


def joined(left, right):
    if not len(left) or not len(right):
        return left if len(left) else right
    return left + right if len(left) + len(right) <= _FLAT and isinstance(left, str) and isinstance(right, str) else Rope(left, right)


def pieces(rope) -> Iterator[str]:
    todo = [rope]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            yield x
        else:
            todo += (x.right, x.left)


def before(a, b) -> bool:
    """Whether audit a is less than audit b. Common beginnings that are one rope are not walked."""
    while isinstance(a, Rope) and isinstance(b, Rope) and a.left is b.left:
        a, b = a.right, b.right
    if a is b:
        return False
    for x, y in zip_longest((c for p in pieces(a) for c in p), (c for p in pieces(b) for c in p), fillvalue=""):
        if x != y:
            return x < y
    return False


def least(paths):
    """Of (cost, audit) the cheapest, then the least; None if there are none."""
    best = None
    for path in paths:
        if best is None or path[0] < best[0] or (path[0] == best[0] and before(path[1], best[1])):
            best = path
    return best


def _inserted(state: int) -> Iterator[tuple[int, int, str]]:
    """(state, cost, audit) after any number of inserted rows that may be worth it."""
    yield state, 0, ""
    for n in range(1, 4):
        state = ASSISTANT if state == USER else USER
        yield state, COST * n, "I" * n


def base(symbol: str) -> list[list]:
    """The matrix of one row."""
    found = [[[] for _ in range(4)] for _ in range(4)]
    late = COST if symbol in "SUAX" else 0
    for i in range(4):
        for k, cost, audit in _inserted(i):
            found[i][k].append((cost + COST + 1, audit + "D"))
            if symbol != "d":
                own = STEPS.get(symbol.lower(), {})
                if k in own:
                    found[i][own[k]].append((cost + late, audit + "K"))
                for role in "ua":
                    if k in STEPS[role]:
                        found[i][STEPS[role][k]].append((cost + COST + late, audit + "R"))
    return [[least(x) for x in row] for row in found]


def product(a: list[list], b: list[list]) -> list[list]:
    def cell(row: list, j: int):
        return least((row[k][0] + b[k][j][0], joined(row[k][1], b[k][j][1])) for k in range(4) if row[k] is not None and b[k][j] is not None)

    return [[cell(row, j) for j in range(4)] for row in a]


def matrices(rules: list[str]) -> dict[str, list[list]]:
    """The matrices of all symbols, bottom-up; rule n stands for the two symbols rules[n]."""
    found = {s: base(s) for s in SYMBOLS}
    for n, (left, right) in enumerate(rules):
        found[chr(_FIRST + n)] = product(found[left], found[right])
    return found


def compressed(sequences: list[str], rules: list[str]) -> list[str]:
    text = "\n".join(sequences)
    for n, pair in enumerate(rules):
        text = text.replace(pair, chr(_FIRST + n))
    return text.split("\n")


def cheapest(sequence: str, known: dict[str, list[list]]) -> tuple[int, str]:
    """(cost, audit) of a compressed sequence."""
    states: list = [[(0, ""), None, None, None]]
    for symbol in sequence:
        states = product(states, known[symbol])
    ends = []
    for i, path in enumerate(states[0]):
        if path is not None:
            ends += [(path[0] + cost, joined(path[1], audit)) for k, cost, audit in _inserted(i) if k in (START, ASSISTANT)]
    cost, audit = least(ends)
    return cost, "".join(pieces(audit))


# Rows and their symbols


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copy, gone: rows(conv_id, turn, role, text) after the damage that a hash of the place decides."""
    blank = F.lit(" ")
    kind = F.crc32(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), blank), F.coalesce(F.col("turn").cast("string"), blank))) % 20
    text = F.coalesce("text", blank)
    return rows.select(
        "conv_id", "turn",
        F.when(kind == 4, "user").otherwise(F.coalesce("role", blank)).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
        (kind == 0).alias("gone"),
    )


def undamaged(rows: DataFrame) -> DataFrame:
    """The same columns for rows that are repaired as they are."""
    blank = F.lit(" ")
    return rows.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), F.lit(0).alias("copy"), F.lit(False).alias("gone"))


ORDER = (F.asc_nulls_first, "turn"), (F.asc, "role"), (F.asc, "digest"), (F.asc, "copy")


def _order() -> list:
    return [how(name) for how, name in ORDER]


def _digest():
    return F.unhex(F.md5("text")).alias("digest")


def _streamed(sorted_rows: DataFrame, schema: str, own: Callable[[tuple, Iterator[dict]], Iterator[tuple]]) -> DataFrame:
    """Each run of rows with one conv_id through `own` as an iterator of dicts; a conversation may span batches."""
    names = sorted_rows.columns
    target = to_arrow_schema(StructType.fromDDL(schema))

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (dict(zip(names, r)) for batch in found for start in range(0, batch.num_rows, 1000) for r in zip(*(c.to_pylist() for c in batch.slice(start, 1000).columns)))
        row, out = next(rows, None), []

        def same(conv):
            nonlocal row
            while row is not None and row["conv_id"] == conv:
                yield row
                row = next(rows, None)

        while row is not None:
            group = same(row["conv_id"])
            for result in own(row["conv_id"], group):
                out.append(result)
                if len(out) == 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), target)], schema=target)
                    out = []
            for _ in group:  # what `own` left, the step past its last row at least
                pass
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), target)], schema=target)

    return sorted_rows.mapInArrow(batches, schema)


def sequences(rows: DataFrame) -> DataFrame:
    """conv_id, symbols, gaps, blank, duplicate, truncated, illegal: one row per conversation of rows as `damaged` gives them."""
    trimmed = F.rtrim("text", F.lit(WHITE))
    marked = rows.select(
        "conv_id", "turn", "role", _digest(), "copy", "gone",
        F.substring("role", 1, 1).alias("initial"), (trimmed == "").alias("blank"), (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("cut"),
    ).repartition("conv_id")
    seen = F.row_number().over(Window.partitionBy("conv_id", "gone", "role", "digest").orderBy(F.asc_nulls_first("turn"), "copy")) > 1
    marked = marked.withColumn("seen", seen).sortWithinPartitions(F.asc_nulls_first("conv_id"), *_order())

    def read(conv, found):
        symbols, n, last, lowest, highest, distinct, illegal = [], Counter(), None, None, None, 0, 0
        for r in found:
            if r["gone"]:
                continue
            fault = "blank" if r["blank"] else "duplicate" if r["seen"] else "truncated" if r["cut"] else ""
            n[fault] += 1
            initial = r["initial"] if r["initial"] in STEPS else "x"
            symbols.append("d" if fault in ("blank", "duplicate") else initial.upper() if fault else initial)
            illegal += last is not None and last + initial not in ("su", "ua", "au")
            last = initial
            if r["turn"] is not None:
                distinct += r["turn"] != highest
                lowest, highest = r["turn"] if lowest is None else lowest, r["turn"]
        gaps = 0 if lowest is None else highest - lowest + 1 - distinct
        yield conv, "".join(symbols), gaps, n["blank"], n["duplicate"], n["truncated"], illegal

    return _streamed(marked, "conv_id long, symbols string, gaps long, blank long, duplicate long, truncated long, illegal long", read)


# The grammar


def grammar(counted: DataFrame, rules: int = 512, turns: int = 12) -> list[str]:
    """Re-Pair over counted(symbols, n): the two symbols that each rule stands for."""
    found: list[str] = []
    for _ in range(turns):

        def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: Counter = Counter()
            for batch in batches:
                for start in range(0, batch.num_rows, 1000):
                    part = batch.slice(start, 1000)
                    for text, n in zip(compressed(part.column(0).to_pylist(), found), part.column(1).to_pylist()):
                        for pair in zip(text, text[1:]):
                            total[pair] += n
            yield pa.RecordBatch.from_arrays([pa.array(["".join(p) for p in total], pa.string()), pa.array(list(total.values()), pa.int64())], ["pair", "n"])

        common = counted.mapInArrow(pairs, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n")).where("n > 1")
        firsts, seconds, fresh = set(), set(), []
        for row in common.orderBy(F.desc("n"), "pair").limit(rules).collect():  # the commonest pairs: the grammar's bounded size
            a, b = row["pair"]
            if a not in seconds and b not in firsts and a != b or (a == b and a not in firsts | seconds):
                firsts.add(a)
                seconds.add(b)
                fresh.append(a + b)
        found = found + fresh[: rules - len(found)]
        if not fresh or len(found) == rules:
            break
    return found


def audited(rows: DataFrame, rules: int = 512, turns: int = 12) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit: one row per conversation of rows as `damaged` gives them."""
    read = stored(sequences(rows))
    counted = stored(read.where("symbols != ''").groupBy("symbols").agg(F.count("*").alias("n")))
    found = grammar(counted, rules, turns)

    def evaluated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, memo = matrices(found), {}
        for batch in batches:
            out = []
            for start in range(0, batch.num_rows, 1000):
                for sequence in compressed(batch.column("symbols").slice(start, 1000).to_pylist(), found):
                    if sequence not in memo:
                        if len(memo) >= _MEMO:
                            memo.clear()
                        memo[sequence] = cheapest(sequence, known)
                    out.append(memo[sequence])
            kept = [batch.column(c) for c in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal")]
            names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([c for c, _ in out], pa.int64()), pa.array([a for _, a in out], pa.string())], names)

    return read.mapInArrow(evaluated, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


# The repaired rows


def edited(audit: str, rows: Iterator[dict]) -> Iterator[tuple]:
    """(edit, turn, role, text) of the repaired rows; an inserted one has no turn."""
    state, names = START, {"u": "user", "a": "assistant"}
    edits = iter(audit)

    def turned() -> str:
        return "a" if state == USER else "u"

    for edit in edits:
        if edit == "I":
            initial, turn, role, text = turned(), None, None, ""
        else:
            r = next(rows)
            if edit == "D":
                continue
            initial, turn, role, text = (r["role"][:1], r["turn"], r["role"], r["text"]) if edit == "K" else (turned(), r["turn"], None, r["text"])
        state = STEPS[initial][state]
        yield edit, turn, role or names[initial], text


def _texts(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """The rows of each conversation in order, after one row with its audit."""
    order = [f.name for f in audits.schema if f.name != "conv_id"]
    head = audits.select("conv_id", F.lit(0).alias("part"), *[F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("text", "string"), ("digest", "binary"), ("copy", "int"))], F.struct(*order).alias("found"))
    body = rows.where("not gone").select("conv_id", F.lit(1).alias("part"), "turn", "role", "text", _digest(), "copy", F.lit(None).cast(head.schema["found"].dataType).alias("found"))
    return head.union(body).repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "part", *_order()).drop("digest", "copy", "part")


def repaired(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """conv_id, place, turn, role, text, edit: the repaired conversations, from rows as `damaged` gives them and their `audited`."""

    def rebuilt(conv, found):
        audit = next(found)["found"]["audit"]
        for place, (edit, turn, role, text) in enumerate(edited(audit, found)):
            yield conv, place, turn, role, text, edit

    return _streamed(_texts(rows, audits), "conv_id long, place long, turn long, role string, text string, edit string", rebuilt)


def digested(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """The audits with repaired_sha256: the hash of the repaired `role:text` of a conversation, joined by newlines."""

    def hashed(conv, found):
        head, digest, first = next(found)["found"], hashlib.sha256(), True
        for _, _, role, text in edited(head["audit"], found):
            digest.update(b"" if first else b"\n")
            digest.update(f"{role}:{text}".encode())
            first = False
        yield conv, *head.values(), digest.hexdigest()

    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in audits.schema)
    return _streamed(_texts(rows, audits), f"{columns}, repaired_sha256 string", hashed)


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation of rows as `damaged` gives them: faults, cost, audit and hash of the repaired rows."""
    return digested(rows, stored(audited(rows)))
