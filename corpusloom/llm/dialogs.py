"""Conversation repair: the cheapest edits that make the roles of a conversation match (s?(ua)+)?.

Wu-Manber's cost layers, backwards: for every turn there is a bitset of grammar states for each cost, the states from
which the rest can be accepted at that cost or less. All layers of a turn are one integer (four bits a layer), so that a
turn costs a few shifts whatever the cost. From the first turn on, the first layer that holds the start state gives the
cost, and a walk along the bits, trying edits in ASCII order, gives the least audit.

States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant; 0 and 3 accept. Between states of a turn costs
differ by at most 7, so 16 layers above the least one are enough: a state that misses one of them can mimic another's edits.

Rows are dealt by ranges of (conversation, turn), so that a conversation of any length is split, and packed into blocks
of bounded size. A conversation within one block, as nearly all are, is repaired there. Of others the blocks meet twice
as short strings (a character a row), backwards for layers and forwards for edits, in tasks that hold one block at a time.

Defined cases: a null conv_id is a conversation of its own; null role and text count as one space; a null turn comes first;
rows of one turn go by role, the first 64 characters of their text, its md5; a conversation whose rows are all gone and
one without rows give zeros and empty results; an empty role has no initial, so what it stands beside is illegal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Rows and characters a block holds.
BLOCK_ROWS, BLOCK_CHARS = 512, 4 << 20
_WIDE = 16
_ALL = (1 << 4 * _WIDE) - 1
_BIT = [sum(1 << 4 * c + s for c in range(_WIDE)) for s in range(4)]
#: What may stand beside what.
LEGAL = {"su", "ua", "au"}
NAMES = {2: "user", 3: "assistant"}
_TURNED = (2, 2, 3, 2)  # the state that an inserted or reroled turn leads to


def _turned(x: int) -> int:
    """States from which an inserted or reroled turn leads into x, in every layer."""
    user = x & _BIT[2]
    return (x & _BIT[3]) >> 1 | user >> 2 | user >> 1 | user << 1


def _kept(x: int, initial: str) -> int:
    if initial == "s":
        return (x & _BIT[1]) >> 1
    if initial == "u":
        user = x & _BIT[2]
        return user >> 2 | user >> 1 | user << 1
    return (x & _BIT[3]) >> 1 if initial == "a" else 0


def _opened(x: int) -> int:
    """With what inserted turns add, which cost 2 each."""
    for _ in range(2):
        x |= _turned(x) << 8 & _ALL
    return x


#: Layers behind the last turn, and the cost of the lowest.
END = (_opened(_BIT[0] | _BIT[3]), 0)


def layers(codes: str, after: tuple[int, int] = END) -> list[tuple[int, int]]:
    """Per turn and behind the last: layers and the cost of the lowest. A code is a turn's initial (x: another), upper case
    where the turn is truncated, or - where it must go."""
    out = [after]
    x, base = after
    for code in reversed(codes):
        y = x << 12
        if code != "-":
            low = code.lower()
            cost = 0 if low == code else 4
            y |= _kept(x, low) << cost | _turned(x) << 8 + cost
        y = _opened(y & _ALL)
        empty = ((y & -y).bit_length() - 1) // 4
        x, base = (y >> 4 * empty | _ALL & ~(_ALL >> 4 * empty)), base + empty
        out.append((x, base))
    return out[::-1]


def _has(layer: tuple[int, int], cost: int, state: int) -> bool:
    at = cost - layer[1]
    return at >= 0 and bool(layer[0] >> 4 * min(at, _WIDE - 1) + state & 1)


def least(layer: tuple[int, int], state: int) -> int:
    """The first layer that holds the state."""
    cost = layer[1]
    while not _has(layer, cost, state):
        cost += 1
    return cost


def walked(codes: str, rows: list[tuple[int, int]], state: int, last: bool) -> tuple[str, int]:
    """The ASCII-least edits of least cost, and the state they lead to; behind the last turn also what must be inserted."""
    edits, i = [], 0
    cost = least(rows[0], state)
    while True:
        if i == len(codes) and (not last or cost == rows[-1][1] and state in (0, 3)):
            return "".join(edits), state
        code = codes[i] if i < len(codes) else ""
        low = code.lower()
        late = int(low != code)
        then = {"s": 1 if state == 0 else None, "u": 2 if state != 2 else None, "a": 3 if state == 2 else None}.get(low)
        for edit, price, to, step in (("D", 3, state, 1), ("I", 2, _TURNED[state], 0), ("K", late, then, 1), ("R", 2 + late, _TURNED[state], 1)):
            if (not code and step) or (code == "-" and edit in "KR") or to is None:
                continue
            if _has(rows[i + step], cost - price, to):
                edits.append(edit)
                cost, state, i = cost - price, to, i + step
                break


@lru_cache(50_000)
def _solved(codes: str) -> tuple[int, str]:
    rows = layers(codes)
    return least(rows[0], 0), walked(codes, rows, 0, True)[0]


def solved(codes: str) -> tuple[int, str]:
    """Cost and audit of a whole conversation."""
    return _solved(codes) if len(codes) <= 64 else _solved.__wrapped__(codes)


def applied(edits: str, turns: list, state: int = 0) -> tuple[list[tuple], int]:
    """The repaired turns (turn, role, text, edit) of (turn, role, text), and the state they lead to."""
    out, at = [], iter(turns)
    for edit in edits:
        turn, role, text = next(at) if edit != "I" else (None, "", "")
        if edit == "D":
            continue
        state = {"s": 1, "u": 2, "a": 3}[role[0]] if edit == "K" else _TURNED[state]
        out.append((turn, role if edit == "K" else NAMES[state], text, edit))
    return out, state


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone: rows changed by crc32(`conv_id:turn`) % 20. 0 drops one (gone), 1 empties its text,
    2 takes its . ! ? away, 3 repeats it, 4 makes it the user's. Nulls count as one space."""
    id_, turn = F.col("conv_id").cast("long"), F.col("turn").cast("long")
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    kind = F.crc32(F.concat(F.coalesce(id_.cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(turn.cast("string"), F.lit(" ")))) % 20
    rows = conversations.select(id_.alias("conv_id"), turn.alias("turn"), role.alias("role"), text.alias("text"), kind.alias("kind"))
    twice = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    new_text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    new_role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", new_role.alias("role"), new_text.alias("text"), (F.col("kind") == 0).alias("gone"), twice).drop("copy")


_BLOCKS = "conv_id long, c string, part int, seq int, open boolean, turns array<long>, roles array<string>, texts array<string>, faults array<tinyint>"


def _packed(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows to blocks of one conversation each. One that touches the edge of a partition or is full is open."""
    part, seq, conv, held, size, first, full = TaskContext.get().partitionId(), 0, object(), [], 0, True, False
    out: list[tuple] = []

    def close(end: bool, more: bool) -> None:
        nonlocal seq, first, held, size, full
        if held:
            live = [r for r in held if r[3] >= 0]
            key = " " if conv is None else str(conv)
            out.append((conv, key, part, seq, first or end or more or full, *map(list, zip(*live, strict=True))) if live else (conv, key, part, seq, first or end or more or full, [], [], [], []))
            seq, held, size = seq + 1, [], 0
            first, full = first and more, more

    def flushed() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True))
        out.clear()
        text = pa.list_(pa.string())
        kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.list_(pa.int64()), text, text, pa.list_(pa.int8())]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=["conv_id", "c", "part", "seq", "open", "turns", "roles", "texts", "faults"])

    for batch in batches:
        for id_, *row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if id_ != conv:
                close(False, False)
                conv = id_
            elif len(held) >= most or size > BLOCK_CHARS:
                close(False, True)
            held.append(row)
            size += len(row[2])
        if len(out) > 256:
            yield flushed()
    close(True, False)
    if out:
        yield flushed()


def blocks(rows: DataFrame, most: int = BLOCK_ROWS) -> DataFrame:
    """Rows (conv_id, turn, role, text, gone) in blocks, in order, each row with its own fault: 1 blank, 3 truncated, -1 gone."""
    fault = (
        F.when(F.col("gone"), -1)
        .when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), 1)
        .when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), 3)
        .otherwise(0)
        .cast("tinyint")
    )
    keyed = rows.select("conv_id", "turn", "role", "text", fault.alias("fault"), F.substring("text", 1, 64).alias("start"), F.md5("text").alias("digest"))
    order = ["conv_id", "turn", "role", "start", "digest"]
    placed = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    return placed.select("conv_id", "turn", "role", "text", "fault").mapInArrow(lambda batches: _packed(batches, most), _BLOCKS)


def _key(role: str, text: str) -> bytes:
    return hashlib.md5(f"{len(role)}:{role}{text}".encode(errors="surrogatepass")).digest()


def _coded(roles: list[str], texts: list[str], faults: list[int], seen: set) -> tuple[str, list[int]]:
    """Codes of a block's rows and its blank, duplicate and truncated ones. seen: keys of rows of earlier blocks."""
    codes, own, counts = [], set(), [0, 0, 0]
    for role, text, fault in zip(roles, texts, faults, strict=True):
        if fault != 1:
            key = (role, text)
            if key in own or (seen and _key(role, text) in seen):
                fault = 2
            own.add(key)
        if fault:
            counts[fault - 1] += 1
        initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
        codes.append("-" if fault in (1, 2) else initial.upper() if fault else initial)
    return "".join(codes), counts


def _beside(roles: list[str], before: str | None = None) -> int:
    firsts = ([before] if before is not None else []) + [r[:1] for r in roles]
    return sum(a + b not in LEGAL for a, b in zip(firsts, firsts[1:], strict=False))


_REPAIRED = "conv_id long, c string, part int, seq int, cost long, audit string, gaps long, blank long, duplicate long, truncated long, illegal long, turns array<long>, roles array<string>, texts array<string>, edits array<string>"
_KINDS = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.string(), *[pa.int64()] * 5, pa.list_(pa.int64()), *[pa.list_(pa.string())] * 3]
_NAMES = ["conv_id", "c", "part", "seq", "cost", "audit", "gaps", "blank", "duplicate", "truncated", "illegal", "turns", "roles", "texts", "edits"]


def _arrow(rows: list[tuple], kinds: list, names: list[str]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=names)


def _columns(turns: list[tuple]) -> list[list]:
    return [list(x) for x in zip(*turns, strict=True)] if turns else [[], [], [], []]


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks that are conversations, repaired where they are."""
    for batch in batches:
        out = []
        for b in batch.to_pylist():
            codes, (blank, double, cut) = _coded(b["roles"], b["texts"], b["faults"], set())
            cost, audit = solved(codes)
            known = [t for t in b["turns"] if t is not None]
            gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
            turns, _ = applied(audit, list(zip(b["turns"], b["roles"], b["texts"], strict=True)))
            out.append((b["conv_id"], b["c"], b["part"], b["seq"], cost, audit, gaps, blank, double, cut, _beside(b["roles"]), *_columns(turns)))
        yield _arrow(out, _KINDS, _NAMES)


def _split(open_blocks: DataFrame) -> DataFrame:
    """Conversations of several blocks: faults by the first block that holds a row, layers backwards, edits forwards."""
    at = ["c", "part", "seq"]

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(b["c"], b["part"], b["seq"], k) for b in batch.to_pylist() for k in {_key(r, t) for r, t, f in zip(b["roles"], b["texts"], b["faults"], strict=True) if f != 1}]
            yield _arrow(out, [pa.string(), pa.int32(), pa.int32(), pa.binary()], [*at, "key"])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for b in batch.to_pylist():
                codes, counts = _coded(b["roles"], b["texts"], b["faults"], set(b["seen"] or []))
                out.append((b["c"], b["part"], b["seq"], codes, *counts, [r[:1] for r in b["roles"]], b["turns"]))
            yield _arrow(out, [pa.string(), pa.int32(), pa.int32(), pa.string(), *[pa.int64()] * 3, pa.list_(pa.string()), pa.list_(pa.int64())], [*at, "codes", "blank", "duplicate", "truncated", "firsts", "turns"])

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, after = None, END
        for batch in batches:
            out = []
            for c, part, seq, codes in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                last = c != conv
                if last:
                    conv, after = c, END
                out.append((c, part, seq, after[0].to_bytes(8, "little"), after[1], last))
                after = layers(codes, after)[0]
            yield _arrow(out, [pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.bool_()], [*at, "x", "base", "last"])

    def forth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, before, low, high = None, 0, None, None, None
        for batch in batches:
            out = []
            for b in batch.to_pylist():
                new = b["c"] != conv
                if new:
                    conv, state, before, low, high = b["c"], 0, None, None, None
                rows = layers(b["codes"], (int.from_bytes(b["x"], "little"), b["base"]))
                entry, cost = state, least(rows[0], state) if new else 0
                audit, state = walked(b["codes"], rows, state, b["last"])
                known = sorted({t for t in b["turns"] if t is not None})
                gaps = 0  # what this block adds to maxTurn - minTurn + 1 - distinctTurns
                if known:
                    gaps = known[-1] - known[0] + 1 - len(known) if low is None else known[-1] - high - len([t for t in known if t != high])
                    low, high = known[0] if low is None else low, known[-1]
                illegal = _beside(b["firsts"], before)
                before = b["firsts"][-1] if b["firsts"] else before
                out.append((b["c"], b["part"], b["seq"], cost, audit, gaps, b["blank"], b["duplicate"], b["truncated"], illegal, entry))
            yield _arrow(out, [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.string(), *[pa.int64()] * 6], [*at, "cost", "audit", "gaps", "blank", "duplicate", "truncated", "illegal", "entry"])

    def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for b in batch.to_pylist():
                turns, _ = applied(b["audit"], list(zip(b["turns"], b["roles"], b["texts"], strict=True)), b["entry"])
                out.append(tuple(b[n] for n in _NAMES[:11]) + tuple(_columns(turns)))
            yield _arrow(out, _KINDS, _NAMES)

    found = open_blocks.select(*at, "roles", "texts", "faults").mapInArrow(keys, "c string, part int, seq int, key binary")
    first = found.groupBy("c", "key").agg(F.min(F.struct("part", "seq")).alias("first"), F.count("*").alias("n")).where("n > 1")
    seen = found.join(first, ["c", "key"]).where(F.struct("part", "seq") > F.col("first")).groupBy(*at).agg(F.collect_list("key").alias("seen"))
    coded = stored(open_blocks.join(seen, at, "left").mapInArrow(code, "c string, part int, seq int, codes string, blank long, duplicate long, truncated long, firsts array<string>, turns array<long>"), "codes")
    behind = coded.select(*at, "codes").repartition("c").sortWithinPartitions("c", F.desc("part"), F.desc("seq")).mapInArrow(back, "c string, part int, seq int, x binary, base long, last boolean")
    walk = coded.join(behind, at).repartition("c").sortWithinPartitions(*at).mapInArrow(forth, "c string, part int, seq int, cost long, audit string, gaps long, blank long, duplicate long, truncated long, illegal long, entry long")
    return open_blocks.join(stored(walk, "edits"), at).mapInArrow(mend, _REPAIRED)


def repair(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, gone) to repaired blocks: a conversation's blocks in order of (part, seq) hold its
    repaired turns with the edit that each comes from; costs and counts of the blocks add up to the conversation's."""
    placed = stored(blocks(rows), "blocks", keep=True)
    return placed.where("not open").mapInArrow(_whole, _REPAIRED).withColumn("open", F.lit(False)).unionByName(_split(placed.where("open")).withColumn("open", F.lit(True)))


def repaired_turns(repaired: DataFrame) -> DataFrame:
    """One row per repaired turn: conv_id, part, seq and place (in order), turn, role, text, edit (K, R or I)."""
    zipped = F.posexplode(F.arrays_zip("turns", "roles", "texts", "edits")).alias("place", "t")
    return repaired.select("conv_id", "part", "seq", zipped).select("conv_id", "part", "seq", "place", F.col("t.turns").alias("turn"), F.col("t.roles").alias("role"), F.col("t.texts").alias("text"), F.col("t.edits").alias("edit"))


_DIGEST = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def digest(repaired: DataFrame) -> DataFrame:
    """One row per conversation: counts, cost, audit, hash of its repaired turns. One block in memory at a time."""
    sums = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, hashed, empty, audit = None, None, None, True, []
        kinds = [pa.int64()] * 7 + [pa.string()] * 2

        def row() -> tuple:
            return (*held, "".join(audit), hashed.hexdigest())

        for batch in batches:
            out = []
            for b in batch.to_pylist():
                if b["c"] != now:
                    if now is not None:
                        out.append(row())
                    now, held, hashed, empty, audit = b["c"], [b["conv_id"], *[0] * 6], hashlib.sha256(), True, []
                for i, n in enumerate(sums):
                    held[i + 1] += b[n]
                audit.append(b["audit"])
                for r, t in zip(b["roles"], b["texts"], strict=True):
                    hashed.update(("" if empty else "\n").encode() + f"{r}:{t}".encode())
                    empty = False
            yield _arrow(out, kinds, _DIGEST)
        if now is not None:
            yield _arrow([row()], kinds, _DIGEST)

    schema = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    return repaired.where("not open").mapInArrow(run, schema).union(repaired.where("open").repartition("c").sortWithinPartitions("c", "part", "seq").mapInArrow(run, schema))
