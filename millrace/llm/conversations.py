"""Conversation structure repair: error-correcting Earley parsing of turns by a weighted grammar of roles.

A conversation should be nothing, or an optional system turn and then pairs of a user's and an assistant's turn:

    Talk -> (nothing) | Pairs | s Pairs        Pairs -> u a | Pairs u a

Each production for a terminal has erring forms: the row is kept (cost 0), its role is changed to the terminal (3), a row
without text is inserted for the terminal (3), or a row is deleted (4, the only choice for blank rows and repetitions).
Rows that end in the middle of a sentence cost 3 more if they stay. The chart has a set of items for each number of rows
read; an item, a production with a dot and the set that it began in, keeps the least (cost, audit), where the audit is
the edits' initials: Keep, Rerole, Delete, Insert. As Pairs is left-recursive, a set has a fixed number of items. Audits
of equal cost over the same rows are never one the beginning of the other, so the least of the whole is made of the least
of its parts. Inserted rows come before the row that they are read with, or at the end.

Each row is read once, after a shuffle by conversation. A conversation of more than PIECE_ROWS rows or PIECE_BYTES bytes
is cut into pieces by range, and each piece is parsed from every state that a parse can be in where it begins; the pieces'
charts, some numbers for each, are joined in order, and each piece is then given its edits. So no task holds a long
conversation, whatever share of all rows it has.

Defined cases: rows without a conversation's id form one conversation; rows without a turn come first; equal turns go by
role and text, nulls first, repeated rows are repetitions; a null role or text is one space; roles are known by their
first letter; empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, shuffle_partitions, worker_cache

#: Rows and bytes of a conversation that one task parses in one piece.
PIECE_ROWS, PIECE_BYTES = 10_000, 64 << 20
#: Long conversations whose ids are broadcast, at most; beyond, the same join shuffles.
MOST_BROADCAST = 500_000
#: Symbols of a parse that is kept for the next conversation with the same ones, and parses kept by a worker, at most.
KEPT_SYMBOLS, KEPT_PARSES = 64, 1 << 16

KEEP, REROLE, DELETE, INSERT = "KRDI"
COST = {KEEP: 0, REROLE: 3, DELETE: 4, INSERT: 3}
TRUNCATED_COST = 3
#: Terminals that a row may be given, or inserted for.
FREE = {"u": "user", "a": "assistant"}
#: Head and Pairs keep all productions left-recursive, so that every item begins in the first set.
GRAMMAR = (("Talk", ()), ("Talk", ("Pairs",)), ("Pairs", ("Head", "u", "a")), ("Pairs", ("Pairs", "u", "a")), ("Head", ()), ("Head", ("s",)))
LEGAL = ("su", "ua", "au")
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
#: Symbols of rows: the role's initial, `-` for others; upper case and `_` for truncated ones; `x` for those that must go.
GONE, OTHER, OTHER_TRUNCATED = "x", "-", "_"

Item = tuple[int, int]  # a production and its dot
Set = dict[Item, tuple[int, str]]  # least (cost, audit)

_ITEMS = [(p, dot) for p, (_, right) in enumerate(GRAMMAR) for dot in range(len(right) + 1)]
_NEXT = {(p, dot): (GRAMMAR[p][1][dot] if dot < len(GRAMMAR[p][1]) else None) for p, dot in _ITEMS}
#: Items of the first set that wait for a symbol that is not a terminal.
_WAITING = {x: [(p, 1) for p, (_, right) in enumerate(GRAMMAR) if right[:1] == (x,)] for x in ("Pairs", "Head", "Talk")}
_START: Set = {(p, 0): (0, "") for p in range(len(GRAMMAR)) if _NEXT[p, 0] not in ("Pairs", "Head")}


def _improved(chart_set: Set, item: Item, value: tuple[int, str]) -> bool:
    if item in chart_set and chart_set[item] <= value:
        return False
    chart_set[item] = value
    return True


def closed(chart_set: Set) -> Set:
    """The set with all that follows without reading a row: completed productions and inserted rows."""
    out, todo = dict(chart_set), list(chart_set)
    while todo:
        item = todo.pop()
        cost, audit = out[item]
        symbol = _NEXT[item]
        if symbol is None:
            value, reached = (cost, audit), _WAITING[GRAMMAR[item[0]][0]]
        elif symbol in FREE:
            value, reached = (cost + COST[INSERT], audit + INSERT), [(item[0], item[1] + 1)]
        else:
            continue
        todo += [x for x in reached if _improved(out, x, value)]
    return out


def scanned(chart_set: Set, symbol: str) -> Set:
    """The items after reading a row of this symbol."""
    out: Set = {}
    low = {OTHER_TRUNCATED: OTHER}.get(symbol, symbol.lower())
    more = TRUNCATED_COST * (low != symbol)
    for item, (cost, audit) in chart_set.items():
        wanted = _NEXT[item]
        if wanted is None and GRAMMAR[item[0]][0] != "Talk" or wanted in _WAITING:
            continue
        _improved(out, item, (cost + COST[DELETE], audit + DELETE))
        if wanted is None or symbol == GONE:
            continue
        after = (item[0], item[1] + 1)
        if low == wanted:
            _improved(out, after, (cost + COST[KEEP] + more, audit + KEEP))
        if wanted in FREE:
            _improved(out, after, (cost + COST[REROLE] + more, audit + REROLE))
    return out


def parsed(chart_set: Set, symbols: str) -> Set:
    """The items after reading all symbols, before what may follow them."""
    for symbol in symbols:
        chart_set = scanned(closed(chart_set), symbol)
    return chart_set


def finished(chart_set: Set) -> tuple[int, str]:
    return min(v for (p, dot), v in closed(chart_set).items() if GRAMMAR[p][0] == "Talk" and _NEXT[p, dot] is None)


def best_edits(symbols: str) -> tuple[int, str]:
    """The least (cost, audit) of a whole conversation."""
    if len(symbols) > KEPT_SYMBOLS:
        return finished(parsed(_START, symbols))
    kept = worker_cache("edits")
    if symbols not in kept:
        if len(kept) >= KEPT_PARSES:
            kept.clear()
        kept[symbols] = finished(parsed(_START, symbols))
    return kept[symbols]


def symbol_of(role: str, fault: str | None) -> str:
    if fault in ("blank", "duplicate"):
        return GONE
    first = role[:1]
    if first not in ("s", "u", "a"):
        return OTHER_TRUNCATED if fault else OTHER
    return first.upper() if fault else first


def roles_after(audit: str, kept: Iterator[str]) -> Iterator[str | None]:
    """For each edit the role that its row has then: None if it is deleted. kept: the roles of the rows, in order."""
    expected, first = "u", True
    for edit in audit:
        role = None if edit == INSERT else next(kept)
        if edit == DELETE:
            yield None
        elif edit == KEEP and first and role[:1] == "s":
            first = False
            yield role
        else:
            yield role if edit == KEEP else FREE[expected]
            expected, first = "a" if expected == "u" else "u", False


def fault_of(role: str, text: str, seen: set) -> str | None:
    """The first fault of a row; `seen` has the rows before it and gets this one."""
    again = (role, text) in seen
    seen.add((role, text))
    bare = text.rstrip(BLANKS)
    return "blank" if not bare else "duplicate" if again else None if bare[-1] in ".!?" else "truncated"


def illegal_pairs(initials: list[str]) -> int:
    return sum(x + y not in LEGAL for x, y in zip(initials, initials[1:]))


@dataclass
class Repair:
    faults: list[str | None]
    cost: int
    audit: str
    turns: list[tuple]  # of each edit: turn, role before, role after or None, text, edit, fault


def repaired(rows: list[tuple]) -> Repair:
    """One conversation's (turn, role, text) in order, edited at the least cost."""
    seen: set = set()
    faults = [fault_of(role, text, seen) for _, role, text in rows]
    cost, audit = best_edits("".join(symbol_of(role, fault) for (_, role, _), fault in zip(rows, faults)))
    turns, own = [], zip(rows, faults)
    for edit, role in zip(audit, roles_after(audit, iter([r[1] for r in rows]))):
        (turn, before, text), fault = ((None, None, ""), None) if edit == INSERT else next(own)
        turns.append((turn, before, role, text, edit, fault))
    return Repair(faults, cost, audit, turns)


_ORDER = ["conv", "turn", "role", "text"]
_SUMMARY = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, digest string"
_EDITS = "at bigint, turn bigint, role string, text string, edit string, fault string, role_before string"


def prepared(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", is_row: Column | None = None) -> DataFrame:
    """conv, turn, role, text and real: rows with real false only say that there is such a conversation."""
    real = F.lit(True) if is_row is None else F.coalesce(is_row, F.lit(False))
    return rows.select(F.col(key).alias("conv"), F.when(real, F.col(turn)).cast("bigint").alias("turn"), *(F.when(real, F.coalesce(F.col(c).cast("string"), F.lit(" "))).otherwise("").alias(n) for c, n in ((role, "role"), (text, "text"))), real.alias("real"))


def _parts(rows: DataFrame, piece_rows: int, piece_bytes: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of conversations that a task can hold, and of the others, if there are any."""
    sizes = rows.groupBy("conv").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    long = saved(sizes.filter((F.col("n") > piece_rows) | (F.col("bytes") > piece_bytes)).select(F.col("conv").alias("long")))  # not more than all rows / piece_rows and all bytes / piece_bytes
    n = long.count()
    if not n:
        return rows, None
    few = F.broadcast(long) if n <= MOST_BROADCAST else long
    same = F.col("conv").eqNullSafe(F.col("long"))
    return rows.join(few, same, "left_anti"), rows.join(few, same, "left_semi")


def _each_conversation(of: Callable[[object, list[tuple]], list[tuple]], names: list[str], kinds: list[pa.DataType]):
    """A function over batches sorted by conversation: of(conv, rows) gives the rows to return for each of them."""

    def run(batches):
        conv, held, there, out = None, [], False, []

        def flush(final: bool = False):
            nonlocal out
            if out and (final or len(out) >= 2000):
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)
                out = []

        for batch in batches:
            for c, turn, role, text, real in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if there and c != conv:
                    out += of(conv, held)
                    held = []
                    yield from flush()
                conv, there = c, True
                if real:
                    held.append((turn, role, text))
        if there:
            out += of(conv, held)
        yield from flush(final=True)

    return run


def _sorted(rows: DataFrame) -> DataFrame:
    return rows.select(*_ORDER, "real").repartition(shuffle_partitions(rows.sparkSession), "conv").sortWithinPartitions(*_ORDER)


def _kinds(rows: DataFrame, schema: str) -> tuple[str, list[str], list[pa.DataType]]:
    from pyspark.sql.pandas.types import to_arrow_type

    whole = f"conv {rows.schema['conv'].dataType.simpleString()}, {schema}"
    empty = rows.sparkSession.createDataFrame([], whole)
    return whole, empty.columns, [to_arrow_type(f.dataType) for f in empty.schema.fields]


def summary(rows: DataFrame, piece_rows: int = PIECE_ROWS, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """Of prepared rows, for each conv: gaps in its turns, blank, duplicate and truncated rows, illegal successions, and the
    repair's cost, audit and digest (SHA-256 of its `role:text`, joined by newlines)."""
    schema, names, kinds = _kinds(rows, _SUMMARY)

    def of(conv, own):
        import hashlib

        found = repaired(own)
        turns = {t for t, _, _ in own if t is not None}
        kept = "\n".join(f"{role}:{text}" for _, _, role, text, edit, _ in found.turns if edit != DELETE)
        n = [found.faults.count(x) for x in ("blank", "duplicate", "truncated")]
        return [(conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *n, illegal_pairs([r[:1] for _, r, _ in own]), found.cost, found.audit, hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest())]

    short, long = _parts(rows, piece_rows, piece_bytes)
    out = _sorted(short).mapInArrow(_each_conversation(of, names, kinds), schema)
    return out if long is None else out.unionByName(_long_summary(long, piece_rows, piece_bytes))


def edits(rows: DataFrame, piece_rows: int = PIECE_ROWS, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """Of prepared rows, each edit in its conv's order `at`: turn, role and text after it (role null: deleted), the edit's
    initial, the row's fault, and the role before. The repaired conversation is the rows whose edit is not D."""
    schema, names, kinds = _kinds(rows, _EDITS)

    def of(conv, own):
        return [(conv, k, turn, role, text, edit, fault, before) for k, (turn, before, role, text, edit, fault) in enumerate(repaired(own).turns)]

    short, long = _parts(rows, piece_rows, piece_bytes)
    out = _sorted(short).mapInArrow(_each_conversation(of, names, kinds), schema)
    return out if long is None else out.unionByName(_Long(long, piece_rows, piece_bytes).edits())


_KERNEL = sorted({item for item in _ITEMS if _NEXT[item] in ("s", "u", "a") or item[1] == len(GRAMMAR[item[0]][1])})
_BEGIN = -1  # the entry of a conversation's first piece, and the exit of its last one


class _Long:
    """Conversations that are parsed by pieces: rows in order are cut by ranges into pieces, and no step holds more than a
    piece's rows, or some numbers for each piece of a conversation."""

    def __init__(self, rows: DataFrame, piece_rows: int, piece_bytes: int):
        self.spark = spark = rows.sparkSession
        numbered = saved(rows.filter("real").select(*_ORDER).withColumn("tie", F.monotonically_increasing_id()))
        total, size = numbered.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
        self.ids = rows.select("conv").distinct()
        self.pieces = 2 * (total // piece_rows + size // piece_bytes) + 1
        ranged = numbered.repartitionByRange(self.pieces, *_ORDER, "tie").sortWithinPartitions(*_ORDER, "tie")
        self.rows = saved(ranged.select(*_ORDER, F.spark_partition_id().alias("piece"), F.monotonically_increasing_id().alias("at")))
        last = F.right(F.rtrim(F.col("text"), F.lit(BLANKS)), F.lit(1))
        text_key = F.sha2("text", 256)
        first = self.rows.groupBy("conv", "role", text_key.alias("key")).agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
        marked = self.rows.select("conv", "piece", "at", "turn", "role", last.alias("last")).join(first, "at", "left")
        fault = F.when(F.col("last") == "", "blank").when(F.col("first").isNull(), "duplicate").when(~F.col("last").isin(".", "!", "?"), "truncated")
        light = marked.withColumn("fault", fault).select("conv", "piece", "at", "turn", "role", "fault")
        by_piece = light.repartition(min(self.pieces, 1 << 16), "piece").sortWithinPartitions("piece", "at")
        self.light = saved(by_piece)
        self.chosen = saved(self._composed())

    def _by_piece(self, of, schema: str, rows: DataFrame) -> DataFrame:
        """of(conv, piece, rows) for the rows, in order, of each conversation's share of a piece; a piece's rows are few."""
        whole, names, kinds = _kinds(self.rows, schema)

        def run(key, table):
            conv, piece = (k.as_py() for k in key)
            out = of(conv, piece, sorted(table.to_pylist(), key=lambda r: r["at"]))
            return pa.Table.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)

        return rows.groupBy("conv", "piece").applyInArrow(run, whole)

    def _composed(self) -> DataFrame:
        """For each piece of each conversation where its parse begins and ends, and the conversation's cost."""

        def charts(conv, piece, rows):
            symbols = "".join(symbol_of(r["role"], r["fault"]) for r in rows)
            found = [(e, x, cost, audit) for e, start in enumerate([_START, *({k: (0, "")} for k in _KERNEL)]) for x, (cost, audit) in parsed(start, symbols).items()]
            rank = {a: k for k, a in enumerate(sorted({f[3] for f in found}))}
            initials = [r["role"][:1] for r in rows]
            table = [{"entry": e - 1, "exit": _KERNEL.index(x), "cost": cost, "rank": rank[audit]} for e, x, cost, audit in found]
            return [(conv, piece, table, initials[0], initials[-1], illegal_pairs(initials))]

        schema = "piece int, chart array<struct<entry:int,exit:int,cost:bigint,rank:int>>, first string, last string, illegal bigint"
        tables = self._by_piece(charts, schema, self.light)
        whole, names, kinds = _kinds(self.rows, "piece int, entry int, exit int, cost bigint, illegal bigint")

        def composed(key, table):
            conv, rows = key[0].as_py(), sorted(table.to_pylist(), key=lambda r: r["piece"])
            reached = {_BEGIN: (0, 0, ())}  # by item: cost, order of the audit among all, path
            for row in rows:
                best: dict = {}
                for c in row["chart"]:
                    if c["entry"] in reached:
                        cost, order, path = reached[c["entry"]]
                        value = (cost + c["cost"], (order, c["rank"]), (path, c["entry"]))
                        if c["exit"] not in best or value[:2] < best[c["exit"]][:2]:
                            best[c["exit"]] = value
                order = {o: k for k, o in enumerate(sorted({v[1] for v in best.values()}))}
                reached = {x: (cost, order[o], path) for x, (cost, o, path) in best.items()}
            cost, _, _, item = min((v[0] + c, v[1], rest, x) for x, v in reached.items() for c, rest in [_finish(x)] if c is not None)
            path, entries = reached[item][2], []
            while path:
                path, entry = path
                entries.append(entry)
            entries.reverse()
            exits = [*entries[1:], item]
            illegal = sum(r["illegal"] for r in rows) + illegal_pairs_between(rows)
            out = [(conv, r["piece"], e, x, cost, illegal) for r, e, x in zip(rows, entries, exits)]
            return pa.Table.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)

        return tables.groupBy("conv").applyInArrow(composed, whole)

    def edits(self) -> DataFrame:
        last = self.chosen.groupBy(F.col("conv").alias("whose")).agg(F.max("piece").alias("last"))
        chosen = self.chosen.join(last, F.col("conv").eqNullSafe(F.col("whose")), "left").select("conv", "piece", "entry", "exit", (F.col("piece") == F.col("last")).alias("ends"))
        both = self.light.alias("l").join(chosen.alias("c"), (F.col("l.piece") == F.col("c.piece")) & F.col("l.conv").eqNullSafe(F.col("c.conv"))).select("l.*", "entry", "exit", "ends")

        def of(conv, piece, rows):
            """Each row's edits, which end with its own, but for those after the last row; and the roles after it."""
            entry, exit_, ends = rows[0]["entry"], rows[0]["exit"], rows[0]["ends"]
            start = _START if entry == _BEGIN else {_KERNEL[entry]: (0, "")}
            audit = parsed(start, "".join(symbol_of(r["role"], r["fault"]) for r in rows))[_KERNEL[exit_]][1]
            own, out, k = "", [], 0
            for edit in audit:
                own += edit
                if edit != INSERT:
                    out.append((conv, rows[k]["at"], own, ""))
                    own, k = "", k + 1
            if ends and out:
                out[-1] = (*out[-1][:3], _finish(exit_)[1])
            # the first role that is due in this piece follows from its entry
            due = _due(entry)
            return [(c, at, edits, after, *step) for (c, at, edits, after), step in zip(out, _steps(out, due, [r["role"] for r in rows]))]

        told = self._by_piece(of, "at bigint, edits string, after string, due string", both)
        rows = self.rows.join(told.select("at", "edits", "after", "due"), "at").join(self.light.select("at", "fault"), "at")
        # one row for each edit; `due` is the role's initial that the first of them gives
        every = rows.select("conv", "at", "turn", "role", "text", "fault", F.posexplode(F.split(F.concat("edits", "after"), "")).alias("k", "edit"), F.length("edits").alias("own"), "due")
        mine = F.col("k") == F.col("own") - 1
        initial = F.substring(F.col("due"), F.col("k") + 1, F.lit(1))
        named = F.when(initial == "u", FREE["u"]).when(initial == "a", FREE["a"])
        role = F.when(F.col("edit") == KEEP, F.col("role")).when(F.col("edit") != DELETE, named)
        at = F.col("at") * 8 + F.col("k")
        return every.select("conv", at.alias("at"), F.when(mine, F.col("turn")).alias("turn"), role.alias("role"), F.when(mine, F.col("text")).otherwise("").alias("text"), "edit", F.when(mine, F.col("fault")).alias("fault"), F.when(mine, F.col("role")).alias("role_before"))

    def summary(self) -> DataFrame:
        done = saved(self.edits())
        schema, names, kinds = _kinds(self.rows, "audit string, digest string")

        def digests(batches):
            """Of rows in order: one conversation after another, a batch at a time."""
            import hashlib

            conv, there, state, audit, any_kept, out = None, False, None, [], False, []
            for batch in batches:
                for c, role, text, edit in zip(*(batch.column(i).to_pylist() for i in range(4))):
                    if not there or c != conv:
                        if there:
                            out.append((conv, "".join(audit), state.hexdigest()))
                        conv, there, state, audit, any_kept = c, True, hashlib.sha256(), [], False
                    audit.append(edit)
                    if edit != DELETE:
                        state.update((("\n" if any_kept else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
                        any_kept = True
            if there:
                out.append((conv, "".join(audit), state.hexdigest()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)

        text = done.repartition(shuffle_partitions(self.spark), "conv").sortWithinPartitions("conv", "at").select("conv", "role", "text", "edit").mapInArrow(digests, schema)
        count = lambda x: F.count_if(F.col("fault") == x).alias(x)
        faults = self.light.groupBy("conv").agg(*map(count, ("blank", "duplicate", "truncated")))
        turns = self.light.filter("turn is not null").select("conv", "turn").distinct().groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
        costs = self.chosen.groupBy("conv").agg(F.max("cost").alias("cost"), F.max("illegal").alias("illegal"))
        out = self.ids
        for more in (text, faults, turns, costs):
            own = more.withColumnRenamed("conv", "__conv")
            out = out.join(own, F.col("conv").eqNullSafe(F.col("__conv")), "left").drop("__conv")
        zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
        return out.select("conv", *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("digest"))


def illegal_pairs_between(rows: list[dict]) -> int:
    """Illegal successions of the last row of a piece and the first of the next one."""
    return sum(x["last"] + y["first"] not in LEGAL for x, y in zip(rows, rows[1:]))


def _finish(item: int) -> tuple[int | None, str]:
    """What it costs to end a conversation in that item, and the rows inserted for it; None where it can't end."""
    try:
        return finished({_KERNEL[item]: (0, "")})
    except ValueError:
        return None, ""


def _due(entry: int) -> str:
    """The role's initial that comes next in the repaired conversation; s where a system turn may come before the user's."""
    if entry == _BEGIN:
        return "s"
    p, dot = _KERNEL[entry]
    if GRAMMAR[p][0] == "Talk":
        return "u"
    if GRAMMAR[p][0] == "Head":
        return "s" if _NEXT[p, dot] == "s" else "u"
    return {"u": "u", "a": "a", None: "u"}[_NEXT[p, dot]]


def _steps(edited: list[tuple], due: str, roles: list[str]) -> Iterator[tuple[str]]:
    """For each row the initials that its edits give, one for each, `-` for a deleted row."""
    for (_, _, edits, after), role in zip(edited, roles):
        out = ""
        for edit in edits + after:
            if edit == DELETE:
                out += "-"
            elif edit == KEEP and due == "s" and role[:1] == "s":
                out, due = out + "s", "u"
            else:
                own = "u" if due == "s" else due
                out, due = out + own, "a" if own == "u" else "u"
        yield (out,)


def _long_summary(rows: DataFrame, piece_rows: int, piece_bytes: int) -> DataFrame:
    return _Long(rows, piece_rows, piece_bytes).summary()


def damaged(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Prepared rows of conversations that are damaged by a hash of `key:turn` modulo 20: 0 drops a row, 1 takes its text, 2
    its full stops, 3 repeats it, 4 makes it the user's. Nulls are one space."""
    spelled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spelled(key), F.lit(":"), spelled(turn)).cast("binary")) % 20
    rows = rows.select(F.col(key).alias("conv_id"), F.col(turn).alias("turn"), spelled(role).alias("role"), spelled(text).alias("text"), kind.alias("kind"))
    kind = F.col("kind")
    now = F.when(kind.isin(0, 1), "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    whose = F.when(kind == 4, "user").otherwise(F.col("role"))
    every = rows.select("conv_id", "turn", whose.alias("role"), now.alias("text"), (kind != 0).alias("real"), F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    return prepared(every, is_row=F.col("real"))
