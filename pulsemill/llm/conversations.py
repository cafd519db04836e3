"""Conversation structure repair with a suffix-shared automaton.

Each row of a conversation has a symbol: its role's initial and its first
fault.  The symbols of a conversation form its signature.  The cheapest edits
that turn a signature into ``(s?(ua)+)?`` are found from its end: what the
rest costs, and which edits it takes, depends on the rest of the signature
and the grammar's state alone.  Conversations are therefore sorted by their
reversed signatures, so that equal suffixes are neighbours; each suffix is
one node, worked out once when the sort first comes to it, and nodes that
agree in everything but a constant cost are one class of the automaton.

A node holds, for each grammar state, the edit of its row, the state after
it, and the rank of the audit that begins there among those of the four
states.  Edits of a row are a prefix-free code, so ranks are enough to
compare audits: no audit string is kept in a node.

A conversation of any size works: its rows are sorted by ranges, their
symbols joined one byte a row, and its texts stream past their edits in
chunks of ``CHUNK`` turns.  Only the SHA-256 of a conversation of several
chunks is a chain that one task computes, in bounded memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import RESERVED, col, stored

#: Characters that leave a text blank; those that may end a sentence.
WHITE, ENDS = r"\x20\x09-\x0D", ".!?"
KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1
CHUNK_BITS = 16

#: Grammar states: 0 nothing yet, 1 after s, 2 after u, 3 after a.
MOVES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: What an insertion or a new role gives in each state, and the inserts that end a conversation.
FILL = {q: c for (q, c) in MOVES if c != "s"}
TAILS = {0: "", 1: "ua", 2: "a", 3: ""}
ROLES = {"u": "user", "a": "assistant"}
FAULTS = ("none", "blank", "duplicate", "truncated")
#: What a row's copies are, each a letter of its own.
AGAIN = ("blank again", "duplicate again")
_INITIALS = "suao"
_MOST_INSERTS = 2


def symbol_of(initial: str, fault: str) -> str:
    """A letter for a role's initial (s, u, a; o for any other) and a fault."""
    return chr(65 + (FAULTS + AGAIN).index(fault) * 4 + _INITIALS.index(initial))


def _letters(*faults: str) -> str:
    return "".join(symbol_of(i, f) for f in faults for i in _INITIALS)


def _parts(symbol: str) -> tuple[str, str]:
    n = ord(symbol) - 65
    return _INITIALS[n % 4], FAULTS[n // 4]


def _merged(signature: Column) -> Column:
    """Rows that must go are alike, whatever their role."""
    gone = _letters("blank", "duplicate", *AGAIN)
    return F.translate(signature, gone, gone[0] * len(gone))


#: Every edit of a row: the state before it, the inserts ahead of it and what happens to it; one letter each.
EDITS = [(q, n, act) for q in range(4) for n in range(_MOST_INSERTS + 1) for act in "DKR"]
_CODE = {e: chr(48 + i) for i, e in enumerate(EDITS)}


class Automaton:
    """Classes of suffixes.  A class is (cost, audit rank) by state, less the least cost, with the edits chosen."""

    def __init__(self):
        tails = sorted(set(len(t) for t in TAILS.values()))
        self.values = [tuple((INSERT * len(TAILS[q]), tails.index(len(TAILS[q]))) for q in range(4))]
        self.choices: list[tuple | None] = [None]
        self.known: dict[tuple[str, int], int] = {}
        self.same: dict[tuple, int] = {}

    def step(self, symbol: str, rest: int) -> int:
        """The class of a row of this symbol before a suffix of class ``rest``."""
        found = self.known.get((symbol, rest))
        if found is None:
            found = self.known[symbol, rest] = self._solved(symbol, rest)
        return found

    def _solved(self, symbol: str, rest: int) -> int:
        initial, fault = _parts(symbol)
        must_go, extra = fault in ("blank", "duplicate"), CUT if fault == "truncated" else 0
        best = []
        for q in range(4):
            options, at, spent, ahead = [], q, 0, ""
            for n in range(_MOST_INSERTS + 1):
                if n:
                    at, spent, ahead = MOVES[at, FILL[at]], spent + INSERT, ahead + "I"
                acts = [("D", DELETE, at)]
                if not must_go:
                    if (at, initial) in MOVES:
                        acts.append(("K", KEEP + extra, MOVES[at, initial]))
                    acts.append(("R", REROLE + extra, MOVES[at, FILL[at]]))
                for act, cost, to in acts:
                    more, rank = self.values[rest][to]
                    options.append((spent + cost + more, ahead + act, rank, n, act, to))
            best.append(min(options))
        audits = sorted({b[1:3] for b in best})
        least = min(b[0] for b in best)
        value = tuple((b[0] - least, audits.index(b[1:3])) for b in best)
        choice = tuple((_CODE[q, b[3], b[4]], b[5]) for q, b in enumerate(best))
        key = (value, choice)
        if key not in self.same:
            self.same[key] = len(self.values)
            self.values.append(value)
            self.choices.append(choice)
        return self.same[key]


#: Audit letters and cost of each edit, without the cost of keeping a truncated row.
_SAID = {_CODE[e]: "I" * e[1] + e[2] for e in EDITS}
_COST = {_CODE[e]: INSERT * e[1] + {"D": DELETE, "K": KEEP, "R": REROLE}[e[2]] for e in EDITS}
_IS_CUT = set(_letters("truncated"))
_IS_AGAIN = set(_letters(*AGAIN))

_PLAN = pa.struct([("part", pa.int64()), ("codes", pa.list_(pa.string())), ("tail", pa.int32())])


def _plans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Plans of conversations sorted by their reversed merged signature.

    For each conversation a row with cost and audit, and one for each of its
    parts with the code of each row's edit; the last part has the tail.
    """
    machine, before, nodes, last = Automaton(), None, [], None
    for batch in batches:
        names = {n: i for i, n in enumerate(batch.schema.names)}
        signatures, parts = (batch.column(names[n]).to_pylist() for n in ("signature", "parts"))
        take, costs, audits, plans = [], [], [], []
        for i, reverse in enumerate(batch.column(names["reverse"]).to_pylist()):
            if reverse != before:
                del nodes[len(commonprefix((before or "", reverse))):]
                for symbol in reverse[len(nodes):]:
                    nodes.append(machine.step(symbol, nodes[-1] if nodes else 0))
                before, q, codes, cost = reverse, 0, [], 0
                for node, symbol in zip(reversed(nodes), reversed(reverse)):
                    code, q = machine.choices[node][q]
                    codes.append(code)
                    cost += _COST[code] + (symbol in _IS_CUT and _SAID[code][-1] != "D")
                audit = "".join(_SAID[c] for c in codes) + "I" * len(TAILS[q])
                last = (codes, cost + INSERT * len(TAILS[q]), audit, len(TAILS[q]))
            codes, cost, audit, tail = last
            take.append(i)
            costs.append(cost)
            audits.append(audit)
            plans.append(None)
            at = 0
            for k, part in enumerate(parts[i]):
                end = at + part["n"]
                firsts = [c for c, letter in zip(codes[at:end], signatures[i][at:end]) if letter not in _IS_AGAIN]
                take.append(i)
                costs.append(None)
                audits.append(None)
                plans.append({"part": part["part"], "codes": firsts, "tail": tail if k == len(parts[i]) - 1 else 0})
                at = end
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(names[n]).take(pa.array(take, pa.int64())) for n in ("c", "alone")],
             pa.array(costs, pa.int64()), pa.array(audits, pa.string()), pa.array(plans, _PLAN)],
            names=["c", "alone", "cost", "audit", "plan"])


def _counted(*faults: str) -> Column:
    signature = F.col("signature")
    return (F.length(signature) - F.length(F.translate(signature, _letters(*faults), ""))).cast("long")


def _illegal(signature: Column) -> Column:
    """Neighbouring rows whose initials are none of su, ua, au; the letters stand for initials in fours."""
    kinds = FAULTS + AGAIN
    plain = F.translate(signature, _letters(*kinds), _INITIALS * len(kinds))
    legal = [F.regexp_count(plain, F.lit(p)) for p in ("s(?=u)", "u(?=a)", "a(?=u)")]
    return (F.greatest(F.length(plain) - 1, F.lit(0)) - legal[0] - legal[1] - legal[2]).cast("long")


def _source(convs: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """c (the id, wrapped so that null equals null), turn, role, text, digest of role and text, chunk of turns."""
    def filled(name: str) -> Column:
        return F.coalesce(col(name).cast("string"), F.lit(" "))

    rows = convs.select(F.struct(col(id_col).alias("id")).alias("c"), col(turn_col).cast("long").alias("turn"),
                        filled(role_col).alias("role"), filled(text_col).alias("text"))
    return rows.withColumns({"same": F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))),
                             "chunk": F.coalesce(F.shiftright("turn", CHUNK_BITS), F.lit(-(1 << 62)))})


def _order() -> list[Column]:
    """The order of a conversation's rows: by turn, nulls first, then role and digest; repeated rows are neighbours."""
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("same")]


def _keyed(source: DataFrame) -> DataFrame:
    """Rows without texts, repeated ones as one with their number ``m``: signature letters, and place along the order."""
    white = f"[^{WHITE}]"
    rows = source.withColumns({
        "blank": ~F.col("text").rlike(white),
        "cut": ~F.col("text").rlike(rf"[{ENDS}][{WHITE}]*\z")})
    keys = stored(rows.groupBy("c", "turn", "role", "same").agg(
        F.count(F.lit(1)).alias("m"), F.first("blank").alias("blank"), F.first("cut").alias("cut"), F.first("chunk").alias("chunk")), "turns")
    at = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    # Most (conversation, role, text) occur at one turn; only the others have duplicates.
    again = (keys.groupBy("c", "same").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
             .withColumnsRenamed({"c": "c2", "same": "same2"}))
    marked = keys.join(again, (F.col("c") == F.col("c2")) & (F.col("same") == F.col("same2")), "left")
    initial = F.instr(F.lit(_INITIALS[:3]), F.substring("role", 1, 1))
    initial = F.when((initial > 0) & (F.length("role") > 0), initial - 1).otherwise(3)
    later = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(at)
    fault = F.when(F.col("blank"), 1).when(later, 2).when(F.col("cut"), 3).otherwise(0)
    again_fault = F.when(F.col("blank"), 4).otherwise(5)
    letter = lambda f: F.char(F.lit(65) + f * 4 + initial)
    symbols = F.concat(letter(fault), F.repeat(letter(again_fault), F.col("m").cast("int") - 1))
    placed = marked.select("c", "turn", "role", "same", "chunk", symbols.alias("symbols"))
    placed = placed.repartitionByRange("c", *_order()).sortWithinPartitions("c", *_order())
    return stored(placed.withColumn("place", F.monotonically_increasing_id()).withColumn("part", F.shiftright("place", 33)), "placed")


def _planned(keys: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The conversations with their signatures, their plans, and their pieces (rows of one sorted part, in order)."""
    row = F.struct("place", "turn", "role", "same", "chunk", "symbols")
    pieces = stored(keys.groupBy("c", "part").agg(F.array_sort(F.collect_list(row)).alias("rows")), "pieces")  # rows of one task
    symbols = F.array_join(F.transform("rows", lambda r: r["symbols"]), "")
    whole = pieces.select("c", F.struct("part", symbols.alias("symbols")).alias("piece")).groupBy("c").agg(
        F.array_sort(F.collect_list("piece")).alias("parts"))  # a byte a row, as in the audit
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long")
    turns = keys.groupBy("c").agg(gaps.alias("gaps"), (F.min("chunk") == F.max("chunk")).alias("alone"))
    convs = stored(whole.join(turns, "c").select(
        "c", "gaps", "alone", F.transform("parts", lambda p: F.struct(p["part"].alias("part"), F.length(p["symbols"]).alias("n"))).alias("parts"),
        F.array_join(F.transform("parts", lambda p: p["symbols"]), "").alias("signature")), "signatures")
    ordered = (convs.withColumn("reverse", F.reverse(_merged(F.col("signature"))))
               .repartitionByRange("reverse", "c").sortWithinPartitions("reverse", "c"))
    kind = convs.schema["c"].dataType.simpleString()
    plans = ordered.mapInArrow(_plans, f"c {kind}, alone boolean, cost long, audit string, plan struct<part: bigint, codes: array<string>, tail: int>")
    return convs, stored(plans, "plans"), pieces


def _edits(plans: DataFrame, pieces: DataFrame) -> DataFrame:
    """A code for each row of the pieces; the last row of a conversation has its tail."""
    cut = plans.filter("plan is not null").select("c", "alone", "plan.*")
    rows = (pieces.join(cut, ["c", "part"])
            .select("c", "alone", "tail", F.size("rows").alias("n"), F.posexplode(F.arrays_zip("rows", "codes")).alias("i", "r")))
    return rows.select("c", "alone", "r.rows.turn", "r.rows.role", "r.rows.same", "r.rows.chunk", "r.codes",
                       F.when(F.col("i") == F.col("n") - 1, F.col("tail")).otherwise(0).alias("tail"))


_ROW = ("c", "alone", "chunk", "turn", "edit", "role", "text")


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repaired rows of a stream sorted by conversation and order, in which the edit of a row comes ahead of its texts."""
    code, tail, alone = None, 0, None
    for batch in batches:
        at = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        new, tails, lone, roles, texts = (at[n].to_pylist() for n in ("codes", "tail", "alone", "role", "text"))
        take, out = [], []
        for i, fresh in enumerate(new):
            if fresh is not None:
                code, tail, alone = fresh, tails[i], lone[i]
                continue
            if code is None:  # a repeated row: its copies go
                continue
            q, inserts, act = EDITS[ord(code) - 48]
            rows = []
            for _ in range(inserts):
                rows.append(("I", ROLES[FILL[q]], ""))
                q = MOVES[q, FILL[q]]
            if act != "D":
                rows.append((act, roles[i] if act == "K" else ROLES[FILL[q]], texts[i]))
            rows += [("I", ROLES[r], "") for r in "ua"[2 - tail:]]
            take += [i] * len(rows)
            out += [(alone, *r) for r in rows]
            code = None
        index = pa.array(take, pa.int64())
        alones, edits, said, words = zip(*out) if out else ((),) * 4
        yield pa.RecordBatch.from_arrays(
            [at["c"].take(index), pa.array(alones, pa.bool_()), at["chunk"].take(index), at["turn"].take(index),
             pa.array(edits, pa.string()), pa.array(said, pa.string()), pa.array(words, pa.string())], names=list(_ROW))


def _repaired(source: DataFrame, edits: DataFrame) -> DataFrame:
    """Repaired rows, in order within the partitions; all rows of a chunk are in one."""
    order = ["c", "chunk", *_order(), F.col("codes").asc_nulls_last()]
    both = edits.withColumn("text", F.lit(None).cast("string")).unionByName(
        source.withColumns({"codes": F.lit(None).cast("string"), "tail": F.lit(None).cast("int"), "alone": F.lit(None).cast("boolean")}))
    kind = source.schema["c"].dataType.simpleString()
    return both.repartition("c", "chunk").sortWithinPartitions(*order).mapInArrow(
        _applied, f"c {kind}, alone boolean, chunk long, turn long, edit string, role string, text string")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """repaired_sha256 of the conversations of one chunk; the lines of the others, numbered."""
    key, sha, no = None, None, 0

    def batch_of(kind, rows):
        keys, alone, chunk, numbers, texts = zip(*rows) if rows else ((),) * 5
        return pa.RecordBatch.from_arrays(
            [pa.array(keys, kind), pa.array(chunk, pa.int64()), pa.array(numbers, pa.int64()), pa.array(texts, pa.string()), pa.array(alone, pa.bool_())],
            names=["c", "chunk", "no", "value", "alone"])

    kind = None
    for batch in batches:
        at = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        kind, out = at["c"].type, []
        for c, alone, chunk, role, text in zip(*(at[n].to_pylist() for n in ("c", "alone", "chunk", "role", "text"))):
            line = f"{role}:{text}"
            if not alone:
                no += 1
                out.append((c, False, chunk, no, line))
                continue
            if key is None or c != key:
                if key is not None:
                    out.append((key, True, None, None, sha.hexdigest()))
                key, sha = c, hashlib.sha256(line.encode())
            else:
                sha.update(b"\n" + line.encode())
        yield batch_of(kind, out)
    if key is not None:
        yield batch_of(kind, [(key, True, None, None, sha.hexdigest())])


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same for lines sorted by conversation, chunk and number: one hash runs along a conversation."""
    key, sha, kind = None, None, None
    for batch in batches:
        kind, keys, said = batch.column(0).type, [], []
        for c, line in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
            if key is None or c != key:
                if key is not None:
                    keys.append(key)
                    said.append(sha.hexdigest())
                key, sha = c, hashlib.sha256(line.encode())
            else:
                sha.update(b"\n" + line.encode())
        yield pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(said, pa.string())], names=["c", "value"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], kind), pa.array([sha.hexdigest()], pa.string())], names=["c", "value"])


def repaired_turns(convs: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The repaired conversations: id, row (from 1), edit (K, R or I), turn, role, text; deleted rows are left out.

    An inserted row has the turn of the row it stands beside.  See
    ``repair_conversations`` for nulls, ties and repeated rows.
    """
    source = _source(convs, id_col, turn_col, role_col, text_col)
    _, plans, pieces = _planned(_keyed(source))
    rows = stored(_repaired(source, _edits(plans, pieces)).withColumn("place", F.monotonically_increasing_id()), "repaired")
    sizes = rows.groupBy("c", "chunk").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("from"))
    before = Window.partitionBy("c").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)  # a row a chunk
    starts = sizes.select("c", "chunk", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("from") + 1).alias("shift"))
    return rows.join(starts, ["c", "chunk"]).select(
        F.col("c.id").alias(id_col), (F.col("place") + F.col("shift")).alias("row"), "edit", "turn", "role", "text")


def repair_conversations(convs: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text", ids: DataFrame | None = None) -> DataFrame:
    """One row a conversation: gaps, faults, cost and audit of the cheapest repair, hash of what it leaves.

    Columns: id, gaps, blank, duplicate, truncated, illegal, cost (long),
    audit, repaired_sha256.  Rows are taken by turn (nulls first), then role,
    then the MD5 of role and text; so repeated rows are neighbours, and all but
    the first are duplicates.  A null role or text counts as one blank; a null
    id is a conversation like any other.  An empty role has no initial, so its
    row is rewritten or goes.  ``ids`` (one column, the id) adds conversations that have no
    rows: zeros, an empty audit, the hash of nothing.  Other columns are left out; an empty table
    gives an empty result.  Turns are whole numbers.  An audit is one string, so a
    conversation can have 2^31 rows at most.
    """
    source = _source(convs, id_col, turn_col, role_col, text_col)
    signed, plans, pieces = _planned(_keyed(source))
    kind = source.schema["c"].dataType.simpleString()
    said = stored(_repaired(source, _edits(plans, pieces)).mapInArrow(
        _digests, f"c {kind}, chunk long, no long, value string, alone boolean"), "digests")
    lines = said.filter("not alone").repartition("c").sortWithinPartitions("c", "chunk", "no")
    hashes = said.filter("alone").select("c", "value").unionByName(lines.mapInArrow(_chained, f"c {kind}, value string"))
    out = (signed.join(plans.filter("plan is null").select("c", "cost", "audit"), "c").join(hashes, "c", "left").select(
        "c", "gaps", _counted("blank", "blank again").alias("blank"), _counted("duplicate", "duplicate again").alias("duplicate"),
        _counted("truncated").alias("truncated"), _illegal(F.col("signature")).alias("illegal"), "cost", "audit", "value"))
    if ids is not None:
        every = ids.select(F.struct(col(ids.columns[0]).alias("id")).alias("c")).distinct()
        out = every.join(out, "c", "left")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return out.select(F.col("c.id").alias(id_col), *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in numbers],
                      F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("value", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


def damage(convs: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The four columns after a fixed share of damage, by crc32 of ``id:turn`` modulo 20.

    0 drops a row, 1 empties its text, 2 takes the sentence ends out, 3
    repeats it, 4 makes its role user.  Nulls of role and text become one
    blank, and count as one in the key.
    """
    def filled(name: str) -> Column:
        return F.coalesce(col(name).cast("string"), F.lit(" "))

    kind = RESERVED + "kind"
    hit = F.pmod(F.crc32(F.concat(filled(id_col), F.lit(":"), filled(turn_col)).cast("binary")), F.lit(20))
    text = F.when(F.col(kind) == 1, "").when(F.col(kind) == 2, F.translate(filled(text_col), ENDS, "")).otherwise(filled(text_col))
    rows = convs.withColumn(kind, hit).filter(F.col(kind) != 0).select(
        col(id_col), col(turn_col), F.when(F.col(kind) == 4, "user").otherwise(filled(role_col)).alias(role_col), text.alias(text_col),
        F.explode(F.when(F.col(kind) == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias(kind))
    return rows.drop(kind)
