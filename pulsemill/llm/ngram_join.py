"""N-gram Jaccard join with a token-group matrix.

A document is its set of hashes of word shingles.  Equal sets are one set.

1. Tokens in one order.  Every set posts its tokens below a fixed share of the
   hash space, and at least as many as its prefix has.  A token's number of
   sets, counted there, ranks it: rare ones first, those above the threshold
   last.  Two sets that link share a token of both prefixes in this order, and
   its places leave room for the overlap (``slack``).  A token in one set only
   links nothing, so sets whose prefixes have no others are done.
2. Groups.  The sets left are sorted by MinHash values of their shared tokens and cut into
   groups of at most ``GROUP`` similar sets.  The matrix has each group's token union.
3. A query is a set and a group that holds a token of its prefix.  Its tokens in
   the union bound its overlap with every member; only where the bound does is the
   group opened and its members compared exactly.
4. A token in more than ``CAP`` sets asks only about the group of its first set.
   Where its sets are in several components after that, its groups ask each
   other: a row a pair of groups whose sets may link over a component's border.
   So no step emits the pairs of a large group of copies, and no link between
   components is lost.

Shingles are compared by 64-bit hashes: for two documents of a thousand words
the chance that any two different ones fall together is 10^-13.  Sets are told
apart by 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, narrow, stored
from .components import components

WORDS = 5
PERCENT = 80
#: Share of the hash space whose tokens are counted.
COUNTED = 0.3
#: Sets of a token that are told apart by number; more are "many".
CAP = 64
#: Sets of a group, and their tokens together (one set may have more).
GROUP, GROUP_TOKENS = 256, 1 << 18
#: Queries that meet a group in one run.
QUERIES = 512
#: Groups of copies above 1/HOT of the rows are broadcast, at most HOT of them.
HOT = 10_000

_MIX = np.uint64(0x9E3779B97F4A7C15)
_TOP = np.int64(-(1 << 63) + int(COUNTED * (1 << 64)))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted different hashes of the word shingles; a text with fewer words is one shingle, one without has none."""
    parts = text.encode("utf-8", "replace").lower().split() if text else []
    if not parts:
        return np.zeros(0, np.int64)
    width, digest = min(words, len(parts)), xxhash.xxh64_intdigest
    each = np.fromiter(map(digest, parts), np.uint64, len(parts))
    total = len(parts) - width + 1
    h = each[:total] + np.uint64(width)
    for k in range(1, width):
        h = (h ^ (h >> np.uint64(29))) * _MIX + each[k:k + total]
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return np.unique((h ^ (h >> np.uint64(29))).view(np.int64))


def prefix_size(n, percent: int):
    """So many tokens of a set, in any one order, that it shares one of them with the same of any set it links with."""
    return n - -(-percent * n // 100) + 1


def least_overlap(n, m, percent: int):
    """The smallest intersection of sets of these sizes that link."""
    return -(-percent * (n + m) // (100 + percent))


def _set_id(tokens: np.ndarray) -> tuple[int, int]:
    h = xxhash.xxh3_128_digest(tokens.tobytes())
    return int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True)


def _sized(rows: DataFrame, words: int) -> DataFrame:
    """id, n, below (tokens of the counted share), h1, h2 of (id, text)."""
    kind = dict(rows.dtypes)["id"]

    def work(texts, batch):
        sets = [shingles(t, words) for t in texts]
        ids = [_set_id(s) for s in sets]
        return {"id": batch.column(batch.schema.get_field_index("id")), "n": [len(s) for s in sets],
                "below": [int(np.searchsorted(s, _TOP)) for s in sets], "h1": [a for a, _ in ids], "h2": [b for _, b in ids]}

    return map_texts(rows, "text", f"id {kind}, n long, below long, h1 long, h2 long", work)


def _postings(rows: DataFrame, words: int, percent: int) -> DataFrame:
    """token, h1, h2 for the tokens each set posts; copies near each other in a file post once."""
    seen: set[tuple[int, int]] = set()

    def work(texts, batch):
        tokens, ids, sizes = [], [], []
        for text in texts:
            s = shingles(text, words)
            if not len(s) or (key := _set_id(s)) in seen:
                continue
            if len(seen) >= 1 << 16:
                seen.clear()
            seen.add(key)
            s = s[:max(int(np.searchsorted(s, _TOP)), prefix_size(len(s), percent))]
            tokens.append(s)
            ids.append(key)
            sizes.append(len(s))
        h = np.array(ids, np.int64).reshape(-1, 2)
        return {"token": pa.array(np.concatenate(tokens) if tokens else np.zeros(0, np.int64)),
                "h1": pa.array(np.repeat(h[:, 0], sizes)), "h2": pa.array(np.repeat(h[:, 1], sizes))}

    return map_texts(rows, "text", "token long, h1 long, h2 long", work)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """h1, h2, token, count of tokens with more than one set, from (token, h1, h2) in sorted order; repeated rows count once.

    Counts end at CAP + 1.  So many rows of a token wait for the next batch at most.
    """
    kept = [np.zeros(0, np.int64)] * 3
    many: int | None = None  # a token that has shown more than CAP sets; its last row is in ``kept``

    def settle(cols, final: bool):
        nonlocal many
        token, h1, h2 = cols
        if not len(token):
            return cols, None
        fresh = np.ones(len(token), bool)
        fresh[1:] = (token[1:] != token[:-1]) | (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        old = many is not None and token[0] == many  # the first row was emitted before
        if old:
            fresh[0] = True
        token, h1, h2 = token[fresh], h1[fresh], h2[fresh]
        new = np.ones(len(token), bool)
        new[1:] = token[1:] != token[:-1]
        run = np.cumsum(new) - 1
        count = np.bincount(run)
        if old:
            count[0] = CAP + 1
        size = np.minimum(count, CAP + 1)[run]
        use = size > 1
        if old:
            use[0] = False
        wait = np.zeros(len(token), bool)
        if not final:
            if size[-1] > CAP:
                many = int(token[-1])
                wait[-1] = True
            else:
                many = None
                wait = run == run[-1]
                use &= ~wait
        out = pa.RecordBatch.from_arrays([pa.array(x[use]) for x in (h1, h2, token, size.astype(np.int64))], names=["h1", "h2", "token", "count"])
        return [token[wait], h1[wait], h2[wait]], out

    for batch in batches:
        cols = [np.concatenate([k, batch.column(i).to_numpy()]) for i, k in enumerate(kept)]
        kept, out = settle(cols, False)
        if out is not None:
            yield out
    out = settle(kept, True)[1]
    if out is not None:
        yield out


def _prefixes(percent: int):
    """The tokens of each set's prefix that other sets post, with their slack, and two MinHash values; sets without any go.

    Places come from the order (counted share, count, hash); tokens outside
    the counted share take the first place that any of them could have.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            n, below = at["n"].to_numpy(), at["below"].to_numpy()
            pairs, ends = at["shared"].flatten(), np.cumsum([0, *(len(x) for x in at["shared"])])
            tokens, counts = pairs.field("token").to_numpy(), pairs.field("count").to_numpy()
            take, posted, keys = [], [], []
            for i in range(len(n)):
                t, c = tokens[ends[i]:ends[i + 1]], counts[ends[i]:ends[i + 1]]
                inside = t < _TOP
                order = np.lexsort((t, c, ~inside))
                t, inside = t[order], inside[order]
                place = np.where(inside, below[i] - inside.sum() + np.arange(len(t)), below[i])
                use = place < prefix_size(int(n[i]), percent)
                if not use.any():
                    continue
                slack = (100 - percent) * int(n[i]) - (100 + percent) * place
                take.append(i)
                posted.append([{"token": int(a), "slack": int(b)} for a, b in zip(t[use], slack[use])])
                mixed = (t.view(np.uint64) * _MIX) >> np.uint64(1)
                keys.append((int(mixed.min()), int(((mixed ^ (mixed >> np.uint64(31))) * _MIX >> np.uint64(1)).min())))
            index = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*[at[c].take(index) for c in ("h1", "h2", "n")], pa.array([a for a, _ in keys], pa.int64()), pa.array([b for _, b in keys], pa.int64()),
                 pa.array(posted, pa.list_(pa.struct([("token", pa.int64()), ("slack", pa.int64())])))],
                names=["h1", "h2", "n", "g1", "g2", "posted"])

    return run


def _grouped(most: int, most_tokens: int):
    """Adds no and group to sets sorted by (g1, g2): a group ends with its g1, or where it is full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 33
        no, group, size, total, last = base, base, 0, 0, None
        for batch in batches:
            nos, groups = [], []
            g1 = batch.column(batch.schema.get_field_index("g1")).to_pylist()
            for key, n in zip(g1, batch.column(batch.schema.get_field_index("n")).to_pylist()):
                if size and (key != last or size >= most or total + n > most_tokens):
                    group, size, total = group + 1, 0, 0
                size, total, last = size + 1, total + n, key
                nos.append(no)
                groups.append(group)
                no += 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nos, pa.int64()), pa.array(groups, pa.int64())],
                                             names=[*batch.schema.names, "no", "group"])

    return run


def _queries(percent: int):
    """What the lists of tokens ask, from (token, slack, no, n, group) sorted by token and falling slack.

    Rows (no, group, null, null): this set asks about that group.  Of a token in more
    than CAP sets all ask about the first one's group, and their postings
    (no, group, token, slack) come too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.zeros(0, np.int64)] * 5
        hub: tuple | None = None  # token, slack and group of the first row of a long list that goes on

        def settle(cols, final: bool):
            nonlocal hub
            token, slack, no, n, group = cols
            if not len(token):
                return cols, None
            new = np.ones(len(token), bool)
            new[1:] = token[1:] != token[:-1]
            run, start = np.cumsum(new) - 1, np.flatnonzero(new)
            large = np.bincount(run) > CAP
            top, head = slack[start], group[start]
            if hub is not None and token[0] == hub[0]:
                large[0], top[0], head[0] = True, hub[1], hub[2]
            wait = np.zeros(len(token), bool)
            hub = None
            if not final:
                if large[-1]:
                    hub = (token[-1], top[-1], head[-1])
                else:
                    wait = run == run[-1]
            many = large[run] & (slack + top[run] >= 0)
            ask = many & (group != head[run])
            out = [(no[ask], head[run][ask], None, None), (no[many], group[many], token[many], slack[many])]
            small = ~large[run] & ~wait
            s_run, s_slack, s_no, s_n, s_group = (x[small] for x in (run, slack, no, n, group))
            d = 1
            while d < len(s_run) and (same := np.flatnonzero(s_run[d:] == s_run[:-d])).size:
                a, b = same, same + d
                ok = (s_slack[a] + s_slack[b] >= 0) & (s_group[a] != s_group[b])
                ok &= 100 * np.minimum(s_n[a], s_n[b]) >= percent * np.maximum(s_n[a], s_n[b])
                a, b = a[ok], b[ok]
                later = s_group[a] > s_group[b]
                out.append((np.where(later, s_no[a], s_no[b]), np.where(later, s_group[b], s_group[a]), None, None))
                d += 1
            null = lambda x, k: pa.array(x, pa.int64()) if x is not None else pa.nulls(k, pa.int64())
            parts = [pa.concat_arrays([null(o[i], len(o[0])) for o in out]) for i in range(4)]
            return [x[wait] for x in (token, slack, no, n, group)], pa.RecordBatch.from_arrays(parts, names=["no", "group", "token", "slack"])

        for batch in batches:
            kept, out = settle([np.concatenate([k, batch.column(i).to_numpy()]) for i, k in enumerate(kept)], False)
            if out is not None:
                yield out
        out = settle(kept, True)[1]
        if out is not None:
            yield out

    return run


def _tokens(binary) -> np.ndarray:
    return np.frombuffer(binary, np.int64)


def _counts(sets: list[np.ndarray], union: np.ndarray) -> np.ndarray:
    """Membership matrix of the sets over the union's tokens."""
    m = np.zeros((len(sets), len(union)), np.uint8)
    for i, s in enumerate(sets):
        m[i, np.searchsorted(union, s)] = 1
    return m


def _linked(m: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """For each set of a membership matrix the first set of its component within the group."""
    both = np.zeros((len(m), len(m)))
    for k in range(0, m.shape[1], 1 << 16):
        part = m[:, k:k + (1 << 16)].astype(np.float32)
        both += part @ part.T
    near = both >= least_overlap(sizes[:, None], sizes[None, :], percent)
    label = np.arange(len(m))
    while True:
        lower = np.where(near, label[None, :], len(m)).min(axis=1)
        lower = np.minimum(label, lower)
        lower = lower[lower]
        if (lower == label).all():
            return label
        label = lower


def _matrix(percent: int):
    """Of one group: its row of the matrix (sizes and token union), and links that connect its members."""

    def run(table: pa.Table) -> pa.Table:
        no, n = table.column("no").to_numpy(), table.column("n").to_numpy()
        sets = [_tokens(x.as_buffer()) for x in table.column("tokens")]
        union = np.unique(np.concatenate(sets))
        first = _linked(_counts(sets, union), n, percent) if len(sets) > 1 else np.zeros(1, int)
        more = first != np.arange(len(sets))
        a, b = no[more], no[first][more]
        k = len(a)
        pad = lambda x, kind: pa.array([x] + [None] * k, kind)
        return pa.table({
            "group": pa.array([table.column("group")[0].as_py()] * (k + 1), pa.int64()),
            "lo": pad(int(n.min()), pa.int64()), "hi": pad(int(n.max()), pa.int64()), "tokens": pad(union.tobytes(), pa.binary()),
            "a": pa.array([None, *a.tolist()], pa.int64()), "b": pa.array([None, *b.tolist()], pa.int64())})

    return run


def _opened(percent: int):
    """Links of queries with a group's components, from streams of a group's row (kind 0), members (1) and queries (2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        union = members = matrix = None
        lo = hi = 0
        for batch in batches:
            at = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            kinds, nos, ns = at["kind"].to_numpy(), at["no"].to_numpy(zero_copy_only=False), at["n"].to_numpy()
            left, right = [], []
            for i, kind in enumerate(kinds):
                tokens = _tokens(at["tokens"][i].as_buffer())
                n = int(ns[i])
                if kind == 0:
                    union, members, matrix, lo, hi = tokens.copy(), [], None, n, at["hi"][i].as_py()
                elif kind == 1:
                    members.append((int(nos[i]), n, tokens.copy()))
                elif 100 * hi >= percent * n and 100 * n >= percent * lo:
                    place = np.minimum(np.searchsorted(union, tokens), len(union) - 1)
                    place = place[union[place] == tokens]
                    if len(place) < least_overlap(n, max(lo, -(-percent * n // 100)), percent):
                        continue  # no member can share enough: the group stays closed
                    if matrix is None:
                        matrix = _counts([t for _, _, t in members], union)
                        sizes, names = np.array([s for _, s, _ in members]), np.array([x for x, _, _ in members])
                        names = names[_linked(matrix, sizes, percent)]
                    both = matrix[:, place].sum(axis=1, dtype=np.int64)
                    hit = np.unique(names[both >= least_overlap(n, sizes, percent)])
                    left.append(np.full(len(hit), nos[i], np.int64))
                    right.append(hit)
            empty = np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else empty, pa.int64()) for x in (left, right)], names=["a", "b"])

    return run


def _open(asked: DataFrame, members: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """Links a, b of the queries (no, group) with members of their groups; a group with many queries is opened in several tasks."""
    asked = asked.select("no", "group").distinct()
    runs = asked.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("long").alias("runs"))
    each = runs.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.col("runs") - 1))).select("group", "run")
    null = F.lit(None).cast("long")
    queries = (asked.join(runs, "group").withColumn("run", F.pmod(F.xxhash64("no"), "runs")).select("no", "group", "run")
               .join(members.select("no", "n", "tokens"), "no").select("group", "run", F.lit(2).alias("kind"), "no", "n", null.alias("hi"), "tokens"))
    own = members.join(each, "group").select("group", "run", F.lit(1).alias("kind"), "no", "n", null.alias("hi"), "tokens")
    rows = groups.join(each, "group").select("group", "run", F.lit(0).alias("kind"), null.alias("no"), F.col("lo").alias("n"), "hi", "tokens")
    both = rows.unionByName(own).unionByName(queries)
    return both.repartition("group", "run").sortWithinPartitions("group", "run", "kind").mapInArrow(_opened(percent), "a long, b long")


def _with_tokens(rows: DataFrame, sets: DataFrame, words: int) -> DataFrame:
    """The sets (h1, h2, first id, ...) with all their tokens, from the texts of their first ids."""
    wanted = sets.select(F.struct("id").alias("c")).distinct()
    texts = rows.select(F.struct("id").alias("c"), "text").join(wanted, "c", "left_semi").select("text")

    def work(texts, batch):
        each = [shingles(t, words) for t in texts]
        ids = [_set_id(s) for s in each]
        return {"h1": [a for a, _ in ids], "h2": [b for _, b in ids], "tokens": [s.tobytes() for s in each]}

    found = map_texts(texts, "text", "h1 long, h2 long, tokens binary", work)
    return sets.drop("id").join(found, ["h1", "h2"]).dropDuplicates(["no"])


def link_sets(rows: DataFrame, sets: DataFrame, percent: int = PERCENT, words: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """Sets in play (h1, h2, no) and links (a, b) that connect their components.

    ``rows`` has id and text; ``sets`` h1, h2, n, below and the first id, each set once.
    """
    posted = _postings(rows, words, percent).repartition("token").sortWithinPartitions("token", "h1", "h2")
    shared = posted.mapInArrow(_shared, "h1 long, h2 long, token long, count long")
    lists = shared.groupBy("h1", "h2").agg(F.collect_list(F.struct("token", "count")).alias("shared"))  # tokens of one set
    prefixes = stored(sets.join(lists, ["h1", "h2"]).select("h1", "h2", "n", "below", "shared").mapInArrow(
        _prefixes(percent), "h1 long, h2 long, n long, g1 long, g2 long, posted array<struct<token: long, slack: long>>"), "prefixes")

    order = ["g1", "g2", "h1", "h2"]
    grouped = stored(prefixes.select(*order, "n").repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        _grouped(GROUP, GROUP_TOKENS), "g1 long, g2 long, h1 long, h2 long, n long, no long, group long"), "groups")
    play = grouped.select("h1", "h2", "n", "no", "group")
    members = stored(_with_tokens(rows, play.join(sets.select("h1", "h2", "id"), ["h1", "h2"]), words).select("no", "n", "group", "tokens"), "members")
    matrix = stored(members.groupBy("group").applyInArrow(
        _matrix(percent), "group long, lo long, hi long, tokens binary, a long, b long"), "matrix")  # GROUP sets at most
    groups = matrix.filter("a is null").select("group", "lo", "hi", "tokens")

    keyed = (prefixes.select("h1", "h2", F.explode("posted").alias("p")).join(play, ["h1", "h2"])
             .select("p.token", "p.slack", "no", "n", "group"))
    asked = stored(keyed.repartition("token").sortWithinPartitions("token", F.desc("slack"), "no").mapInArrow(
        _queries(percent), "no long, group long, token long, slack long"), "asked")
    links = stored(matrix.filter("a is not null").select("a", "b").unionByName(
        _open(asked.filter("token is null"), members, groups, percent)), "set-links")

    # Long lists whose sets are in several components: their groups ask each other.
    many = asked.filter("token is not null")
    if many.isEmpty():
        return play, links
    roots = stored(play.select("no", "group", "n").join(components(links).withColumnRenamed("node", "no"), "no", "left").select(
        "no", "group", "n", F.coalesce("root", "no").alias("root")), "group-roots")
    spans = roots.groupBy("group").agg(F.min("root").alias("p"), F.max("root").alias("q"), F.min("n").alias("lo"), F.max("n").alias("hi"))
    held = stored(many.groupBy("token", "group").agg(F.max("slack").alias("most")).join(spans, "group"), "long-lists")
    split = held.groupBy("token").agg(F.min("p").alias("low"), F.max("q").alias("high")).filter("low <> high").select("token")
    left = held.join(split, "token", "left_semi")
    right = left.withColumnsRenamed({"group": "to", "p": "p2", "q": "q2", "most": "most2", "lo": "lo2", "hi": "hi2"})
    fits = ((F.col("group") > F.col("to")) & (F.col("most") + F.col("most2") >= 0)
            & (100 * F.col("hi2") >= percent * F.col("lo")) & (100 * F.col("hi") >= percent * F.col("lo2"))
            & ((F.col("p") != F.col("q")) | (F.col("p2") != F.col("q2")) | (F.col("p") != F.col("p2"))))
    pairs = left.join(right, "token").filter(fits).select("group", "to", "p2", "q2", "lo2", "hi2").distinct()
    # Of the asking group come the sets on long lists whose size fits and that aren't in the other group's only component.
    asking = roots.join(many.select("no").distinct(), "no", "left_semi")
    may = ((100 * F.col("hi2") >= percent * F.col("n")) & (100 * F.col("n") >= percent * F.col("lo2"))
           & ((F.col("p2") != F.col("q2")) | (F.col("root") != F.col("p2"))))
    more = pairs.join(asking, "group").filter(may).select("no", F.col("to").alias("group"))
    return play, stored(links.unionByName(_open(more, members, groups, percent)), "set-links")


def _back(full: DataFrame, named: DataFrame, keys: list[str], total) -> DataFrame:
    """``full`` with the columns of its key's row in ``named``, which also has ``copies``: how many rows of ``full`` have the key."""
    hot = F.broadcast(stored(named.filter(F.col("copies") * HOT > total).drop("copies"), "hot"))
    cold = named.filter(F.col("copies") * HOT <= total).drop("copies")
    return full.join(hot, keys).unionByName(full.join(hot.select(*keys), keys, "left_anti").join(cold, keys))


def near_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """Class of each row: id, n_shingles, component_id (the smallest id reachable by links).

    Two rows link when 100 * intersection >= percent * union of their sets of
    word shingles (words: runs without ASCII white space, A-Z lower-cased).  A
    text with fewer words is one shingle; null, empty and blank texts have
    none and link with nothing, not even each other.  Repeated rows and
    copies link like any others.  Null ids are never the smallest unless a
    class has no other.  Other columns are left out; an empty table gives an
    empty result.
    """
    kind = dict(docs.dtypes)[id_col]
    rows = narrow(docs, id=id_col, text=text_col)
    sized = stored(_sized(rows, words), "sized")
    sets = stored(sized.filter("n > 0").groupBy("h1", "h2").agg(
        F.min("id").alias("id"), F.first("n").alias("n"), F.first("below").alias("below"), F.count(F.lit(1)).alias("copies")), "sets")
    play, links = link_sets(rows, sets, percent, words)
    roots = play.join(components(links).withColumnRenamed("node", "no"), "no").select("h1", "h2", "root")
    rooted = stored(sets.join(roots, ["h1", "h2"], "left").select("h1", "h2", "id", "copies", "root"), "set-roots")
    total = F.lit(sized.count())
    linked = rooted.filter("root is not null")
    least = linked.groupBy("root").agg(F.min("id").alias("component_id"), F.count(F.lit(1)).alias("copies"))
    columns = ["h1", "h2", "copies", "component_id"]
    named = _back(linked, least, ["root"], total).select(*columns).unionByName(
        rooted.filter("root is null").select("h1", "h2", "copies", F.col("id").alias("component_id")))
    joined = _back(sized.filter("n > 0"), stored(named, "named"), ["h1", "h2"], total)
    out = joined.select("id", "n", "component_id").unionByName(sized.filter("n = 0").select("id", "n", F.col("id").alias("component_id")))
    return out.select(F.col("id").cast(kind).alias(id_col), F.col("n").alias("n_shingles"), F.col("component_id").cast(kind).alias("component_id"))
