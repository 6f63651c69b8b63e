"""Exact Jaccard join of documents by their sets of word n-grams, and the components of its links.

Sets are indexed by their prefixes: in one order of all shingles (those that are frequent last), two sets that link share one
of their first n - ceil(t n) + 1. The order puts frequent shingles last, so a passage that many documents share is in the
prefix of those documents alone that have little else.

Relations between sets let the join skip most of its work:

* Equal sets are one node, with one row in the index.
* First, each set in an index list is held against the list's leader only, the set that has the shingle earliest (an original
  comes before its edited copies, whose new shingles are rare). The answer is kept whole: whether they link, how many
  shingles differ, and which. What links to leaders is in one component, whose members need no comparison with each other.
* Lists that still hold several components are then walked through in blocks of equal size, ordered by position. Sizes out of
  range, blocks whose position leaves too little overlap, and sets of the same component are skipped. Of two sets with
  answers from one leader, the difference is at least that of their distances, which skips most of a leader's far copies.
  Maps of the parity of hashes, of about as many bits as the set has shingles, bound the difference of any two from below. So only pairs that nearly link leave a list, and there are as few of those as of links.
* The answers of sets with one leader are derived from the leader's: two sets differ in what sets either of them apart from
  the leader, but not both. So those small differences are compared, and no whole set is looked at again.

Every skipped pair either is in one component already or cannot link, so components are exact. Other pairs are verified on
whole sets of 64-bit shingle hashes.

No list has to fit in a task's memory. Its rows pass as a stream where its length is counted; a list of more than ``LIST`` rows is dealt into chunks by hash, and each two chunks meet in a task of their own. A set's wide map is sent once to each part
of the lists, not with each row.

Shingles count as frequent by counts over all documents: tasks report those they hold more than once; the ones kept have at
least one in 2**20 of all occurrences, so there are at most 2**20 of them (16 MB), which bounds what is broadcast.

Documents without words or text are sets of nothing and link with nothing. Repeated rows, ties and equal texts are in one
component. A very long text is a set like any other, held in memory whole. Rows of one id count as one document; rows with
a null id are left out of links and have a null component. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, forget, shuffle_partitions
from .components import components
from .textnum import U64, release, shingles, slices, view

FREQUENT = 1 << 20
CHUNK = 2_000_000  # shingles that a task counts at a time
LIST = 50_000  # rows of a list that meet in one task
SHORT = 8  # rows of a list whose pairs are all held against each other before it is dealt
LONG, UNITS = 1_000, 100_000  # a list's rows from which on it is walked by component; rows of lists walked at a time


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def parity(s: np.ndarray, bits: int) -> bytes:
    """For each value of the low bits of a hash, whether an odd number of the set's shingles has it."""
    at = (s & U64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def apart(x: bytes, y: bytes) -> int:
    """A lower bound of the symmetric difference; the longer map is folded to the lower bits that the shorter one has.

    An empty map, of an id that stands for several sets, tells nothing.
    """
    if not x or not y:
        return 0
    if len(x) < len(y):
        x, y = y, x
    a, b, size = int.from_bytes(x, "little"), int.from_bytes(y, "little"), len(x)
    while size > len(y):
        size //= 2
        a = (a >> 8 * size) ^ (a & (1 << 8 * size) - 1)
    return (a ^ b).bit_count()


def short(x: bytes) -> tuple[int, int]:
    """A map folded to 128 bits, or zeros if it has fewer."""
    a, size = int.from_bytes(x, "little"), len(x)
    if size < 16:
        return 0, 0
    while size > 16:
        size //= 2
        a = (a >> 8 * size) ^ (a & (1 << 8 * size) - 1)
    return a & (1 << 64) - 1, a >> 64


def _repeated(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = total = 0

        def flush() -> pa.RecordBatch:
            token, n = np.unique(np.concatenate(held), return_counts=True)
            some = n >= max(2, -(-size // FREQUENT))
            return pa.RecordBatch.from_arrays([pa.array(token[some].view(np.int64)), pa.array(n[some].astype(np.int64))], ["token", "n"])

        for batch in slices(batches):
            own = shingles(*view(batch.column("text")), k)
            held += own
            size += sum(map(len, own))
            if size >= CHUNK:
                total += size
                yield flush()
                held, size = [], 0
        if held:
            total += size
            yield flush()
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([total], pa.int64())], ["token", "n"])

    return run


def frequent(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, sorted; how often each was reported): at most ``FREQUENT`` of them."""
    counts = cut(docs.select("text").mapInArrow(_repeated(k), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")), "repeated")
    total = counts.filter("token IS NULL").first()
    if total is None:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    got = counts.filter(F.col("token").isNotNull() & (F.col("n") * FREQUENT >= total["n"])).toArrow()
    token, n = got.column("token").to_numpy().view(U64), got.column("n").to_numpy()
    order = np.argsort(token)
    return token[order], n[order]


SETS = "doc_id long, n int, h1 long, h2 long, parity binary, prefix array<long>"


def _sets(k: int, percent: int, hot):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, often = hot.value
        for batch in slices(batches):
            own = shingles(*view(batch.column("text")), k)
            prefixes, rows = [], []
            for s in own:
                n = len(s)
                if not n:
                    prefixes.append(s.view(np.int64))
                    rows.append((0, None, None, b""))
                    continue
                rank = np.zeros(n, np.int64)
                if len(token):
                    at = np.minimum(np.searchsorted(token, s), len(token) - 1)
                    rank = np.where(token[at] == s, often[at], 0)
                prefixes.append(s[np.lexsort((s, rank))[: prefix_length(n, percent)]].view(np.int64))
                digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                rows.append((n, *np.frombuffer(digest, np.int64).tolist(), parity(s, max(8, 1 << n.bit_length()))))
            n, *rest = zip(*rows, strict=True)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(p) for p in prefixes])), pa.int32()), pa.array(np.concatenate(prefixes), pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int32()), *(pa.array(x, pa.int64()) for x in rest[:-1]), pa.array(rest[-1], pa.binary()), lists],
                [c.split()[0] for c in SETS.split(", ")],
            )

    return run


#: token is null in the rows that bring the wide map of a set.
DEALT = "part int, token long, one int, two int, own int, id long, n int, pos int, label long, ref long, d int, parity binary"


class _Near:
    """Finds the pairs of rows of different components that nearly link at least. Rows are of whole units: chunks of a list that meet."""

    def __init__(self, cols: dict[str, np.ndarray], maps: dict[int, bytes], percent: int):
        unit = np.cumsum(np.append(True, np.any([cols[c][1:] != cols[c][:-1] for c in ("token", "one", "two")], axis=0)))
        order = np.lexsort((cols["pos"], cols["n"], unit))
        self.unit = unit[order]
        for c, x in cols.items():
            setattr(self, c, x[order])
        self.n, self.pos = self.n.astype(np.int64), self.pos.astype(np.int64)
        self.maps, self.percent = maps, percent
        known, at = np.unique(self.id, return_inverse=True)
        folded = np.array([short(maps[i]) for i in known.tolist()], U64).reshape(-1, 2)
        self.b0, self.b1 = folded[at, 0], folded[at, 1]
        self.wide = np.array([len(maps[i]) >= 16 for i in known.tolist()], bool)[at]

    def test(self, i: np.ndarray, j: np.ndarray) -> Iterator[tuple[int, int]]:
        """The rows i have the smaller sets."""
        some = (self.label[i] != self.label[j]) & (100 * self.n[i] >= self.percent * self.n[j])
        i, j = i[some], j[some]
        n, m = self.n[i], self.n[j]
        need = -(-self.percent * (n + m) // (100 + self.percent))
        room = n + m - 2 * need  # how many shingles two sets that link may differ in
        # Overlap is at most what follows the shared shingle on either side, and itself.
        some = (n - self.pos[i] >= need) & (m - self.pos[j] >= need)
        # Two chunks meet to compare what isn't in one of them.
        some &= (self.one[i] == self.two[i]) | (self.own[i] != self.own[j])
        some &= (self.ref[i] != self.ref[j]) | (np.abs(self.d[i] - self.d[j]) <= room)
        i, j, room = i[some], j[some], room[some]
        least = np.bitwise_count(self.b0[i] ^ self.b0[j]).astype(np.int64) + np.bitwise_count(self.b1[i] ^ self.b1[j])
        some = (least <= room) | ~(self.wide[i] & self.wide[j])
        for x, y, r in zip(self.id[i[some]].tolist(), self.id[j[some]].tolist(), room[some].tolist(), strict=True):
            if apart(self.maps[x], self.maps[y]) <= r:
                yield min(x, y), max(x, y)

    def pairs(self) -> Iterator[tuple[int, int]]:
        begin = np.flatnonzero(np.append(True, self.unit[1:] != self.unit[:-1]))
        ends = np.append(begin[1:], len(self.unit))
        long = ends - begin > LONG
        # A row meets those after it, up to the block of sizes that are too large for it or for its position.
        most = np.minimum(100 * self.n // self.percent, (self.n - self.pos) * (100 + self.percent) // self.percent - self.n)
        upto = np.searchsorted(self.unit << 32 | self.n, self.unit << 32 | np.maximum(most, 0), "right")
        upto[np.repeat(long, ends - begin)] = 0
        step, some = 1, np.arange(len(upto))
        while len(some := some[some + step < upto[some]]):
            yield from self.test(some, some + step)
            step += 1
        for a, b in zip(begin[long].tolist(), ends[long].tolist(), strict=True):
            # Copies of one text fill a long list; only the rows of other components than theirs go through it.
            names, which = np.unique(self.label[a:b], return_inverse=True)
            for i in (np.flatnonzero(which != np.bincount(which).argmax()) + a).tolist():
                at = int(np.searchsorted(self.n[a:b], self.n[i])) + a  # the first row of the size
                yield from self.test(np.full(b - at, i), np.arange(at, b))
                yield from self.test(np.arange(a, at), np.full(at - a, i))


def _across(percent: int):
    """Pairs of different components that nearly link at least; rows come by part, maps first, then by list and chunks."""

    def emit(out: set[tuple[int, int]]) -> pa.RecordBatch:
        both = np.array(sorted(out), np.int64).reshape(-1, 2)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, maps, out, held, size = None, {}, set(), [], 0

        def work() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            cols = {c: t.column(c).to_numpy() for c in ("token", "one", "two", "own", "id", "n", "pos", "label", "ref", "d")}
            for pair in _Near(cols, maps, percent).pairs():
                out.add(pair)
                if len(out) >= 100_000:
                    yield emit(out)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(c).fill_null(-1).to_numpy() for c in ("part", "token", "one", "two")]
            # Rows from ``last`` on may go on in the next batch; there the unit, or the part, is still open.
            begin = np.flatnonzero(np.append(True, np.any([k[1:] != k[:-1] for k in keys], axis=0)))
            turns = np.flatnonzero(np.append(True, keys[0][1:] != keys[0][:-1]))
            for a, b in itertools.pairwise(np.unique([*turns, begin[-1], batch.num_rows]).tolist()):
                some, key = batch.slice(a, b - a), tuple(k[a] for k in keys)
                if held and (key[0] != part or size >= UNITS and key != last):
                    yield from work()
                    held, size = [], 0
                if key[0] != part:
                    part, maps = key[0], {}
                plain = some.filter(some.column("token").is_valid())
                if plain.num_rows < some.num_rows:
                    m = some.filter(some.column("token").is_null())
                    maps.update(zip(m.column("id").to_pylist(), m.column("parity").to_pylist(), strict=True))
                if plain.num_rows:
                    held.append(plain)
                    size += plain.num_rows
                last = tuple(k[b - 1] for k in keys)
        if held:
            yield from work()
        if out:
            yield emit(out)
        release()

    return run


def _full(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            own = shingles(*view(batch.column("text")), k)
            right = [i for i, (s, h) in enumerate(zip(own, batch.column("h1").to_pylist(), strict=True)) if len(s) and np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)[0] == h]
            kept = [own[i].view(np.int64) for i in right]
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(p) for p in kept])), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *kept]), pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(right, pa.int64())), lists], ["id", "full"])

    return run


def _close(percent: int):
    """Pairs whose parity maps leave room for a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(c).to_pylist() for c in ("n", "m"))
            x, y = (batch.column(c).to_pylist() for c in ("x", "y"))
            keep = [apart(p, q) <= i + j - 2 * -(-percent * (i + j) // (100 + percent)) for i, j, p, q in zip(n, m, x, y, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
        release()

    return run


def _need(n: Column, m: Column, percent: int) -> Column:
    """The least overlap with which sets of n and m shingles link."""
    return F.ceil(percent * (n + m) / (100 + percent)).cast("int")


def _fit(n: Column, pos: Column, m: Column, at: Column, percent: int) -> Column:
    """Whether sets of n and m shingles may link that share the one at the positions pos and at, and none before."""
    need = _need(n, m, percent)
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (n - pos >= need) & (m - at >= need)


def _linked(n: Column, m: Column, differ: Column, percent: int) -> Column:
    """Whether sets of n and m shingles that differ in so many link."""
    both = (n + m - differ) / 2
    return 100 * both >= percent * (n + m - both)


def _answers(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b, delta, linked) of ``pairs`` (a, b) by their whole sets: the shingles that one of the two has, and whether they link.

    Only documents in a pair are made into sets.
    """
    ids = cut(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(nodes.select("id", "h1"), "id"), "in-pairs")
    text = docs.select(F.col("doc_id").alias("id"), "text").join(ids, "id")
    full = cut(text.mapInArrow(_full(k), "id long, full array<long>"), "full-sets")
    one = full.select(F.col("id").alias("a"), F.col("full").alias("x"))
    two = full.select(F.col("id").alias("b"), F.col("full").alias("y"))
    delta = F.concat(F.array_except("x", "y"), F.array_except("y", "x"))
    rows = pairs.join(one, "a").join(two, "b").withColumn("delta", delta)
    return rows.select("a", "b", "delta", _linked(F.size("x"), F.size("y"), F.size("delta"), percent).alias("linked"))


def _derived(pairs: DataFrame, refs: DataFrame, percent: int) -> DataFrame:
    """``pairs`` (a, b) with derived: whether they link, from the answers of a leader that both have; null without one."""
    a = refs.select(F.col("id").alias("a"), F.col("n").alias("n"), F.col("ref").alias("ra"), F.col("delta").alias("x"))
    b = refs.select(F.col("id").alias("b"), F.col("n").alias("m"), F.col("ref").alias("rb"), F.col("delta").alias("y"))
    differ = F.size("x") + F.size("y") - 2 * F.size(F.array_intersect("x", "y"))
    derived = F.when(F.col("ra") == F.col("rb"), _linked(F.col("n"), F.col("m"), differ, percent))
    return pairs.join(a, "a", "left").join(b, "b", "left").select("a", "b", derived.alias("derived"))


def join(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id that links lead to)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = shuffle_partitions(spark)
    hot = spark.sparkContext.broadcast(frequent(docs, k))
    sets = cut(docs.mapInArrow(_sets(k, percent, hot), SETS), "sets")
    hot.destroy()
    by_set = sets.filter("n > 0 AND doc_id IS NOT NULL").groupBy("h1", "h2")
    nodes = by_set.agg(F.min(F.struct("doc_id", "n", "parity", "prefix")).alias("s"))
    nodes = cut(nodes.select("h1", "h2", F.col("s.doc_id").alias("id"), "s.n", "s.parity", "s.prefix"), "nodes")
    of_set = cut(sets.select("doc_id", "n", "h1", "h2"), "set-of")
    forget(spark, sets)

    # Shuffled once: lengths and leaders are taken, and joined, where a list's rows are. They pass as a stream, so a long one fills no memory.
    index = nodes.select("id", "n", F.posexplode("prefix").alias("pos", "token")).repartition("token")
    leader = index.groupBy("token").agg(F.count("*").alias("rows"), F.min(F.struct("pos", "id", "n")).alias("l")).filter("rows > 1")
    lists = cut(index.join(leader, "token"), "lists")
    wide, nodes = nodes, cut(nodes.drop("prefix"), "nodes")
    forget(spark, wide)

    # Each set against the leader of each of its lists.
    met = lists.filter(F.col("id") != F.col("l.id"))
    met = met.filter(_fit(F.col("n"), F.col("pos"), F.col("l.n"), F.col("l.pos"), percent))
    one = nodes.select(F.col("id").alias("a"), "n", F.col("parity").alias("x"))
    two = nodes.select(F.col("id").alias("b"), F.col("n").alias("m"), F.col("parity").alias("y"))
    met = met.select(F.col("id").alias("a"), F.col("l.id").alias("b")).distinct().join(one, "a").join(two, "b")
    met = cut(met.mapInArrow(_close(percent), "a long, b long"), "met")
    answers = cut(_answers(met, docs, nodes, k, percent), "answers")
    first = cut(components(answers.filter("linked").select("a", "b")), "components")
    # A set's reference is the leader, of those it was held against, that most sets were.
    led = answers.join(answers.groupBy("b").agg(F.count("*").alias("led")), "b")
    refs = led.groupBy("a").agg(F.max_by(F.struct("b", "delta"), F.struct("led", -F.size("delta"), "b")).alias("r"))
    # An id of several texts stands for several sets; it has no reference, and its map is empty.
    single = nodes.groupBy("id").agg(F.max("n").alias("n"), F.count("*").alias("sets"))
    refs = refs.select(F.col("a").alias("id"), F.col("r.b").alias("ref"), "r.delta")
    refs = cut(refs.join(single.filter("sets = 1").select("id", "n"), "id"), "references")

    # What is left between components.
    labelled = lists.join(first, "id", "left").join(refs.select("id", "ref", F.size("delta").alias("d")), "id", "left")
    # Without a reference a set is its own.
    labelled = labelled.withColumns({"label": F.coalesce("component", "id"), "ref": F.coalesce("ref", "id"), "d": F.coalesce("d", F.lit(0))}).drop("component")
    labelled = labelled.select("token", "rows", "id", "n", "pos", "label", "ref", "d")
    # In a short list all pairs are held against each other's sizes and positions at once; of a longer one, its labels and least size are taken.
    fits = lambda x, y: (x["label"] != y["label"]) & _fit(x["n"], x["pos"], y["n"], y["pos"], percent)
    short = labelled.filter(F.col("rows") <= SHORT).groupBy("token").agg(F.collect_list(F.struct("n", "pos", "label")).alias("l"))
    short = short.filter(F.exists("l", lambda x: F.exists("l", lambda y: fits(x, y)))).select("token", F.array_min(F.col("l.n")).alias("least"))
    long = labelled.filter(F.col("rows") > SHORT).groupBy("token").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.min("n").alias("least"))
    mixed = short.unionAll(long.filter("x <> y").select("token", "least"))
    # Rows go that are too far on for the least overlap that any size in the list asks for.
    partner = F.greatest("least", F.ceil(percent * F.col("n") / 100))
    chunks = F.ceil(F.col("rows") / LIST).cast("int")
    rest = labelled.join(mixed, "token").filter(F.col("n") - F.col("pos") >= _need(F.col("n"), F.least("n", partner), percent)).drop("least")
    rest = rest.withColumn("own", F.pmod(F.xxhash64("id"), chunks).cast("int"))
    rest = rest.withColumn("to", F.explode(F.sequence(F.lit(0), chunks - 1)))
    rest = rest.withColumns({"one": F.least("own", "to"), "two": F.greatest("own", "to")})
    rest = cut(rest.withColumn("part", F.pmod(F.xxhash64("token", "one", "two"), F.lit(parts)).cast("int")).drop("rows", "to"), "mixed-lists")
    forget(spark, lists)
    names = [c.split()[0] for c in DEALT.split(", ")]
    map_of = nodes.groupBy("id").agg(F.when(F.count("*") == 1, F.max("parity")).otherwise(F.lit(b"")).alias("parity"))
    maps = rest.select("part", "id").distinct().join(map_of, "id")
    blank = [F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in DEALT.split(", ")[1:-1] if c != "id long"]
    rows = rest.withColumn("parity", F.lit(None).cast("binary")).select(names).unionAll(maps.select("part", "id", "parity", *blank).select(names))
    rows = rows.repartitionById(parts, "part").sortWithinPartitions(F.col("part"), F.col("token").asc_nulls_first(), "one", "two")
    more = rows.mapInArrow(_across(percent), "a long, b long").distinct()
    known = answers.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = cut(_derived(more.join(known, ["a", "b"], "left_anti"), refs, percent), "derived")
    forget(spark, rest)
    whole = _answers(more.filter("derived IS NULL").select("a", "b"), docs, nodes, k, percent)
    more = whole.filter("linked").select("a", "b").unionAll(more.filter("derived").select("a", "b"))
    label = first.select("id", "component")
    more = (
        more.join(label.withColumnsRenamed({"id": "a", "component": "ca"}), "a", "left")
        .join(label.withColumnsRenamed({"id": "b", "component": "cb"}), "b", "left")
        .select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    )
    second = cut(components(more), "components").select(F.col("id").alias("component"), F.col("component").alias("merged"))

    of_node = (
        nodes.select("h1", "h2", "id")
        .join(first, "id", "left")
        .select("h1", "h2", F.coalesce("component", "id").alias("component"))
        .join(second, "component", "left")
        .select("h1", "h2", F.coalesce("merged", "component").alias("component"))
    )
    # Equal sets may be many; AQE splits their partition, as a node is one row.
    return of_set.join(cut(of_node, "node-components"), ["h1", "h2"], "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id")
    )
