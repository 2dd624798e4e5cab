"""N-gram Jaccard join by prefix filters under several global token orders (operator 4)."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folianth.llm.blocks import U64, ids_and_texts, mix, packed_slices, packed_text, slices
from folianth.llm.components import connected_components
from folianth.llm.store import HOT_KEYS, HOT_ROWS, drop, hot_join, hot_keys, materialize, partitions

#: So many document ids are broadcast at most (8 MB).
BROADCAST_IDS = 1 << 20
#: A unit of documents is sent on when it has so many tokens, and a key range holds about so many.
UNIT_TOKENS, RANGE_TOKENS = 1 << 20, 1 << 20
#: A key's row holds so many of its set's keys before it, at most.
KEYS_BEFORE = 8
#: One seed for each order by hash. The order that makes the candidates goes by rarity.
ORDER_SEEDS = (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25)

#: A token in a unit is one number: 40 bits of its hash, 22 of its document's place, a bit for each order by hash.
_FLAGS, _PLACES = len(ORDER_SEEDS), 22
_LOW = _PLACES + _FLAGS
_KEY_BITS = 64 - _LOW


def _packed(x: np.ndarray) -> bytes:
    """Sorted numbers as their differences, byte by byte of all of them, compressed."""
    d = x.copy()
    d[1:] = x[1:] - x[:-1]
    planes = np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpacked(z: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(z), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(U64).ravel(), dtype=U64)


def _joined(column: pa.ChunkedArray, kind) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in column.to_pylist() if x), kind)


def prefix_size(n, percent: int):
    """So many first tokens under any order: a set that is similar enough shares one of them."""
    return n - (percent * n + 99) // 100 + 1


def prefixes(docs: DataFrame, k: int, percent: int, tokens: int) -> DataFrame:
    """(doc_id, n, lost, own, keys, marks) of the sets that can have a partner.

    keys: the first tokens, rarest first by how many sets have each, without those that no other set has, which come
    before them and of which there are own. marks: of all
    tokens that other sets have too, those among the set's first under an order by hash, with a bit for each order. lost:
    tokens of the set that the 40 bits kept of a hash don't tell apart. tokens: how many there are in all.

    Every token is counted. Units of documents send their sorted tokens to key ranges: a token of one document of the
    unit with the document's place, one of several documents once, without. The ranges count and send back to the units
    what others have too. So a token of a third of all documents comes to its range once a unit.
    """
    n_ranges = max(2 * partitions(docs.sparkSession), math.ceil(tokens / RANGE_TOKENS))
    names = ["part", "unit", "ids", "sizes", "images", "single", "several", "counts"]
    types = [pa.int64(), pa.int64()] + [pa.binary()] * 6
    starts = [-(-(r << _KEY_BITS) // n_ranges) for r in range(n_ranges)]

    def unit_rows(unit: int, held: list) -> pa.RecordBatch:
        sizes = np.array([len(t) for _, t, _ in held], np.int64)
        place = np.repeat(np.arange(len(held), dtype=U64), sizes)
        x = np.concatenate([t for _, t, _ in held]) >> U64(_LOW) << U64(_LOW)
        x |= place << U64(_FLAGS) | np.concatenate([f for _, _, f in held])
        x.sort()
        same = x >> U64(_FLAGS)
        new = np.ones(len(x), bool)
        new[1:] = same[1:] != same[:-1]
        if not new.all():
            x = np.bitwise_or.reduceat(x, np.flatnonzero(new))
        images = np.bincount((x >> U64(_FLAGS) & U64((1 << _PLACES) - 1)).astype(np.int64), minlength=len(held))
        key = x >> U64(_LOW)
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        count = np.diff(np.append(at, len(key)))
        one = np.repeat(count == 1, count)
        single, several, counts = x[one], key[at[count > 1]], count[count > 1].astype(np.uint32)
        ids = np.array([d for d, _, _ in held], np.int64)
        rows = [(-1 - unit, unit, ids.tobytes(), sizes.tobytes(), images.astype(np.int64).tobytes(), _packed(x[~one]) if len(several) else None, None, None)]
        bounds = np.array(starts, U64)
        s, m = [*np.searchsorted(single, bounds << U64(_LOW)).tolist(), len(single)], [*np.searchsorted(several, bounds).tolist(), len(several)]
        for r in range(n_ranges):
            if s[r + 1] > s[r] or m[r + 1] > m[r]:
                rows.append((r, unit, None, None, None, _packed(single[s[r] : s[r + 1]]) if s[r + 1] > s[r] else None, several[m[r] : m[r + 1]].tobytes(), counts[m[r] : m[r + 1]].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array([row[i] for row in rows], t) for i, t in enumerate(types)], names)

    def deal(batches):
        unit, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for s in slices(batch, lower=True):
                for doc, t in zip(s.ids.tolist(), s.shingle_sets(k), strict=True):
                    if len(t):
                        flags = np.zeros(len(t), U64)
                        p = prefix_size(len(t), percent)
                        for j, seed in enumerate(ORDER_SEEDS):
                            place = mix(t ^ U64(seed))
                            flags |= (place <= np.partition(place, p - 1)[p - 1]).astype(U64) << U64(j)
                        held.append((doc, t, flags))
                        size += len(t)
                if size >= UNIT_TOKENS:
                    yield unit_rows(unit, held)
                    unit, held, size = unit + 1, [], 0
        if held:
            yield unit_rows(unit, held)

    back = ["unit", "ids", "sizes", "images", "single", "single_n", "several", "several_n"]

    def count(table: pa.Table) -> pa.Table:
        if table["part"][0].as_py() < 0:
            empty = pa.array([None] * len(table), pa.binary())
            return pa.table([table["unit"], table["ids"], table["sizes"], table["images"], table["single"], empty, empty, empty], names=back)
        units, singles, severals, counts = (table[c].to_pylist() for c in ("unit", "single", "several", "counts"))
        singles = [_unpacked(x) if x else np.zeros(0, U64) for x in singles]
        severals = [np.frombuffer(x, U64) for x in severals]
        n = [len(x) for x in singles] + [len(x) for x in severals]
        keys = np.concatenate([x >> U64(_LOW) for x in singles] + severals)
        weight = np.concatenate([np.ones(sum(n[: len(singles)]), np.int64)] + [np.frombuffer(x, np.uint32).astype(np.int64) for x in counts])
        _, which = np.unique(keys, return_inverse=True)
        total = np.bincount(which, weights=weight).astype(np.int64)[which]
        ends = np.cumsum(n)
        rows = []
        for i, (unit, x, y) in enumerate(zip(units, singles, severals, strict=True)):
            tx, ty = total[ends[i] - len(x) : ends[i]], total[ends[i + len(units)] - len(y) : ends[i + len(units)]]
            more = tx > 1
            if more.any() or len(y):
                rows.append((unit, None, None, None, _packed(x[more]) if more.any() else None, tx[more].astype(np.uint32).tobytes(), y.tobytes(), ty.astype(np.uint32).tobytes()))
        return pa.table([pa.array([r[i] for r in rows], pa.int64() if i == 0 else pa.binary()) for i in range(len(back))], names=back)

    def first_tokens(table: pa.Table) -> pa.Table:
        head = next(i for i, x in enumerate(table["ids"].to_pylist()) if x is not None)
        ids, sizes, images = (np.frombuffer(table[c][head].as_py(), np.int64) for c in ("ids", "sizes", "images"))
        rest = [i for i in range(len(table)) if i != head]
        own = table["single"][head].as_py()
        own = _unpacked(own) if own else np.zeros(0, U64)
        table = table.take(pa.array(rest, pa.int64()))
        single = np.concatenate([np.zeros(0, U64), *(_unpacked(x) for x in table["single"].to_pylist() if x)])
        several, total = _joined(table["several"], U64), _joined(table["several_n"], np.uint32)
        by = np.argsort(several)
        x = np.concatenate([single, own])
        n = np.concatenate([_joined(table["single_n"], np.uint32), total[by][np.searchsorted(several[by], own >> U64(_LOW))]])
        place, key = (x >> U64(_FLAGS) & U64((1 << _PLACES) - 1)).astype(np.int64), x >> U64(_LOW)
        alone = images - np.bincount(place, minlength=len(ids))
        left = prefix_size(sizes, percent) - alone
        keep = left[place] > 0
        x, n, place, key = x[keep], n[keep], place[keep], key[keep]
        by = np.lexsort((key, n, place))
        x, place, key = x[by], place[by], key[by]
        first = np.searchsorted(place, np.arange(len(ids) + 1))
        flags = (x & U64((1 << _FLAGS) - 1)).astype(np.int64)
        marked = np.flatnonzero(flags)
        marks = key[marked].astype(np.int64) << _FLAGS | flags[marked]
        bounds = np.searchsorted(marked, first)
        some = np.flatnonzero(first[1:] > first[:-1])
        key = key.astype(np.int64)
        lists = [key[first[i] : min(first[i + 1], first[i] + left[i])] for i in some.tolist()]
        signs = [marks[bounds[i] : bounds[i + 1]] for i in some.tolist()]
        longs = pa.list_(pa.int64())
        return pa.table({"doc_id": ids[some], "n": sizes[some], "lost": (sizes - images)[some], "own": alone[some], "keys": pa.array(lists, longs), "marks": pa.array(signs, longs)})

    dealt = docs.mapInArrow(deal, "part long, unit long, ids binary, sizes binary, images binary, single binary, several binary, counts binary")
    counted = dealt.groupBy("part").applyInArrow(count, "unit long, ids binary, sizes binary, images binary, single binary, single_n binary, several binary, several_n binary")
    return counted.groupBy("unit").applyInArrow(first_tokens, "doc_id long, n long, lost long, own long, keys array<long>, marks array<long>")


def set_digests(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n, d1, d2): size and 128-bit digest of each document's set."""

    def run(batches):
        for batch in batches:
            for s in slices(batch, lower=True):
                n, d1, d2 = [], [], []
                for tokens in s.shingle_sets(k):
                    n.append(len(tokens))
                    d1.append(np.add.reduce(mix(tokens), dtype=U64))
                    d2.append(np.bitwise_xor.reduce(mix(tokens ^ U64(0x5851F42D4C957F2D)), dtype=U64))
                yield pa.RecordBatch.from_arrays([pa.array(s.ids), pa.array(np.array(n, np.int64)), pa.array(np.array(d1, U64).view(np.int64)), pa.array(np.array(d2, U64).view(np.int64))], ["doc_id", "n", "d1", "d2"])

    return docs.mapInArrow(run, "doc_id long, n long, d1 long, d2 long")


def shingle_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(doc_id, tokens) of the wanted documents. Few ids are broadcast; more are joined with compressed texts."""

    def batch_of(s):
        return pa.RecordBatch.from_arrays([pa.array(s.ids), pa.array([x.view(np.int64) for x in s.shingle_sets(k)], pa.list_(pa.int64()))], ["doc_id", "tokens"])

    def plain(batches):
        yield from (batch_of(s) for batch in batches for s in slices(batch, lower=True))

    def packed(batches):
        yield from (batch_of(s) for batch in batches for _, _, s in packed_slices(batch, lower=True))

    schema = "doc_id long, tokens array<long>"
    if wanted.count() <= BROADCAST_IDS:
        return docs.join(F.broadcast(wanted), "doc_id", "left_semi").mapInArrow(plain, schema)
    return packed_text(docs).join(wanted, "doc_id", "left_semi").mapInArrow(packed, schema)


def _chosen(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """The documents (doc_id, text) with these ids in an order that a repeated task meets again, and tables to drop."""
    if ids.count() <= BROADCAST_IDS:
        return docs.join(F.broadcast(ids), "doc_id", "left_semi"), []

    def unpacked(batches):
        decompress = zstandard.ZstdDecompressor().decompress
        for b in batches:
            for i in range(0, len(b), 64):
                part = b.slice(i, 64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([decompress(z) for z in part.column(1).to_pylist()], pa.binary())], ["doc_id", "text"])

    kept = materialize(packed_text(docs).join(ids, "doc_id", "left_semi"), "texts")
    return kept.mapInArrow(unpacked, "doc_id long, text binary"), [kept]


def jaccard_join(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    Words are runs without ASCII white space, A-Z lower-cased; a document's set holds its distinct k-word shingles, or
    its whole sequence where it has fewer words. Two documents link when 100 * intersection >= percent * union;
    component_id is the smallest doc_id that links reach. Null and empty texts have an empty set and link with nothing;
    rows without a doc_id are left out; a repeated doc_id keeps its rows, each with the size of its own text, in one
    component of all of them. Equal sets are joined by digest, so copies meet no pairwise work. An empty table gives no
    rows; other columns are ignored; a very long text is one set like any other.

    Candidates must share a first token under every order: by rarity, counted over all sets, and by two hashes. Under
    rarity a set whose own tokens fill its prefix has no candidates at all, so passages that many documents share make
    none. In each token's group everyone is first compared with one member, the hub: the one with
    the least share of tokens of its own, such as the text that the others are edited from; what that links is one part. Then pairs are only made between parts, at the first token that both have
    and where enough is left behind it; a later token makes a pair again only if none of the KEYS_BEFORE before it is shared. Pairs are judged on their whole sets of 64-bit shingle hashes.
    """
    docs = ids_and_texts(docs).where("doc_id is not null")
    sizes = materialize(set_digests(docs, k).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(64)).cast("int")), "sets")
    # each kind of set by salts first, so that many copies meet in no one place
    salted = sizes.where("n > 0").groupBy("n", "d1", "d2", "salt").agg(F.min("doc_id").alias("least"))
    kinds = salted.groupBy("n", "d1", "d2").agg(F.min("least").alias("rep"))
    kinds = materialize(salted.select("n", "d1", "d2", "salt").join(kinds, ["n", "d1", "d2"]), "kinds")
    reps = materialize(kinds.select(F.col("rep").alias("doc_id")).distinct(), "reps")
    tokens = kinds.groupBy("n", "d1", "d2").agg(F.first("n").alias("m")).agg(F.sum("m")).first()[0] or 0

    chosen, made = _chosen(docs, reps)
    live = materialize(prefixes(chosen, k, percent, tokens), "live")
    drop(reps, *made)
    links = _links(docs, live, k, percent)
    component = connected_components(links)
    drop(live, links)

    rep = sizes.where("n > 0").join(kinds, ["n", "d1", "d2", "salt"]).select("doc_id", "rep")
    rep = rep.join(component.withColumnRenamed("id", "rep"), "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("component"))
    own = rep.groupBy("doc_id").agg(F.min("component").alias("component"))
    return sizes.join(own, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def _links(docs: DataFrame, live: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) that connect all sets that links connect, from prefixes(); not every link of a part is among them."""
    # Sizes must allow a link, and so must the places of the first token that two sets share under rarity: behind it
    # there must be enough. Under an order by hash the set whose prefix ends first shares with the other what the
    # prefixes share and its own rest; as it isn't known which that is, the longer counts.
    overlap = f"ceil({percent} * (n1 + n2) / {100 + percent})"
    sizes_allow = f"100 * n1 >= {percent} * n2 and 100 * n2 >= {percent} * n1"
    places_allow = f"{sizes_allow} and least(n1 - i1, n2 - i2) >= {overlap}"
    need = f"{overlap} - (ceil({percent} * greatest(n1, n2) / 100) - 1) - c1 - c2"
    bit = lambda marks, j: f"transform(filter({marks}, x -> x & {1 << j} > 0), x -> shiftright(x, {_FLAGS}))"
    tokens_allow = " and ".join(f"size(array_intersect({bit('m1', j)}, {bit('m2', j)})) >= greatest(1, {need})" for j in range(_FLAGS))

    def judged(pairs: DataFrame, links: DataFrame) -> DataFrame:
        """links and those of the pairs."""
        pairs = materialize(pairs.distinct(), "pairs")
        hot = hot_keys(pairs, "a", pairs.count())
        wanted = materialize(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "wanted")
        sets = shingle_sets(docs, wanted, k).join(live.select("doc_id", "n", "lost", "marks").distinct(), "doc_id")
        sets = materialize(sets.where("size(tokens) = n"), "shingles")
        left, right = (sets.select(*[F.col(c).alias(f"{name}{i}") for c, name in (("n", "n"), ("lost", "c"), ("marks", "m"), ("tokens", "t"))], F.col("doc_id").alias(d)) for i, d in ((1, "a"), (2, "b")))
        met = hot_join(pairs, left, "a", hot).join(right, "b").where(f"{sizes_allow} and {tokens_allow}")
        similar = met.withColumn("i", F.size(F.array_intersect("t1", "t2"))).where(f"100 * i >= {percent} * (n1 + n2 - i)")
        found = materialize(links.union(similar.select("a", "b")).distinct(), "links")
        drop(pairs, hot, wanted, sets, links)
        return found

    # A key's row holds the last keys before it: where two sets have one of these in common, their pair was made before.
    # All keys before each would take the square of a prefix; a pair that is made again for want of them goes by distinct().
    before = F.slice("keys", F.greatest(F.lit(1), F.col("i") - KEYS_BEFORE + 1), F.least(F.col("i"), F.lit(KEYS_BEFORE))).alias("before")
    rows = live.select("doc_id", "n", "own", "keys", F.posexplode("keys").alias("i", "key")).select("doc_id", "n", "own", (F.col("own") + F.col("i")).alias("i"), "key", before)
    groups = rows.groupBy("key").agg(F.min_by(F.struct("doc_id", "n", "i"), F.struct(F.col("own") / F.col("n"), F.xxhash64("doc_id"), "doc_id")).alias("hub"), F.min("doc_id").alias("p"), F.max("doc_id").alias("q"), F.count("*").alias("size")).where("p < q")
    groups = materialize(groups.select("key", "size", F.col("hub.doc_id").alias("a"), F.col("hub.n").alias("n1"), F.col("hub.i").alias("i1")), "groups")
    n_rows = groups.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    hot = materialize(groups.where(F.col("size") >= max(HOT_ROWS, n_rows // HOT_KEYS)).select("key"), "hot")
    token = materialize(hot_join(rows, groups.drop("size"), "key", hot), "tokens")
    none = token.select("a", F.col("doc_id").alias("b")).where("false")
    to_hub = token.where("doc_id <> a").select("a", F.col("doc_id").alias("b"), "n1", "i1", F.col("n").alias("n2"), F.col("i").alias("i2"))
    near = to_hub.where(places_allow)
    links = judged(near.select("a", "b"), none)
    part = connected_components(links).withColumnRenamed("id", "doc_id")
    parted = token.where("doc_id <> a").drop("a", "n1", "i1").join(part, "doc_id", "left").withColumn("part", F.coalesce("component", "doc_id"))
    x, y = (parted.select("key", F.col("doc_id").alias(d), F.col("part").alias("p" + d), F.col("n").alias(f"n{j}"), F.col("i").alias(f"i{j}"), F.col("before").alias(f"e{j}")) for j, d in ((1, "a"), (2, "b")))
    rest = x.join(y, "key").where(f"a < b and pa <> pb and {places_allow} and not arrays_overlap(e1, e2)").select("a", "b")
    found = judged(rest, links)
    drop(groups, hot, token)
    return found


def brute_force(rows: list[tuple[int, str | None]], k: int, percent: int) -> list[tuple[int, int, int]]:
    """The same by comparing all pairs; for tests."""
    import re

    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set())
    near: dict[int, set[int]] = {d: {d} for d, _ in rows}
    for i, (a, _) in enumerate(rows):
        for j, (b, _) in enumerate(rows[:i]):
            if (sets[i] or sets[j]) and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                near[a].add(b)
                near[b].add(a)
    component: dict[int, int] = {}
    heap = sorted(near)
    heapq.heapify(heap)
    while heap:
        root = heapq.heappop(heap)
        todo = [] if root in component else [root]
        while todo:
            x = todo.pop()
            if x not in component:
                component[x] = root
                todo.extend(near[x])
    return [(d, len(s), component[d]) for (d, _), s in zip(rows, sets, strict=True)]
