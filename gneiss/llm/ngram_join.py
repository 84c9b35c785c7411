"""N-gram Jaccard join: documents whose sets of word n-grams are similar, by a prefix-tree join.

Exact at any size, and no step lists the pairs of a group:

1.  n-grams are dealt to buckets by hash, each once for a task, to learn which occur in one
    document only. A linked document shares at least ``percent`` of its n-grams, so most
    documents leave here.
2.  Of equal sets the smallest id stays (they link at once). The rest get exact document
    frequencies, the global order: rare first, then by hash. Two linked sets share one of their
    first n - ceil(percent * n) + 1 n-grams; documents that share such a one, with sizes near
    enough (or bridged by others), fall into one block.
3.  Each block's sets are stored in a trie and joined by walking it (trie.py). A large block is
    dealt into shards; shards are joined within, then representatives of what they found, then
    only documents outside the block's main component, each against the shards that hold an
    n-gram of its prefix.
4.  Links, a spanning forest of the classes, become components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .components import components
from .textnum import mix, shingle_sets
from .trie import join

N, PERCENT = 5, 80
#: N-grams that a bucket or a flush holds in memory.
BUCKET = 2_000_000
#: Documents and n-grams of a shard.
SHARD_DOCS, SHARD_GRAMS = 1024, 2_000_000
#: Minor documents probed against a shard in one task.
MINORS = 512
#: Bits of the filter of wanted ids; fixed, so it may be broadcast. Where it is too full it only filters less.
FILTER_BITS = 1 << 24
_ROWS = "key long, uid long, a binary, b binary, c binary"
_SCHEMA = pa.schema([("key", pa.int64()), ("uid", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 5, _SCHEMA, strict=True)], schema=_SCHEMA)


def _batches(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    """A flush in some 64 batches, or of 64 rows each: with many buckets rows are many and small."""
    step = max(64, len(rows) // 64)
    for i in range(0, len(rows), step):
        yield _batch(rows[i : i + step])


def _table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([_batch(rows)])


def _bucket(tokens: np.ndarray, buckets: int) -> np.ndarray:
    """Of the upper 32 bits; the lower 32 tell n-grams of a bucket apart."""
    return ((tokens >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _runs(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    """(bucket, slice) of an ascending array."""
    if len(bucket):
        at = np.flatnonzero(np.diff(bucket)) + 1
        for a, b in pairwise([0, *at.tolist(), len(bucket)]):
            yield int(bucket[a]), slice(a, b)


def _within(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Whether each value is among those (sorted)."""
    if not len(among):
        return np.zeros(len(values), bool)
    at = np.searchsorted(among, values)
    return among[np.minimum(at, len(among) - 1)] == values


def _repeated(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    again = values[1:][values[1:] == values[:-1]]
    return again[np.concatenate(([True], again[1:] != again[:-1]))] if len(again) else again


def _flushes(batches: Iterator[pa.RecordBatch], n: int, most_docs: int, most_grams: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """(uid, ids, null ids, sets) of runs of documents that fit in memory; uid is the same when a task runs again."""
    uid, ids, null, sets, held = TaskContext.get().partitionId() << 24, [], [], [], 0
    for batch in batches:
        column = batch.column(0)
        keys, missing = column.fill_null(0).to_numpy(zero_copy_only=False), column.is_null().to_numpy(zero_copy_only=False)
        for key, gone, grams in zip(keys.tolist(), missing.tolist(), shingle_sets(batch.column(1), n), strict=True):
            ids.append(key)
            null.append(gone)
            sets.append(grams)
            held += len(grams)
            if len(ids) >= most_docs or held >= most_grams:
                yield uid, np.array(ids, np.int64), np.array(null), sets
                uid, ids, null, sets, held = uid + 1, [], [], [], 0
    if ids:
        yield uid, np.array(ids, np.int64), np.array(null), sets


def _sizes(docs: DataFrame, buckets: int, n: int, percent: int) -> DataFrame:
    """id (may be null), n, p1, p2 (fingerprint of the set), maybe: whether enough of its n-grams occur elsewhere."""

    def deal(batches):
        for uid, ids, null, sets in _flushes(batches, n, 60_000, BUCKET):
            sizes = np.array([len(s) for s in sets])
            print_ = np.array([(s.sum(dtype=np.uint64), mix(s).sum(dtype=np.uint64)) if len(s) else (0, 0) for s in sets], np.uint64)
            grams, doc = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.uint16), sizes)
            grams, doc = grams[~null[doc]], doc[~null[doc]]
            again = _repeated(grams)
            twice = _within(grams, again)
            local = np.bincount(doc[twice], minlength=len(sets)).astype(np.uint32)
            grams, doc = grams[~twice], doc[~twice]
            bucket = _bucket(grams, buckets).astype(np.uint32)
            order = np.argsort(bucket, kind="stable")  # by document within a bucket, which compresses well
            low, doc, many = (grams[order] & np.uint64(0xFFFFFFFF)).astype(np.uint32), doc[order], dict(_runs(_bucket(again, buckets)))
            once = dict(_runs(bucket[order]))
            low_again = (again & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            rows = [(-1, uid, np.concatenate([ids, sizes]).astype(np.int64).tobytes(), np.concatenate([local, null.astype(np.uint32)]).astype(np.uint32).tobytes(), print_.tobytes())]
            for k in sorted(once.keys() | many.keys()):
                x, y = once.get(k, slice(0, 0)), many.get(k, slice(0, 0))
                rows.append((k, uid, low[x].tobytes(), doc[x].tobytes(), low_again[y].tobytes()))
            yield from _batches(rows)

    def count(key, table):
        if key[0].as_py() < 0:
            return table.select(_SCHEMA.names)
        uids, low, doc, many = (table.column(c).to_pylist() for c in ("uid", "a", "b", "c"))
        low = [np.frombuffer(x, np.uint32) for x in low]
        many = [np.frombuffer(x, np.uint32) for x in many]
        again = _repeated(np.concatenate([*low, *many, *many]))
        rows = []
        for uid, grams, docs_ in zip(uids, low, doc, strict=True):
            counts = np.bincount(np.frombuffer(docs_, np.uint16)[_within(grams, again)])
            at = np.flatnonzero(counts)
            if len(at):
                rows.append((0, uid, at.astype(np.uint16).tobytes(), counts[at].astype(np.uint32).tobytes(), b""))
        return _table(rows)

    def gather(key, table):
        own, shared = None, []
        for k, a, b, c in zip(*(table.column(x).to_pylist() for x in ("key", "a", "b", "c")), strict=True):
            if k < 0:
                own = np.frombuffer(a, np.int64), np.frombuffer(b, np.uint32), np.frombuffer(c, np.int64)
            else:
                shared.append((np.frombuffer(a, np.uint16), np.frombuffer(b, np.uint32)))
        (ids, sizes), (local, null) = np.split(own[0], 2), np.split(own[1], 2)
        total = local.astype(np.int64)
        for at, counts in shared:
            total[at] += counts
        prints = own[2].reshape(-1, 2)
        maybe = (total * 100 >= percent * sizes) & (sizes > 0) & (null == 0)
        return pa.table({"id": pa.array(ids, mask=null > 0), "n": sizes, "p1": prints[:, 0], "p2": prints[:, 1], "maybe": maybe})

    # tables of a flush carry the key -1: they pass by their uid, not all through one group
    dealt = docs.mapInArrow(deal, _ROWS).withColumn("group", F.when(F.col("key") < 0, -1 - F.col("uid")).otherwise(F.col("key")))
    counted = dealt.groupBy("group").applyInArrow(count, _ROWS)
    return counted.groupBy("uid").applyInArrow(gather, "id long, n long, p1 long, p2 long, maybe boolean")


def _wanted(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs joined with ids on id; a filter of fixed size keeps most other texts out of the shuffle."""

    def marks(batches):
        for batch in batches:
            bit = mix(batch.column(0).to_numpy().astype(np.uint64)) % np.uint64(FILTER_BITS)
            word, at = np.unique(bit >> np.uint64(6), return_inverse=True)
            value = np.zeros(len(word), np.uint64)
            np.bitwise_or.at(value, at, np.uint64(1) << (bit & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(value.view(np.int64))], names=["word", "value"])

    bits = np.zeros(FILTER_BITS // 64, np.uint64)
    for word, value in ids.select("id").mapInArrow(marks, "word long, value long").groupBy("word").agg(F.bit_or("value")).toPandas().itertuples(index=False):
        bits[word] = np.int64(value).view(np.uint64)
    bits = docs.sparkSession.sparkContext.broadcast(bits)

    def choose(batches):
        have = bits.value
        for batch in batches:
            bit = mix(batch.column(0).to_numpy().astype(np.uint64)) % np.uint64(FILTER_BITS)
            yield batch.filter(pa.array(((have[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1)).astype(bool)))

    return docs.filter("id IS NOT NULL").mapInArrow(choose, "id long, text string").join(ids, "id")


def _stars(tokens: np.ndarray, low: np.ndarray, high: np.ndarray, hub: np.ndarray, percent: int):
    """Of each token's intervals of sizes, those that overlap once widened to compatible sizes: (token, low, high, hub) of each run, and links to its hub."""
    order = np.lexsort((low, tokens))
    tokens, low, high, hub = tokens[order], low[order], high[order], hub[order]
    _, group = np.unique(tokens, return_inverse=True)
    # the largest size so far of the same token: sizes are below 2**40
    reach = np.maximum.accumulate((group << 40) + high)
    new = np.ones(len(tokens), bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (low[1:] * percent > (reach[:-1] - (group[:-1] << 40)) * 100)
    at = np.flatnonzero(new)
    least = np.minimum.reduceat(hub, at)
    of = np.repeat(least, np.diff([*at.tolist(), len(tokens)]))
    pairs = np.unique(np.stack([hub, of], 1)[hub != of], axis=0)
    return (tokens[at], low[at], np.maximum.reduceat(high, at), least), pairs


def _posted(docs: DataFrame, buckets: int, n: int, percent: int, post) -> DataFrame:
    """The rows that ``post(uid, ids, sizes, tokens, doc)`` makes of the prefixes of each run of documents.

    The global order is that of these documents: n-grams of fewer documents first, then by hash.
    Prefixes leave out n-grams of one document only.
    """

    def deal(batches):
        for uid, ids, _, sets in _flushes(batches, n, 1 << 30, BUCKET):
            tokens, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
            sizes = np.array([len(s) for s in sets])
            rows = [(-1, uid, np.concatenate([ids, sizes]).astype(np.int64).tobytes(), inverse.astype(np.uint32).tobytes(), tokens.tobytes())]
            for k, at in _runs(_bucket(tokens, buckets)):
                rows.append((k, uid, (tokens[at] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes(), counts[at].astype(np.uint32).tobytes(), b""))
            yield from _batches(rows)

    def count(key, table):
        if key[0].as_py() < 0:
            return table.select(_SCHEMA.names)
        uids, low, counts = (table.column(c).to_pylist() for c in ("uid", "a", "b"))
        low, counts = [np.frombuffer(x, np.uint32) for x in low], [np.frombuffer(x, np.uint32) for x in counts]
        _, at = np.unique(np.concatenate(low), return_inverse=True)
        total = np.bincount(at, weights=np.concatenate(counts))[at].astype(np.uint32)
        cuts = np.cumsum([len(x) for x in low])[:-1]
        return _table([(key[0].as_py(), uid, x.tobytes(), b"", b"") for uid, x in zip(uids, np.split(total, cuts), strict=True)])

    def prefixes(key, table):
        own, parts = None, []
        for k, a, b, c in zip(*(table.column(x).to_pylist() for x in ("key", "a", "b", "c")), strict=True):
            if k < 0:
                own = np.frombuffer(a, np.int64), np.frombuffer(b, np.uint32), np.frombuffer(c, np.uint64)
            else:
                parts.append((k, a))
        (ids, sizes), inverse, tokens = np.split(own[0], 2), own[1], own[2]
        frequency = np.frombuffer(b"".join(a for _, a in sorted(parts)), np.uint32)
        # tokens are in order of their hash, so (frequency, place) is the global order
        place = (frequency[inverse].astype(np.int64) << 32) + inverse
        chosen, doc, at = [], [], 0
        for i, size in enumerate(sizes.tolist()):
            first = np.sort(place[at : at + size])[: size - -(-percent * size // 100) + 1]
            first = first[first >> 32 > 1]
            chosen.append(first & 0xFFFFFFFF)
            doc.append(np.full(len(first), i))
            at += size
        chosen, doc = np.concatenate(chosen), np.concatenate(doc)
        return post(key[0].as_py(), ids, sizes, tokens[chosen], doc.astype(np.int64))

    group = F.when(F.col("key") < 0, -1 - F.col("uid")).otherwise(F.col("key"))
    counted = docs.mapInArrow(deal, _ROWS).withColumn("group", group).groupBy("group").applyInArrow(count, _ROWS)
    return counted.groupBy("uid").applyInArrow(prefixes, _ROWS)


def _block_links(docs: DataFrame, buckets: int, n: int, percent: int) -> DataFrame:
    """Links (a, b) whose components hold all linked pairs: blocks."""

    def post(uid, ids, sizes, tokens, doc):
        if not len(tokens):
            return _table([])
        (token, low, high, hub), pairs = _stars(tokens, sizes[doc], sizes[doc], ids[doc], percent)
        rows = [(-1, uid, pairs[:, 0].tobytes(), pairs[:, 1].tobytes(), b"")] if len(pairs) else []
        for k, at in _runs(_bucket(token, buckets)):
            rows.append((k, uid, token[at].tobytes(), np.concatenate([low[at], high[at]]).tobytes(), hub[at].tobytes()))
        return _table(rows)

    def meet(key, table):
        a, b, c = (table.column(x).to_pylist() for x in ("a", "b", "c"))
        if key[0].as_py() < 0:
            pairs = np.stack([np.frombuffer(b"".join(a), np.int64), np.frombuffer(b"".join(b), np.int64)], 1)
        else:
            low, high = zip(*(np.split(np.frombuffer(x, np.int64), 2) for x in b), strict=True)
            _, pairs = _stars(np.frombuffer(b"".join(a), np.uint64), np.concatenate(low), np.concatenate(high), np.frombuffer(b"".join(c), np.int64), percent)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    group = F.when(F.col("key") < 0, -1 - F.col("uid")).otherwise(F.col("key"))
    return _posted(docs, buckets, n, percent, post).withColumn("group", group).groupBy("group").applyInArrow(meet, "a long, b long")


def _prefix_tokens(docs: DataFrame, buckets: int, n: int, percent: int) -> DataFrame:
    """(id, token): the n-grams of each document's prefix. Two linked documents have one in common."""

    def post(uid, ids, sizes, tokens, doc):
        return _table([(0, uid, ids[doc].tobytes(), tokens.tobytes(), b"")])

    def rows(batches):
        for batch in batches:
            for a, b in zip(batch.column(0), batch.column(1), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x.as_py(), np.int64)) for x in (a, b)], names=["id", "token"])

    return _posted(docs, buckets, n, percent, post).select("a", "b").mapInArrow(rows, "id long, token long")


def _joined(docs: DataFrame, keys: list[str], n: int, percent: int) -> DataFrame:
    """Links of docs (id, text, block, and maybe probe, component) within a block, for each group of the keys in one task.

    With a column ``probe`` those rows are probed against the others, else all with all.
    """
    probing = "probe" in docs.columns

    def run(_, table):
        table = table.combine_chunks()
        blocks, ids = table.column("block").to_numpy(), table.column("id").to_numpy()
        order = np.lexsort((ids, blocks))
        found = []
        for _, at in _runs(blocks[order]):
            rows = order[at]
            if probing:
                probe = table.column("probe").to_numpy()[rows]
                rows = np.concatenate([rows[~probe], rows[probe]])
                group = table.column("component").to_numpy()[rows]
                one = {c: i for i, c in reversed(list(enumerate(group.tolist())))}
                extra = {"probes": range(int((~probe).sum()), len(rows)), "component": [one[c] for c in group.tolist()]}
            else:
                extra = {}
            sets = list(shingle_sets(table.column("text").take(pa.array(rows)), n))
            found += [(ids[rows[i]], ids[rows[j]]) for i, j in join(sets, percent, **extra)]
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return docs.groupBy(*keys).applyInArrow(run, "a long, b long")


def _large(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Links within large blocks. docs: id, text, n, block, shards."""
    docs = docs.withColumn("shard", F.pmod(F.xxhash64("id"), F.col("shards")))
    links = cut(_joined(docs.select("id", "text", "block", "shard"), ["block", "shard"], n, percent))
    # one document for each component of a shard, those of a block dealt again
    root = components(links)
    rest = docs.join(root, docs.id == root.node, "left").filter("node IS NULL OR node = root").drop("node", "root")
    again = rest.groupBy("block").agg(F.count("*").alias("c"), F.sum("n").alias("s")).select("block", _shards("c", "s").alias("again"))
    rest = rest.join(again, "block").withColumn("shard", F.pmod(F.xxhash64(F.lit(1), "id"), F.col("again")))
    links = cut(links.union(_joined(rest.select("id", "text", "block", "shard"), ["block", "shard"], n, percent)))
    # what is outside a block's main component meets every shard
    root = components(links)
    label = docs.select("id", "block", "n", "shards").join(root, F.col("id") == F.col("node"), "left").select("id", "block", "shards", F.coalesce("root", "id").alias("component"))
    main = label.groupBy("block", "component").agg(F.count("*").alias("c")).groupBy("block").agg(F.max_by("component", F.struct("c", "component")).alias("main"))
    label = cut(label.join(main, "block").withColumn("probe", F.col("component") != F.col("main")))
    if label.filter("probe").isEmpty():
        return links
    # only shards that hold an n-gram of its prefix can hold a document linked with it
    held = docs.select(F.col("id").alias("i"), "text", "shard").join(label, F.col("i") == F.col("id")).drop("i", "shards")
    grams = docs.agg(F.sum("n")).first()[0] or 0
    token = cut(_prefix_tokens(docs.select("id", "text"), _buckets(grams), n, percent).join(held.select(F.col("id").alias("i"), "block", "shard", "probe"), F.col("id") == F.col("i")).drop("i"))
    route = token.filter("probe").select("id", "block", "token").join(token.select("block", "token", "shard").distinct(), ["block", "token"]).select("id", "shard").distinct()
    asked = cut(held.filter("probe").drop("shard").join(route, "id"))
    chunk = asked.groupBy("block", "shard").agg(F.ceil(F.count("*") / MINORS).alias("chunks"))
    asked = asked.join(chunk, ["block", "shard"]).withColumn("chunk", F.pmod(F.xxhash64(F.lit(2), "id"), F.col("chunks")))
    held = held.withColumn("probe", F.lit(False)).join(chunk, ["block", "shard"]).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    names = ["id", "text", "block", "component", "probe", "shard", "chunk"]
    return links.union(_joined(held.select(*names).union(asked.select(*names)), ["block", "shard", "chunk"], n, percent))


def _shards(docs: str, grams: str):
    return F.greatest(F.ceil(F.col(docs) / SHARD_DOCS), F.ceil(F.col(grams) / SHARD_GRAMS))


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, percent: int = PERCENT) -> DataFrame:
    """id, n_shingles (size of the set), component_id (smallest id reachable by links, itself included).

    A document's set: the distinct n-grams of its words (runs without white space, A-Z lower-cased);
    with fewer words the whole sequence; null or blank text has none and links with nothing. Two
    documents link when 100 * |intersection| >= percent * |union|.

    Ids are integers. Rows that repeat an id count as that one document for links; each returns a
    row. A null id links with nothing and has a null component. An empty table gives no rows.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    grams = (docs.agg(F.sum(F.length("text"))).first()[0] or 0) // 6
    table = cut(_sizes(docs, _buckets(grams), n, percent))
    classes = table.filter("n > 0 AND id IS NOT NULL").groupBy("p1", "p2").agg(F.min("id").alias("first"), F.max("maybe").alias("maybe"), F.max("n").alias("n"))
    wanted = cut(classes.filter("maybe").groupBy(F.col("first").alias("id")).agg(F.max("n").alias("n")))
    grams = wanted.agg(F.sum("n")).first()[0] or 0
    rows = cut(_wanted(docs, wanted))
    block = components(_block_links(rows.select("id", "text"), _buckets(grams), n, percent)).select(F.col("node").alias("id"), F.col("root").alias("block"))
    block = cut(block.join(wanted, "id"))
    size = block.groupBy("block").agg(F.count("*").alias("c"), F.sum("n").alias("s")).select("block", _shards("c", "s").alias("shards"), "s")
    rows = cut(rows.drop("n").join(block, "id").join(size, "block"))
    few = rows.filter("shards = 1")
    bins = _buckets(grams)
    links = _joined(few.select("id", "text", "block", F.pmod(F.xxhash64("block"), F.lit(bins)).alias("bin")), ["bin"], n, percent)
    many = rows.filter("shards > 1")
    if not many.isEmpty():
        links = links.union(_large(many, n, percent))
    twice = cut(table.filter("n > 0 AND id IS NOT NULL").groupBy("id").agg(F.min("p1").alias("x"), F.max("p1").alias("y")).filter("x <> y").select(F.col("id").alias("i")))
    if not twice.isEmpty():  # ids of several rows with different sets link the classes of these
        held = table.join(twice, F.col("id") == F.col("i")).select("id", "p1", "p2").join(classes, ["p1", "p2"]).groupBy("id").agg(F.collect_set("first").alias("s"))
        links = links.union(held.select(F.array_min("s").alias("a"), F.explode("s").alias("b")))
    root = components(links).select(F.col("node").alias("first"), "root")
    classes = classes.select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), "first").join(root, "first", "left").select("q1", "q2", F.coalesce("root", "first").alias("least"))
    # without a set there is no class; a null id has none either
    out = table.join(classes, (F.col("n") > 0) & (F.col("p1") == F.col("q1")) & (F.col("p2") == F.col("q2")), "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("least", "id")).alias("component_id"))


def _buckets(grams: int) -> int:
    return int(max(4, -(-grams // BUCKET)))
