"""Jaccard self-join of documents on word n-grams: prefixes of token combinations, then verification."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratefield.llm.common import Scratch, Words, distinct_by_doc, documents, mix64, shuffle_partitions, slices, small_batches, task, text_bytes
from ratefield.llm.graph import components, forest_roots

WORDS = 5
#: A token is frequent, and enters by pairs, from so many sets on; by triples from the second number on.
FREQUENT = (16, 4096)
#: Sets of under 2**SMALL_LEVEL tokens are indexed by single tokens throughout.
SMALL_LEVEL = 4
#: Representatives up to this number are broadcast (8 bytes each) to fetch their texts; more are joined by a shuffle.
BROADCAST_ROWS = 1 << 21
#: Parents that more sets have, of those met at a set's keys: so many of the largest are tried in place of its own.
SHARED = 3
#: Tokens that a task gathers before it sends them, and documents (two bytes number them; the last number means "known").
_CHUNK, _CHUNK_DOCS, _KNOWN = 1 << 19, 65_000, 65_535
_SLICE = 1 << 20


def _sets(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The token sets of a batch: hashes as signed numbers in rising order, and each document's offset."""
    words = Words(*text_bytes(batch.column("text")))
    h, doc = words.shingles(WORDS)
    return distinct_by_doc(h.view(np.int64), doc, batch.num_rows)


def _signatures(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of each set."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(h.view(np.uint64) ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])
    n = np.diff(at)
    return mix64(total[at[1:]] - total[at[:-1]] + n.astype(np.uint64)).view(np.int64)


def _ranges(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions of the first size[i] entries from each at[i]."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size, size) + np.repeat(at, size)


# Which sets may have a partner: half of each set's tokens are counted.
#
# Two sets at 0.75 or more lack at most n // 4 of each other's tokens. So if each set is cut, in one order of all
# tokens, to its first n // 4 + 1 + k tokens, the two cut sets share k + 1 tokens at least: the first k + 1 common ones
# lie in both. With k = n // 4, a set of which fewer than k + 1 such tokens occur in another cut set has no partner.


def _cut_tokens(buckets: int):
    """Rows of two kinds: for a bucket, the chunk's tokens there (5 bytes each) and whose they are (2 bytes each); and each document's row."""
    names = ["chunk", "bucket", "data", "m", "idx", "doc_id", "row", "n", "sig"]

    def flush(held):
        h = np.concatenate([x[0] for x in held])
        size = np.concatenate([x[1] for x in held])
        owner = np.repeat(np.arange(len(size)), size)
        v = (mix64(h.view(np.uint64)) >> np.uint64(16)).view(np.int64)
        order = np.argsort(v, kind="stable")
        v, owner = v[order], owner[order]
        first = np.ones(len(v), bool)
        first[1:] = v[1:] != v[:-1]
        count = np.diff(np.append(np.flatnonzero(first), len(v)))
        # a token that the chunk has twice is shared whatever other chunks have, and is sent once
        twice = np.repeat(count > 1, count)
        known = np.bincount(owner[twice], minlength=len(size))
        sent, whose = v[first], np.where(count > 1, _KNOWN, owner[first]).astype("<u2")
        bucket = ((sent >> 24) * buckets) >> 24
        some, begin = np.unique(bucket, return_index=True)
        ends = np.append(begin, len(sent))
        low = sent.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :5]
        blobs = [low[a:b].tobytes() + whose[a:b].tobytes() for a, b in itertools.pairwise(ends)]
        fields = [np.concatenate([x[k] for x in held]) for k in (2, 3, 4)]
        ids = pa.concat_arrays([x[5] for x in held])
        chunk = xxhash.xxh64_intdigest(fields[0].tobytes() + fields[1].tobytes()) >> 1
        k, d = len(some), len(size)
        yield pa.record_batch([pa.array(np.full(k, chunk, np.int64)), pa.array(some), pa.array(blobs, pa.binary()), pa.array(np.diff(ends)), *(pa.nulls(k, pa.int64()) for _ in range(5))], names)
        # m: what is known to be shared; the last document's row also tells what the chunk has sent
        m = known.astype(np.int64)
        yield pa.record_batch([pa.array(np.full(d, chunk, np.int64)), pa.array(np.full(d, chunk % buckets, np.int64)), pa.nulls(d, pa.binary()), pa.array(m), pa.array(np.arange(d)), ids, pa.array(fields[0]), pa.array(fields[1]), pa.array(fields[2])], names)
        yield pa.record_batch([pa.array([chunk]), pa.array([chunk % buckets]), pa.nulls(1, pa.binary()), pa.array([len(sent)]), *(pa.nulls(1, pa.int64()) for _ in range(5))], names)

    def run(batches):
        held, tokens, docs = [], 0, 0
        for batch in slices(batches, most=_SLICE):
            h, at = _sets(batch)
            n = np.diff(at)
            size = np.where(n > 0, 2 * (n // 4) + 1, 0)
            if held and docs + len(n) > _CHUNK_DOCS:
                yield from flush(held)
                held, tokens, docs = [], 0, 0
            held.append((h[_ranges(at[:-1], size)], size, batch.column("row").to_numpy(), n, _signatures(h, at), batch.column("doc_id")))
            tokens, docs = tokens + int(size.sum()), docs + len(n)
            if tokens >= _CHUNK:
                yield from flush(held)
                held, tokens, docs = [], 0, 0
        if held:
            yield from flush(held)

    return run


def _shared_in_bucket(batches):
    """Rows come by bucket. For each chunk's entry the documents (2 bytes each) whose token is in another place too, and m, the tokens that came."""
    held, bucket = [], None

    def counted():
        size = np.array([len(b) // 7 for _, b in held])
        raw = np.zeros((int(size.sum()), 8), np.uint8)
        raw[:, :5] = np.concatenate([np.frombuffer(b, np.uint8, 5 * k).reshape(-1, 5) for (_, b), k in zip(held, size.tolist(), strict=True)])
        whose = np.concatenate([np.frombuffer(b, "<u2", k, 5 * k) for (_, b), k in zip(held, size.tolist(), strict=True)])
        v = raw.view("<i8").ravel()
        _, place, count = np.unique(v, return_inverse=True, return_counts=True)
        shared = count > 1
        shared[place[whose == _KNOWN]] = True
        keep = shared[place] & (whose != _KNOWN)
        ends = np.cumsum(size)
        data = [whose[a:b][keep[a:b]].tobytes() for a, b in zip((ends - size).tolist(), ends.tolist(), strict=True)]
        k = len(held)
        return pa.record_batch([pa.array([c for c, _ in held], pa.int64()), pa.nulls(k, pa.int64()), pa.array(data, pa.binary()), pa.array(size), *(pa.nulls(k, pa.int64()) for _ in range(5))], batch.schema.names)

    for batch in batches:
        yield batch.filter(batch.column("data").is_null())
        rows = batch.filter(batch.column("data").is_valid())
        for b, chunk, blob in zip(rows.column("bucket").to_pylist(), rows.column("chunk").to_pylist(), rows.column("data").to_pylist(), strict=True):
            if b != bucket and held:
                yield counted()
                held = []
            bucket = b
            held.append((chunk, blob))
    if held:
        yield counted()


def _may_link(batches):
    """Rows come by chunk: each document's row with whether it may have a partner. A chunk that lacks some of what it sent keeps all."""
    names = ["doc_id", "row", "n", "sig", "maybe"]
    shared = np.zeros(_KNOWN + 1, np.int64)
    docs: list[pa.RecordBatch] = []
    chunk, missing = None, 0

    def done():
        rows = pa.Table.from_batches(docs).combine_chunks()
        n, idx = rows["n"].to_numpy(), rows["idx"].to_numpy()
        maybe = (n > 0) & ((rows["m"].to_numpy() + shared[idx] > n // 4) | bool(missing))
        out = pa.table([rows["doc_id"], rows["row"], rows["n"], rows["sig"], pa.array(maybe)], names)
        yield from out.to_batches()

    for batch in batches:
        ids = batch.column("chunk").to_numpy()
        edges = np.flatnonzero(np.diff(ids)) + 1
        for a, b in itertools.pairwise([0, *edges.tolist(), len(ids)]):
            if a == b:
                continue
            if ids[a] != chunk:
                if docs:
                    yield from done()
                docs, missing, chunk = [], 0, ids[a]
                shared[:] = 0
            part = batch.slice(a, b - a)
            is_doc, is_data = part.column("idx").is_valid(), part.column("data").is_valid()
            found = part.filter(is_data)
            for blob in found.column("data").to_pylist():
                shared += np.bincount(np.frombuffer(blob, "<u2"), minlength=_KNOWN + 1)
            missing -= int(np.sum(found.column("m").to_numpy()))
            total = part.filter(pc.and_(pc.invert(is_doc), pc.invert(is_data)))
            missing += int(np.sum(total.column("m").to_numpy()))
            if pc.any(is_doc).as_py():
                docs.append(part.filter(is_doc))
    if docs:
        yield from done()


def _full_sets(batches):
    for batch in slices(batches, most=_SLICE):
        h, at = _sets(batch)
        tokens = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(h))
        yield pa.record_batch([pa.array(_signatures(h, at)), pa.array(np.diff(at)), tokens], ["sig", "n", "tokens"])


def prefix_keys(tokens: np.ndarray, kinds: np.ndarray, n: int | None = None) -> tuple[np.ndarray, bool]:
    """The index keys of a set, and whether they are its rarest tokens alone.

    tokens: those that another set has too, in rising order, of the set's n; kinds: 1 rare, 2 and 3 frequent. The order
    of tokens is: those of one set alone, then by kind, then by hash. A partner at 0.75 or more lacks at most n // 4 of
    a set's tokens; so a set with more than that of its own has no partner, and no key. Among tokens of kind k (2 or 3)
    in one subclass, k - 1 can be shared without sharing a combination of k; a rare token is a key itself. So a prefix
    where own and rare tokens plus the sum of (tokens - (k - 1)) over the subclasses passes n // 4 has a key in common
    with the partner's prefix; that holds for the one of the two prefixes that ends first. Subclasses are sized by the
    larger set's level (log2 of its size), so a set that can have a partner one level up emits that level's keys too.
    Sets of a low level use single tokens throughout. Keys of rare tokens have the lowest bit 0, others 1.
    """
    n = len(tokens) if n is None else n
    room = n // 4 + 1 - (n - len(tokens))
    if not n or room <= 0:
        return tokens[:0], True
    rare = tokens[kinds == 1]
    single = rare[:room] & ~np.int64(1)
    if len(rare) >= room:
        return single, True
    keys = set()
    own = n.bit_length() - 1
    rest = sorted(zip(kinds[kinds > 1].tolist(), tokens[kinds > 1].tolist(), strict=True))
    for level in [own, own + 1] if 4 * n >= 3 << (own + 1) else [own]:
        left = room - len(rare)
        groups: dict[tuple[int, int], list[int]] = {}
        for kind, token in rest:
            if left <= 0:
                break
            if level < SMALL_LEVEL:
                keys.add((0, token))
                left -= 1
                continue
            group = groups.setdefault((kind, (token >> 8) % max(1, (1 << level) // (10 if kind == 2 else 20))), [])
            group.append(token)
            left -= len(group) >= kind
        for (kind, g), group in groups.items():
            keys.update((level, kind, g, *c) for c in itertools.combinations(group, kind))
    packed = np.fromiter((xxhash.xxh64_intdigest(np.array(k, np.int64).tobytes()) for k in keys), np.uint64, len(keys))
    return np.concatenate([single, packed.view(np.int64) | np.int64(1)]), False


def _keys(batches):
    """Rows (key, sig, n, s, plain) of each set's keys; s is the number of its tokens that another set has."""
    for batch in batches:
        entries = batch.column("entries")
        flat, at = entries.flatten(), entries.offsets.to_numpy()
        at = at - at[0]
        tokens, kinds = flat.field("token").to_numpy(), flat.field("kind").to_numpy()
        sizes = batch.column("n").to_numpy()
        keys, plain = [tokens[:0]], []
        for d in range(batch.num_rows):
            part = slice(at[d], at[d + 1])
            order = np.argsort(tokens[part])
            k, p = prefix_keys(tokens[part][order], kinds[part][order], int(sizes[d]))
            keys.append(k)
            plain.append(p)
        count = np.array([len(k) for k in keys[1:]], np.int64)
        repeat = lambda x: pa.array(np.repeat(x, count))
        yield pa.record_batch(
            [pa.array(np.concatenate(keys)), repeat(batch.column("sig").to_numpy()), repeat(sizes), repeat(np.diff(at).astype(np.int64)), repeat(np.array(plain, bool))], ["key", "sig", "n", "s", "plain"]
        )


def _size_fits(na: str, nb: str, sa: str, sb: str) -> Column:
    """Whether sets of these sizes, with so many tokens that others have, can be at 0.75: 7 * intersection >= 3 * (na + nb)."""
    return F.expr(f"4 * least({na}, {nb}) >= 3 * greatest({na}, {nb}) AND 7 * least({sa}, {sb}) >= 3 * ({na} + {nb})")


def _can_link(m: Column) -> Column:
    """Whether sets (na, nb; pa, pb: their keys are their rarest tokens alone) with m single keys in common can be alike.

    All common tokens up to the end of the prefix that ends first lie in both prefixes; that one is a plain one, if one is.
    """
    na, nb = F.col("na"), F.col("nb")
    rest = lambda n: n - F.floor(n / 4) - 1
    most = F.when(F.col("pa") & F.col("pb"), F.greatest(rest(na), rest(nb))).when(F.col("pa"), rest(na)).when(F.col("pb"), rest(nb))
    return most.isNull() | (7 * (m + most) >= 3 * (na + nb))


#: Of two sides of a join: different components whose sizes fit; and, with one parent, alike by the parent's tokens at most.
def _apart() -> Column:
    return (F.col("compa") != F.col("compb")) & _size_fits("na", "nb", "sa", "sb")


def _by_core() -> Column:
    return (F.col("qa") >= F.col("nb")) & (F.col("qb") >= F.col("na"))


#: Alike at most by what they have of the parents so far, and by the other tokens.
def _by_rest() -> Column:
    return F.expr("7 * (least(ca, cb) + least(ea, eb)) >= 3 * (na + nb)")


def _side(entries: DataFrame, x: str, *more) -> DataFrame:
    return entries.select(*more, *[F.col(c).alias(c + x) for c in ("sig", "n", "s", "q", "comp", "parent", "plain", "e")])


def _counted_pairs(met: DataFrame) -> DataFrame:
    """Pairs that may have enough tokens in common: the keys are the rarest tokens that one parent lacks, of which the two have ca and cb.

    The common tokens up to the end of the prefix that ends first are keys of both; the others are beyond that prefix.
    """
    counted = met.groupBy(F.col("siga").alias("a"), F.col("sigb").alias("b"), "na", "nb", "ca", "cb").agg(F.count("*").alias("d"))
    beyond = F.greatest(_needed("na", "ca"), _needed("nb", "cb")) - 1
    return counted.filter(7 * (F.least("ca", "cb") + F.col("d") + beyond) >= 3 * (F.col("na") + F.col("nb"))).select("a", "b", "na", "nb")


def _needed(n: str, c: str) -> Column:
    """Tokens at least, beside c of the n, that a set shares with one alike (of 3/4 of its size or more) that c doesn't decide on."""
    return F.greatest(F.lit(1), F.ceil(3 * F.col(n) / 4) - F.col(c))


class NgramJoin:
    """The steps of the join over one table of documents; see similar_documents."""

    def __init__(self, docs: DataFrame):
        self.spark = docs.sparkSession
        small_batches(self.spark)
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("row", F.xxhash64("doc_id", "text"))
        self.scratch = Scratch(self.spark, "ngram")
        self.rows = self.candidates()
        self.sets = self.shared_sets()

    def candidates(self) -> DataFrame:
        """Each document's doc_id, row (hash of id and text), n (tokens), sig (hash of the set) and maybe (it may have a partner or a copy)."""
        parts = shuffle_partitions(self.spark)
        schema = "chunk long, bucket long, data binary, m long, idx long, doc_id long, row long, n long, sig long"
        sent = self.docs.mapInArrow(task(_cut_tokens(max(256, 4 * parts))), schema).repartition(parts, "bucket").sortWithinPartitions("bucket")
        back = sent.mapInArrow(task(_shared_in_bucket), schema).repartition(parts, "chunk").sortWithinPartitions("chunk")
        return self.scratch.table(back.mapInArrow(task(_may_link), "doc_id long, row long, n long, sig long, maybe boolean"), "rows")

    def shared_sets(self) -> DataFrame:
        """Sets that may have a partner, one per signature: sig, n and entries (token, kind) of the tokens that another set has."""
        reps = self.scratch.table(self.rows.filter("maybe").groupBy("sig").agg(F.min("row").alias("row")).select("row"), "reps", narrow=True)
        few = reps.count() <= BROADCAST_ROWS
        texts = self.docs.join(F.broadcast(reps) if few else reps, "row", "left_semi").dropDuplicates(["row"]).select("text")
        whole = self.scratch.table(texts.mapInArrow(task(_full_sets), "sig long, n long, tokens array<long>"), "whole")
        tokens = whole.select("sig", "n", F.explode("tokens").alias("token"))
        kind = F.when(F.col("c") >= FREQUENT[1], 3).when(F.col("c") >= FREQUENT[0], 2).otherwise(1)
        several = tokens.groupBy("token").agg(F.count("*").alias("c")).filter("c > 1").select("token", kind.alias("kind"))
        entries = tokens.join(several, "token").groupBy("sig", "n").agg(F.collect_set(F.struct("token", "kind")).alias("entries"))
        sets = self.scratch.table(entries.filter(F.col("n") - F.size("entries") <= F.floor(F.col("n") / 4)), "sets")
        self.scratch.drop("whole")
        return sets

    def overlaps(self, pairs: DataFrame, name: str) -> DataFrame:
        """Pairs with c, the size of the intersection of a's and b's sets."""
        both = pairs.join(self.tokens("a"), "a").join(self.tokens("b"), "b").withColumn("c", F.size(F.array_intersect("ta", "tb")).cast("long"))
        return self.scratch.table(both.drop("ta", "tb"), name)

    def tokens(self, side: str) -> DataFrame:
        return self.sets.select(F.col("sig").alias(side), F.col("entries.token").alias(f"t{side}"))

    def parents(self, entries: DataFrame, before: DataFrame | None, name: str) -> DataFrame:
        """For each set one that leads about as many of its keys as any: a, b, na, sa, chain, core and rest; and direct, nb and c.

        direct is that leader, nb its size and c the tokens in common; b, the parent, is direct, its forest's top or one that more sets have, of size nt.

        A set's parents so far are its chain; core is the number of its tokens that one of them has, rest those that
        none has and another set has. before: the parents of the round before.

        A key is led by the set with the fewest tokens of its own, which is likely the one that others were copied
        from. A parent comes before its children in that order, so parents make a forest.
        """
        pick = F.min(F.struct((1 - F.col("s") / F.col("n")).alias("own"), F.xxhash64("sig").alias("h"), "sig", "n", "s"))
        lead = entries.groupBy("key").agg(pick.alias("p")).select("key", F.col("p.sig").alias("b"), F.col("p.n").alias("nb"), F.col("p.s").alias("sb"))
        met = entries.join(lead, "key").filter("sig <> b").filter(_size_fits("n", "nb", "s", "sb"))
        named = self.scratch.table(met.groupBy("sig", "n", "s", "b", "nb").agg(F.count("*").alias("k")), f"{name}-named", narrow=True)
        # of those that lead about as many, the one that most sets name, so that alike sets get one parent
        most, fame = named.groupBy("sig").agg(F.max("k").alias("most")), named.groupBy("b").agg(F.count("*").alias("fame"))
        near = named.join(most, "sig").filter("2 * k >= most").join(fame, "b")
        best = near.groupBy(F.col("sig").alias("a"), F.col("n").alias("na"), F.col("s").alias("sa")).agg(F.max(F.struct("fame", "k", "b", "nb")).alias("p"))
        best = self.scratch.table(best.select("a", "na", "sa", "p.b", "p.nb"), f"{name}-best", narrow=True)
        tops = forest_roots(best.select("a", "b")).select(F.col("node").alias("a"), F.col("root").alias("top"))
        both = best.join(tops, "a").join(self.tokens("a"), "a").join(self.tokens("b"), "b").withColumn("c", F.size(F.array_intersect("ta", "tb")).cast("long"))
        if before is None:
            both = both.withColumns({"old_chain": F.lit(None).cast("long"), "old_core": F.lit(0).cast("long"), "old_rest": F.col("ta")})
        else:
            both = both.join(before.select("a", F.col("chain").alias("old_chain"), F.col("core").alias("old_core"), F.col("rest").alias("old_rest")), "a")
        both = both.withColumns({"direct": F.col("b"), "gain": F.array_intersect("old_rest", "tb")}).drop("ta", "tb")
        both = both.withColumn("nt", F.lit(None).cast("long"))
        near, far = both.filter("top = b"), both.filter("top <> b").drop("nt").join(self.tokens("top"), "top").join(self.sets.select(F.col("sig").alias("top"), F.col("n").alias("nt")), "top")
        # the top of the parents, where it has nearly as much of the set, stands for its parent: one text's copies get one parent
        far = far.withColumn("more", F.array_intersect("old_rest", "ttop")).withColumn("high", 4 * F.size("more") >= 3 * F.size("gain"))
        far = far.withColumns({"b": F.when(F.col("high"), F.col("top")).otherwise(F.col("b")), "gain": F.when(F.col("high"), F.col("more")).otherwise(F.col("gain"))}).select(near.columns)
        first = self.scratch.table(near.unionByName(far), f"{name}-first")
        out = self.shared_parents(entries, first).withColumns(
            {"chain": F.col("b") if before is None else F.xxhash64("old_chain", "b"), "core": F.col("old_core") + F.size("gain"), "rest": F.array_except("old_rest", "gain")}
        )
        out = self.scratch.table(out.select("a", "b", "direct", "na", "nb", "nt", "sa", "c", "chain", "core", "rest"), f"{name}-parents")
        self.scratch.drop(f"{name}-first")
        return out

    def shared_parents(self, entries: DataFrame, first: DataFrame) -> DataFrame:
        """first with b, gain and nt of the parent that most sets have, of those met at a set's keys, where it has half of what the set's own has.

        So two parents of one text, which many sets of both meet at their keys, don't part its copies: sets of different
        parents are compared wherever their keys meet. Only sets without a parent are taken, so parents make a forest still.
        """
        fame = first.groupBy("b").agg(F.count("*").alias("fame"))
        tops = fame.filter("fame > 1").join(first.select(F.col("a").alias("b")), "b", "left_anti")
        of_set = first.select(F.col("a").alias("sig"), "b").unionByName(tops.select(F.col("b").alias("sig"), "b")).join(tops, "b")
        met = entries.select("key", "sig")
        lead = met.join(of_set, "sig").groupBy("key").agg(F.max(F.struct("fame", "b")).alias("p"))
        own = first.join(fame, "b").select(F.col("a").alias("sig"), F.struct("fame", "b").alias("own"))
        larger = met.join(lead, "key").select("sig", "p").distinct().join(own, "sig").filter("p > own")
        few = larger.withColumn("at", F.row_number().over(Window.partitionBy("sig").orderBy(F.desc("p")))).filter(F.col("at") <= SHARED)
        tried = few.select(F.col("sig").alias("a"), "p", F.col("p.b").alias("b")).join(self.tokens("b"), "b").join(first.select("a", "old_rest", F.size("gain").alias("had")), "a")
        tried = tried.withColumn("gain", F.array_intersect("old_rest", "tb")).filter(2 * F.size("gain") >= F.col("had"))
        best = tried.groupBy("a").agg(F.max(F.struct("p", "gain")).alias("t")).select("a", F.col("t.p.b").alias("shared"), F.col("t.gain").alias("more"))
        best = best.join(self.sets.select(F.col("sig").alias("shared"), F.col("n").alias("size")), "shared")
        out = first.join(best, "a", "left").withColumns({"b": F.coalesce("shared", "b"), "gain": F.coalesce("more", "gain"), "nt": F.coalesce("size", "nt")})
        return out.select(first.columns)

    def components(self, rounds: int = 3) -> DataFrame:
        """(sig, root) of the sets that link to another; two sets that reach each other by links have one root.

        Sets are compared with their parents first; what links makes components, and pairs within one need no comparison.
        Two sets of different components are compared if they can be alike by what is known:
        - with different parents, if they have a key in common;
        - with one parent, of which they have ca and cb tokens: their intersection has at most min(ca, cb) of the
          parent's tokens. If that isn't enough, they must share a token that the parent lacks, so these tokens are the
          keys of the next round, the rarest as far as needed; if it is, which needs sets smaller than the parent, the common key decides.
        In the next round all parents so far stand for the parent: its tokens are those that one of them has.
        So the unlike copies of one text aren't compared with each other, as they share the text's tokens alone, which
        a parent that lacks some of them and the next one have between them. After the last round keys decide, whatever
        their number: rounds change what is compared, not what links.
        """
        keys = self.scratch.table(self.sets.mapInArrow(task(_keys), "key long, sig long, n long, s long, plain boolean"), "keys")
        met = keys.groupBy("key").agg(F.min("sig").alias("lo"), F.max("sig").alias("hi")).filter("lo < hi").select("key")
        # c: how many tokens of the parents so far a set has, e: how many others that it shares; in the first round there are none
        entries = keys.join(met, "key", "left_semi").withColumns({"c": F.lit(None).cast("long"), "e": F.lit(None).cast("long")})
        entries = self.scratch.table(entries, "entries")
        self.scratch.drop("keys")
        roots, parents, pairs, first = None, None, [], entries.count()
        for r in range(rounds):
            parents = self.parents(entries, parents, f"round{r}")
            links = parents.filter("7 * c >= 3 * (na + nb)").select("a", F.col("direct").alias("b"))
            if roots is None:
                roots = self.scratch.table(forest_roots(links).withColumnRenamed("node", "sig"), "stars", narrow=True)
            else:
                roots = self._merged(roots, links, f"roots{r}")
            placed = self.placed(parents, roots, f"placed{r}")
            found, entries = self.apart(entries, placed, parents, r)
            pairs.append(found)
            # each pair of a key at most; a further round pays only if these outnumber the first round's entries
            left = entries.groupBy("key").agg(F.count("*").cast("double").alias("c")).agg(F.sum(F.col("c") * F.col("c"))).first()[0] or 0.0
            if left <= first:
                break
        left, right = _side(entries, "a", "key", F.col("c").alias("ca")), _side(entries, "b", "key", F.col("c").alias("cb"))
        last = left.join(right, "key").filter((F.col("siga") < F.col("sigb")) & _apart() & ~_by_core() & _by_rest())
        pairs.append(_counted_pairs(last))
        whole = pairs[0]
        for more in pairs[1:]:
            whole = whole.unionByName(more)
        pairs = self.scratch.table(whole.distinct(), "pairs", narrow=True)
        found = self.overlaps(pairs, "overlaps").filter("7 * c >= 3 * (na + nb)").select("a", "b")
        return self._merged(roots, found, "roots")

    def placed(self, parents: DataFrame, roots: DataFrame, name: str) -> DataFrame:
        """Each set's parent, q (the size up to which a partner can be alike by the parent's tokens alone), component and the parent's component."""
        of_set = parents.select(F.col("a").alias("sig"), F.col("b").alias("parent"), F.floor((7 * F.col("core") - 3 * F.col("na")) / 3).alias("q"))
        root_of = lambda c, out: roots.select(F.col("sig").alias(c), F.col("root").alias(out))
        all_sets = of_set.join(root_of("sig", "comp"), "sig", "full_outer").withColumn("parent", F.coalesce("parent", "sig"))
        all_sets = all_sets.join(root_of("parent", "home"), "parent", "left")
        return self.scratch.table(all_sets.select("sig", "parent", "q", F.coalesce("comp", "sig").alias("comp"), F.coalesce("home", "parent").alias("home")), name, narrow=True)

    def apart(self, entries: DataFrame, placed: DataFrame, parents: DataFrame, r: int) -> tuple[DataFrame, DataFrame]:
        """Pairs (a, b, na, nb) that a round's keys decide on, and the next round's entries."""
        at = entries.select("key", "sig", "n", "s", "plain", "c", "e").join(placed, "sig", "left").withColumns({"parent": F.coalesce("parent", "sig"), "comp": F.coalesce("comp", "sig"), "home": F.coalesce("home", "comp", "sig"), "q": F.coalesce("q", F.floor(4 * F.col("n") / 3))})
        at = self.scratch.table(at, f"at{r}")
        several = at.groupBy("key").agg(F.min("parent").alias("p"), F.max("parent").alias("pp"), F.min("comp").alias("k"), F.max("comp").alias("kk")).filter("p <> pp AND k <> kk").select("key")
        mixed = at.join(several, "key", "left_semi")
        other = _side(mixed, "a", "key", F.col("c").alias("ca")).join(_side(mixed, "b", "key", F.col("c").alias("cb")), "key").filter((F.col("siga") < F.col("sigb")) & (F.col("parenta") != F.col("parentb")) & _apart())
        if r:
            other = _counted_pairs(other.filter(_by_rest()))
        else:
            other = other.groupBy(F.col("siga").alias("a"), F.col("sigb").alias("b"), "na", "nb", F.col("plaina").alias("pa"), F.col("plainb").alias("pb")).agg(F.count_if(F.expr("key & 1") == 0).alias("m"))
            other = other.filter(_can_link(F.col("m"))).select("a", "b", "na", "nb")
        # of two sets with one chain and different components, one at least isn't in the last parent's; a pair meets once, by its chain
        chains = parents.select(F.col("a").alias("sig"), F.col("chain").alias("key"))
        strays = at.drop("key").dropDuplicates(["sig"]).join(chains, "sig").withColumn("stray", F.col("comp") != F.col("home"))
        bounds = strays.groupBy("key").agg(F.min("n").alias("least"), F.max(F.when(F.col("stray"), F.col("q"))).alias("most")).filter("most >= least")
        near = strays.join(bounds, "key")
        left, right = _side(near.filter("stray AND q >= least"), "a", "key"), _side(near.filter("n <= most"), "b", "key")
        small = left.join(right, "key").filter((F.col("siga") != F.col("sigb")) & _apart() & _by_core())
        first = F.col("siga") < F.col("sigb")
        small = small.select(F.least("siga", "sigb").alias("a"), F.greatest("siga", "sigb").alias("b"), F.when(first, F.col("na")).otherwise(F.col("nb")).alias("na"), F.when(first, F.col("nb")).otherwise(F.col("na")).alias("nb"))
        extra = parents.select(F.col("a").alias("sig"), F.col("na").alias("n"), F.col("sa").alias("s"), F.col("core").alias("c"), "chain", F.explode("rest").alias("token")).join(placed.select("sig", "parent", "q", "comp"), "sig")
        extra = extra.withColumn("key", F.xxhash64("chain", "token")).withColumn("plain", F.lit(True))
        shared = extra.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("key")
        following = extra.join(shared, "key", "left_semi")
        # with a set of another component and the same chain, a set shares the chain's tokens and these at most
        most = following.groupBy("sig").agg(F.count("*").alias("e"))
        following = following.join(most, "sig").withColumn("s", F.least("s", F.col("c") + F.col("e"))).filter("4 * s >= 3 * n")
        # alike sets share _needed of these tokens, so of each set's, rarest first, all but the last _needed - 1 have one in common
        rare = following.groupBy("key").agg(F.count("*").alias("of"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("key", "of")
        order = Window.partitionBy("sig").orderBy("of", "key")
        following = following.join(rare, "key", "left").withColumn("of", F.coalesce("of", F.lit(0))).withColumn("at", F.row_number().over(order))
        following = following.filter((F.col("at") <= F.col("e") - _needed("n", "c") + 1) & (F.col("of") > 0))
        following = following.select("key", "sig", "n", "s", "plain", "c", "e", "parent", "q", "comp")
        following = self.scratch.table(following, f"entries{r + 1}")
        tops = parents.filter("b <> direct").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(F.col("a") < F.col("b"), F.col("na")).otherwise(F.col("nt")).alias("na"), F.when(F.col("a") < F.col("b"), F.col("nt")).otherwise(F.col("na")).alias("nb"))
        return self.scratch.table(other.unionByName(small).unionByName(tops), f"found{r}", narrow=True), following

    def _merged(self, roots: DataFrame, links: DataFrame, name: str) -> DataFrame:
        """Roots after links (a, b) more: the components of a graph whose nodes are roots."""
        of = lambda c: roots.select(F.col("sig").alias(c), F.col("root").alias(f"r{c}"))
        edges = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
        # a root that has a root itself: a forest deeper than the doublings
        deep = roots.select(F.col("root").alias("a")).distinct().join(of("a"), "a").select("a", F.col("ra").alias("b"))
        top = components(edges.unionByName(deep), self.scratch, f"{name}-cc")
        above = roots.join(top.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("sig", F.coalesce("top", "root").alias("root"))
        own = top.select(F.col("node").alias("sig"), "root").join(roots, "sig", "left_anti")
        return self.scratch.table(above.unionByName(own), name, narrow=True)


def similar_documents(docs: DataFrame) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, n_shingles (size of its set), component_id (the least doc_id that links reach), row and keeper.

    A set has the distinct runs of five words, A-Z lower-cased, or all words as one where there are fewer. Two documents
    link at a Jaccard similarity of 0.75 or more; equal sets are one class and stand for all their copies. A text without
    words has no tokens and is its own component, as is null. Rows with equal doc_ids are one component's members as
    their sets say; each row gives a row. A null doc_id takes part, and is no component's name unless all its rows' ids
    are null. row is the hash of doc_id and text, keeper that of the one row to keep of a component: the least by doc_id
    (null last), then by row. No rows give no rows; other columns of docs don't matter.
    """
    join = NgramJoin(docs)
    some = join.rows.filter("n > 0")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    named = some.groupBy("sig").agg(first).join(join.components(), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    names = named.groupBy("root").agg(F.min("first").alias("least"))
    names = named.join(names, "root").select("sig", F.col("least.doc_id").alias("component_id"), F.col("least.row").alias("keeper"))
    names = join.scratch.table(names, "names", narrow=True)
    out = join.rows.join(names, "sig", "left")
    empty = F.col("n") == 0
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(empty, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "row", F.when(empty, F.col("row")).otherwise(F.col("keeper")).alias("keeper")
    )


def query(spark, sf_dir: str) -> DataFrame:
    return similar_documents(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")
