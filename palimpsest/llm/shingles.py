"""Links between texts that share most of their word shingles, for radii that 64-bit fingerprints cannot tell.

Texts with a Jaccard similarity of 0.8 differ in up to twelve of 64 SimHash bits, as far as many unlike texts
do, and at that radius no segment of a fingerprint stays whole. So this is a prefix-filtered set join: in one
global order of shingles, two sets of similarity s or more share one of the first n - ceil(s n) + 1 shingles of
each. The order puts shingles that a bounded sample shows in several texts last, which only makes common lines
rarely a prefix, and so do those that more texts than meet in pairs have in a first prefix; any order is right. Every candidate is verified on the whole sets of 64-bit shingle hashes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import arrow_rows, by_ids, connected_components, cut_lineage, in_worker, keyed_texts, row_slices, small, text_slices, with_row_ids
from palimpsest.llm.simhash import near_duplicates

WIDTH = 5
SIMILARITY = 0.8
#: Bounds of the sample that tells common shingles, and of the set that travels to the workers.
SAMPLE_ROWS = 10_000
COMMON_ROWS = 3
MAX_COMMON = 300_000
#: Shingles found in many prefixes that travel to the workers at most; others stay where they are in the order.
MAX_FREQUENT = 1_000_000
#: Texts that share a prefix shingle meet in pairs up to this many; beyond, each meets the first and then the last,
#: and what these leave apart meets in blocks.
PAIR_LIMIT = 8
BLOCK = 512
#: Bits of the sketch that tells most unlike sets apart; a power of two. Sets of up to SMALL_SET shingles travel
#: whole beside it, larger ones, which fill it, with a bitmap of their own size.
BITS = 2048
SMALL_SET = 256
#: Bytes of one numpy step, and rows that travel to Python at once: a row may hold two whole sets.
STEP_BYTES = 1 << 18
BATCH_ROWS = 256

_BASE, _MORE = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
_INVERSE = pow(_BASE, -1, 1 << 64)


def _byte_codes() -> np.ndarray:
    """A random 64-bit number for each byte; A-Z have those of a-z."""
    codes = np.random.default_rng(5).integers(1, 1 << 64, 256, np.uint64)
    codes[65:91] = codes[97:123]
    return codes


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_CODES = _byte_codes()
_SPACE = np.zeros(256, np.int8)
_SPACE[[9, 10, 11, 12, 13, 32]] = 1


def _step_powers() -> tuple[np.ndarray, np.ndarray]:
    """The powers for one step, made by each worker: as constants they would travel with every function."""
    return in_worker(f"powers {STEP_BYTES}", lambda: (_powers(_BASE, STEP_BYTES), _powers(_INVERSE, STEP_BYTES)))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MORE
    return h ^ (h >> np.uint64(29))


def word_hashes(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of every word of an array of bytes, A-Z taken as a-z: polynomials over its bytes, mixed."""
    edge = np.diff(np.concatenate([[1], _SPACE[flat], [1]]).astype(np.int8))
    start, stop = np.nonzero(edge == -1)[0], np.nonzero(edge == 1)[0]
    out, lo = np.empty(len(start), np.uint64), 0
    step = _step_powers()
    while lo < len(start):
        hi = max(lo + 1, int(np.searchsorted(stop, start[lo] + STEP_BYTES, side="right")))
        first = start[lo]
        part = flat[first : stop[hi - 1]]
        powers, inverses = step if len(part) <= STEP_BYTES else (_powers(_BASE, len(part)), _powers(_INVERSE, len(part)))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_CODES[part] * powers[: len(part)], dtype=np.uint64)])
        out[lo:hi] = (sums[stop[lo:hi] - first] - sums[start[lo:hi] - first]) * inverses[start[lo:hi] - first]
        lo = hi
    return start, _mix(out)


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """The distinct shingles of each text as sorted 64-bit hashes; a text of fewer words is one shingle."""
    flat = np.frombuffer(b" ".join(texts), np.uint8)
    ends = np.cumsum(np.array([len(t) + 1 for t in texts], np.int64))
    start, words = word_hashes(flat)
    first = np.searchsorted(start, np.concatenate([[0], ends[:-1]]))
    last = np.append(first[1:], len(start))
    n = max(0, len(words) - width + 1)
    grams = np.zeros(n, np.uint64)
    for k in range(width):
        grams = grams * _MORE + words[k : k + n]
    grams = _mix(grams)
    out = []
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(grams[a : b - width + 1]))
        else:
            short = np.uint64(0)
            for w in words[a:b].tolist():
                short = np.uint64((int(short) * int(_MORE) + w + 1) & (1 << 64) - 1)
            out.append(_mix(np.array([short] if b > a else [], np.uint64)))
    return out


def prefix(hashes: np.ndarray, least: float, common: np.ndarray) -> np.ndarray:
    """The first n - ceil(least n) + 1 shingles, those in ``common`` (sorted) last."""
    n = len(hashes)
    size = n - math.ceil(round(least * n, 9)) + 1 if n else 0
    if not len(common):
        return hashes[:size]
    last = common[np.minimum(np.searchsorted(common, hashes), len(common) - 1)] == hashes
    return np.concatenate([hashes[~last], hashes[last]])[:size]


def n_shared(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two sorted sets share."""
    if not len(a) or not len(b):
        return 0
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())


def bitmap(values: np.ndarray, bits: int) -> np.ndarray:
    """``bits`` bits, each set if a value falls on it: two sets differ in as many values as their bitmaps at least."""
    present = np.zeros(bits, np.uint8)
    present[(values >> np.uint64(64 - bits.bit_length() + 1)).astype(np.int64)] = 1
    return np.packbits(present)


def _sketches(texts: DataFrame, width: int) -> DataFrame:
    """``doc_id, n, bits, body``: how many distinct shingles a text has, their bitmap, and themselves if they are few,
    else a bitmap as fine as their number asks for."""

    def run(batches):
        for ids, part in text_slices(batches, STEP_BYTES):
            sets = shingle_sets(part, width)
            body = [s.tobytes() if len(s) <= SMALL_SET else fine_sketch(s) for s in sets]
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array([bitmap(s, BITS).tobytes() for s in sets], pa.binary()), pa.array(body, pa.binary())], names=["doc_id", "n", "bits", "body"])

    return texts.mapInArrow(run, "doc_id long, n int, bits binary, body binary")


def fine_sketch(values: np.ndarray) -> bytes:
    """How many values, and a bitmap of eight to sixteen bits a value."""
    return np.uint64(len(values)).tobytes() + bitmap(values, 1 << max(6, (8 * len(values)).bit_length())).tobytes()


def may_be_similar(x: bytes, y: bytes, bound: float) -> bool:
    """Whether two fine sketches allow a symmetric difference of at most ``bound`` times both sizes."""
    n = int(np.frombuffer(x, np.uint64, 1)[0]) + int(np.frombuffer(y, np.uint64, 1)[0])
    p, q = sorted((np.unpackbits(np.frombuffer(b, np.uint8, offset=8)) for b in (x, y)), key=len)
    q = q.reshape(len(p), -1).max(axis=1)  # a coarser bitmap is the finer one folded
    return int((p != q).sum()) <= bound * n + 1e-6


def is_similar(p: np.ndarray, q: np.ndarray, least: float) -> bool:
    both = n_shared(p, q)
    return both > 0 and both >= least * (len(p) + len(q) - both) - 1e-9


def _bodies(texts: DataFrame, width: int, make) -> DataFrame:
    """``doc_id, body``: what ``make`` gives of the distinct shingles of a text."""

    def run(batches):
        for ids, part in text_slices(batches, STEP_BYTES):
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array([make(s) for s in shingle_sets(part, width)], pa.binary())], names=["doc_id", "body"])

    return texts.mapInArrow(run, "doc_id long, body binary")


def common_shingles(texts: DataFrame, width: int) -> np.ndarray:
    share = min(1.0, SAMPLE_ROWS / max(1, texts.count()))

    def run(batches):
        for _, part in text_slices(batches, STEP_BYTES):
            yield pa.record_batch([pa.array(np.concatenate(shingle_sets(part, width)).view(np.int64))], names=["h"])

    picked = texts.filter(F.pmod(F.xxhash64("doc_id", F.lit("shingles")), F.lit(1 << 30)) < share * (1 << 30))
    counts = picked.mapInArrow(run, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= COMMON_ROWS)
    found = [r["h"] for r in counts.orderBy(F.desc("n"), "h").limit(MAX_COMMON).select("h").collect()]
    return np.sort(np.array(found, np.int64).view(np.uint64))


def _prefixes(texts: DataFrame, width: int, least: float, pair_limit: int) -> DataFrame:
    """``id, keys``: the prefix shingles of every text that has words.

    A sample shows fewer of the common shingles the more texts there are. So a first round counts the prefix shingles of
    all texts, and those of more than ``pair_limit`` go last as well: texts that have others of their own no longer meet
    by them.
    """
    common = common_shingles(texts, width)
    counts = _heads(texts, width, least, common).select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return _heads(texts, width, least, np.union1d(common, _frequent(counts.filter(F.col("n") > pair_limit))))


def _frequent(counts: DataFrame, limit: int = MAX_FREQUENT) -> np.ndarray:
    """The keys of ``counts(key, n)``, sorted as unsigned; if there are more than ``limit``, the most frequent of them."""
    counts = cut_lineage(counts)
    least, held = 0, 0
    for n, keys in sorted(((r["n"], r["keys"]) for r in counts.groupBy("n").agg(F.count(F.lit(1)).alias("keys")).collect()), reverse=True):
        held += keys
        if held > limit:
            break
        least = n
    found = counts.filter(F.col("n") >= least).select("key").toArrow().column("key").to_numpy() if least else np.array([], np.int64)
    return np.sort(found.astype(np.int64).view(np.uint64))


def _heads(texts: DataFrame, width: int, least: float, common: np.ndarray) -> DataFrame:
    """``id, keys``: the prefixes in the order that puts ``common`` last."""

    def run(batches):
        for ids, part in text_slices(batches, STEP_BYTES):
            heads = [prefix(s, least, common) for s in shingle_sets(part, width)]
            offsets = np.concatenate([[0], np.cumsum([len(h) for h in heads])]).astype(np.int32)
            keys = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(heads).view(np.int64)))
            yield pa.record_batch([pa.array(ids, pa.int64()), keys], names=["id", "keys"]).filter(pa.array(np.diff(offsets) > 0))

    return texts.mapInArrow(run, "id long, keys array<long>")


def _groups(rows: DataFrame) -> DataFrame:
    """``size, first, last, key``: one key for each set of texts that share one.

    Most keys are one text's alone; they go first, by two numbers a key. Copies share most of their prefix, so that
    many keys have the same texts; sets are told apart by their size, ends and sum of hashed ids.
    """
    ends = rows.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last")
    of = F.pmod(F.xxhash64("id"), F.lit(1 << 36))
    sums = rows.join(small(ends), "key").groupBy("key", "first", "last").agg(F.count(F.lit(1)).cast("int").alias("size"), F.sum(of).alias("sum"))
    return sums.groupBy("size", "first", "last", "sum").agg(F.min("key").alias("key")).drop("sum")


def _of(rows: DataFrame, end: str, **names: str) -> DataFrame:
    """Columns of ``rows(doc_id, ...)`` under the names that they have at one end of a pair."""
    return rows.select(F.col("doc_id").alias(end), *[F.col(old).alias(new) for new, old in names.items()])


def _sketched(sketches: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """Those of the pairs ``a, b`` whose sizes and bitmaps do not tell them apart; no similar pair is lost."""
    bound = (1 - least) / (1 + least)

    def run(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for c in ("x", "y"))
            n = batch.column("m").to_numpy().astype(np.int64) + batch.column("n").to_numpy()
            apart = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
            yield batch.select(["a", "b"]).filter(pa.array(apart <= bound * n + 1e-6))

    sizes = small(sketches.select("doc_id", "n"))
    sized = pairs.join(_of(sizes, "a", m="n"), "a").join(_of(sizes, "b", n="n"), "b")
    fits = sized.filter(F.least("m", "n") >= F.floor(F.lit(least) * F.greatest("m", "n")))
    return fits.join(_of(sketches, "a", x="bits"), "a").join(_of(sketches, "b", y="bits"), "b").select("a", "b", "m", "n", "x", "y").mapInArrow(run, "a long, b long")


def _met(texts: DataFrame, pairs: DataFrame, width: int, make, test) -> DataFrame:
    """Those of the pairs ``a, b`` that pass ``test`` on what ``make`` gives of both sets."""

    def run(batches):
        for batch in row_slices(batches, 64):
            keep = [test(x.as_py(), y.as_py()) for x, y in zip(batch.column("x"), batch.column("y"), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    pairs = cut_lineage(pairs)
    named = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    bodies = cut_lineage(_bodies(by_ids(texts, named, "doc_id", "left_semi"), width, make))
    met = pairs.join(_of(bodies, "a", x="body"), "a").join(_of(bodies, "b", y="body"), "b").select("a", "b", "x", "y")
    return met.mapInArrow(run, "a long, b long")


def _verified(texts: DataFrame, pairs: DataFrame, width: int, least: float) -> DataFrame:
    """``u, v``: those of the pairs ``a, b`` whose whole sets are similar; fine sketches travel before whole sets."""
    bound = (1 - least) / (1 + least)
    close = _met(texts, pairs, width, fine_sketch, lambda x, y: may_be_similar(x, y, bound))
    found = _met(texts, close, width, np.ndarray.tobytes, lambda x, y: is_similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), least))
    return found.select(F.col("a").alias("u"), F.col("b").alias("v"))


def _families(rows: DataFrame) -> DataFrame:
    """``rows(key, id, component)`` with one key for a family, texts that hang together by keys, where that is cheaper.

    Copies of a long text share many keys, each with somewhat different texts, so a pair would meet once for each of them.
    A family whose size squared is no more than the sum of its keys' sizes squared meets once as a whole, which holds all
    pairs of its keys; others, such as long chains, meet key by key.
    """
    low = rows.groupBy("key").agg(F.min("id").alias("low"))
    edges = rows.join(small(low), "key").select(F.col("id").alias("u"), F.col("low").alias("v"))
    families = cut_lineage(connected_components(rows.select(F.col("id").alias("node")).distinct(), edges).select(F.col("node").alias("id"), F.col("component").alias("family")))
    sizes = rows.groupBy("key").agg(F.min("id").alias("id"), F.count(F.lit(1)).cast("double").alias("n"))  # a key is of one family
    costs = sizes.join(families, "id").groupBy("family").agg(F.sum(F.col("n") * F.col("n")).alias("apart"))
    whole = costs.join(families.groupBy("family").agg(F.count(F.lit(1)).cast("double").alias("m")), "family").filter(F.col("m") * F.col("m") <= F.col("apart")).select("family")
    within = small(families.join(small(whole), "family"))
    roots = rows.groupBy("id").agg(F.min("component").alias("component"))
    own = F.xxhash64("family", F.lit("family"))  # should it equal a key, both only meet as one
    return roots.join(within, "id").select(own.alias("key"), "id", "component").unionByName(rows.join(within, "id", "left_anti").select("key", "id", "component"))


def _across(rows: DataFrame, sketches: DataFrame, least: float, block: int) -> DataFrame:
    """``a, b, sure`` that connect the similar texts with one key and two components, of ``rows(key, id, component)``.

    The texts of a key are dealt into blocks, those of its largest component apart from the others, and every two
    blocks meet in one group of bounded size, but for two of the largest component: there is nothing to connect.
    So the work is the texts of a key times those outside its largest component. Pairs of two components that
    sizes and bitmaps do not tell apart are verified there if both sets are small, and only those that join two
    components are returned; of others the fine bitmaps are compared, and what they leave is returned as not sure.
    """
    parts = rows.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    most = parts.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("largest"), F.max("n").alias("inside"), (F.sum("n") - F.max("n")).alias("outside"))
    inner, outer = (F.ceil(F.col(c) / F.lit(block)).cast("int") for c in ("inside", "outside"))
    within = F.col("component") == F.col("largest")
    mine = F.when(within, F.pmod(F.xxhash64("id"), inner)).otherwise(inner + F.pmod(F.xxhash64("id"), F.greatest(outer, F.lit(1)))).cast("int")
    other = F.sequence(F.when(within, inner).otherwise(F.lit(0)), inner + outer - 1)
    dealt = rows.join(small(most.filter("outside > 0")), "key").withColumn("mine", mine).withColumn("other", F.explode(other))
    cells = dealt.select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "id", "component")
    bound = (1 - least) / (1 + least)

    def meet(table):
        mine, ids, roots, n = (table.column(c).to_numpy() for c in ("mine", "id", "component", "n"))
        roots = roots.copy()
        bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint64).reshape(len(ids), -1)
        bodies = table.column("body").to_pylist()
        whole = [np.frombuffer(b, np.uint64) if m <= SMALL_SET else None for b, m in zip(bodies, n.tolist(), strict=True)]
        fine = lambda k: bodies[k] if whole[k] is None else fine_sketch(whole[k])
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        left, right = np.nonzero(mine == i)[0], np.nonzero(mine == j)[0]
        sizes, there = n[right], bits[right]
        found: list[tuple[int, int, bool]] = []
        for k in left:
            across = np.nonzero(roots[right] != roots[k])[0]
            apart = np.bitwise_count(there[across] ^ bits[k]).sum(axis=1, dtype=np.int64)
            for other in right[across[apart <= bound * (sizes[across] + n[k]) + 1e-6]]:
                if roots[other] == roots[k]:
                    continue
                sure = whole[k] is not None and whole[other] is not None
                if not (is_similar(whole[k], whole[other], least) if sure else may_be_similar(fine(k), fine(other), bound)):
                    continue
                found.append((min(ids[k], ids[other]), max(ids[k], ids[other]), sure))
                if sure:
                    roots[roots == roots[other]] = roots[k]
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64()), "sure": pa.array([f[2] for f in found], pa.bool_())})

    full = cells.join(_of(sketches, "id", n="n", bits="bits", body="body"), "id")
    return full.groupBy("key", "i", "j").applyInArrow(meet, "a long, b long, sure boolean").distinct()


def similar_pairs(docs: DataFrame, width: int = WIDTH, least: float = SIMILARITY, known: DataFrame | None = None, pair_limit: int = PAIR_LIMIT, block: int = BLOCK, id_col: str = "doc_id") -> DataFrame:
    """``u, v``: verified links that connect all rows of ``docs(doc_id, text)`` of Jaccard similarity ``least`` or more.

    Links only have to connect: a pair that ``known(u, v)`` or earlier links already join is not looked at again.
    Where more than ``pair_limit`` texts share a prefix shingle, each first meets the least text that any of its
    shingles has, one pair a text, which joins a family of copies in linear work. Then texts that share a shingle
    with few others meet in all pairs, and those of the large groups the first and the last of each. Last, texts of
    a large group that are still in different components are compared with one another, block by block. So no link
    between components is lost. Texts of fewer words than ``width`` are one shingle; null texts and texts without
    words have none and no links. Ids must be unique. An empty table gives an empty result.
    """
    texts = keyed_texts(docs, id_col)
    rows = cut_lineage(_prefixes(texts, width, least, pair_limit)).select(F.explode("keys").alias("key"), "id")
    groups = cut_lineage(_groups(rows))
    members = cut_lineage(rows.join(small(groups.filter("size > 2")), "key"))
    twos = groups.filter("size = 2").select(F.col("first").alias("a"), F.col("last").alias("b"))
    large = members.filter(F.col("size") > pair_limit)
    meets = large.select("id", F.explode(F.array("first", "last")).alias("other"))
    stars = meets.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"))
    few = members.filter(F.col("size") <= pair_limit).select("key", "id")
    pairs = few.join(few.select("key", F.col("id").alias("b")), "key").select(F.col("id").alias("a"), "b")
    wanted = cut_lineage(twos.unionByName(stars).unionByName(pairs).filter("a < b").distinct())
    named = cut_lineage(wanted.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    sketches = cut_lineage(_sketches(by_ids(texts, named, "doc_id", "left_semi"), width))
    nodes = named.select(F.col("doc_id").alias("node"))
    verified = lambda found: cut_lineage(_verified(texts, found, width, least))
    one_each = large.groupBy(F.col("id").alias("b")).agg(F.min("first").alias("a")).filter("a < b").select("a", "b")
    links = verified(_sketched(sketches, one_each, least))
    joined = links if known is None else links.unionByName(known)
    links = links.unionByName(verified(_sketched(sketches, _apart(wanted, small(connected_components(nodes, joined))), least)))
    ids = large.select("id").distinct()
    if ids.isEmpty():
        return links
    roots = small(connected_components(nodes, links if known is None else links.unionByName(known)))
    tagged = cut_lineage(large.select("key", "id", "size").join(roots.withColumnRenamed("node", "id"), "id"))
    apart = tagged.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("key")
    rest = cut_lineage(tagged.join(small(apart), "key").select("key", "id", "component"))
    if rest.isEmpty():
        return links
    more = cut_lineage(_across(cut_lineage(_families(rest)), sketches, least, block))
    sure = more.filter("sure").select(F.col("a").alias("u"), F.col("b").alias("v"))
    return links.unionByName(sure).unionByName(verified(more.filter("NOT sure").select("a", "b")))


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Those of the pairs ``a, b`` whose ends are in different components of ``roots(node, component)``."""
    of = lambda end: roots.select(F.col("node").alias(end), F.col("component").alias(f"root_{end}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").filter("root_a <> root_b").select("a", "b")


def keep_one_of_each(docs: DataFrame, width: int = WIDTH, least: float = SIMILARITY) -> DataFrame:
    """The row of ``docs(doc_id, text, ...)``, all columns, with the least doc_id of each group.

    A group hangs together by SimHash links (see near_duplicates) and by verified links of similarity ``least``
    or more over shingles of ``width`` words. Rows are told apart even where they share a doc_id or have none:
    exactly one row of a group stays. Texts without words are one group. An empty table gives an empty result.
    """
    rows, row = with_row_ids(docs)
    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        base = cut_lineage(near_duplicates(rows, id_col=row).select("doc_id", "component_id"))
        known = base.filter("doc_id <> component_id").select(F.col("doc_id").alias("u"), F.col("component_id").alias("v"))
        links = cut_lineage(similar_pairs(rows, width, least, known, id_col=row))
    roots = connected_components(base.select(F.col("doc_id").alias("node")), links.unionByName(known))
    dropped = roots.filter("node <> component").select(F.col("node").alias(row))
    return by_ids(rows, dropped, row, "left_anti").select(*docs.columns)
