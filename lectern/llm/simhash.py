"""SimHash near-duplicates through an inverted index of byte positions."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import column_of, durable, records, slices, tidied
from lectern.llm.components import connected_components

SEED = 42
NAMELESS = 1 << 62
FINGERPRINTS = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
SIGNED = pa.schema([("doc_id", pa.int64()), ("digest", pa.int64()), ("bands", pa.list_(pa.int64()))])
DEALT = pa.schema([("band", pa.int64()), ("a", pa.int32()), ("b", pa.int32()), ("node", pa.int64()), ("members", pa.list_(pa.int32()))])
LINKS = pa.schema([("src", pa.int64()), ("dst", pa.int64())])


def fingerprint_sums(text: str | None, width: int) -> np.ndarray:
    """XXH64 of the text's shingles of ``width`` words; empty if it has no word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-width] + 1])
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist(), strict=True)], np.uint64)


def fingerprints_of(texts: list, width: int) -> np.ndarray:
    """64-bit fingerprints (as int64): a bit is set if over half of the shingles set it."""
    out = np.zeros(len(texts), np.uint64)
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for i, t in enumerate(texts):
        h = fingerprint_sums(t, width)
        if len(h):
            total = np.zeros(64, np.int64)
            for k in range(0, len(h), 1 << 16):
                part = h[k : k + (1 << 16)]
                total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            out[i] = weights[2 * total > len(h)].sum(dtype=np.uint64)
    return out.view(np.int64)


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, fp) of each row of ``docs`` (doc_id, text); texts without a word have fingerprint 0."""

    @tidied
    def run(batches):
        for batch in batches:
            for rows, texts in slices(batch, "text", 4_000_000):
                yield records([column_of(rows, "doc_id"), fingerprints_of(texts, width)], FINGERPRINTS)

    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "text").mapInArrow(run, "doc_id bigint, fp bigint")


def covering(positions: int, differing: int, size: int) -> list[tuple[int, ...]]:
    """Sets of ``size`` positions such that whatever ``differing`` positions differ, one set is spared.

    All sets for size = positions - differing; one byte less needs far fewer sets
    (Turan's construction on three classes, for eight positions and four that differ).
    """
    if size == positions - differing:
        return list(combinations(range(positions), size))
    if (positions, differing, size) != (8, 4, 3):
        raise ValueError("no covering known for these sizes")
    kind = [p % 3 for p in range(positions)]
    return [c for c in combinations(range(positions), size) if len(k := [kind[p] for p in c]) and (len(set(k)) == 1 or any(k.count(a) == 2 and k.count((a + 1) % 3) == 1 for a in range(3)))]


def is_near(found: np.ndarray, one: np.uint64, most_bits: int) -> np.ndarray:
    """Which fingerprints are within ``most_bits`` of one.

    The shared positional bytes are tallied first; what has fewer than any near pair must
    have is dropped before bits are counted.
    """
    differ = found ^ one
    near = (differ.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1) >= 8 - most_bits
    near[near] = np.bitwise_count(differ[near]) <= most_bits
    return near


def bucket_links(found: np.ndarray, most_bits: int) -> list[tuple[int, int]]:
    """Links that join what is near in one bucket of distinct fingerprints, a tree per component.

    Searches outwards: what is reached leaves the rest, and of the reached and the rest the
    fewer are taken one at a time against all of the others, so a dense group costs about
    its size. No more links come out than fingerprints went in.
    """
    links: list[tuple[int, int]] = []
    signed = lambda x: int(x.view(np.int64))
    rest = found.view(np.uint64)
    while len(rest) > 1:
        reached, rest = [rest[0]], rest[1:]
        while reached and len(rest):
            if len(reached) <= len(rest):
                at = reached.pop()
                near = is_near(rest, at, most_bits)
                links += [(signed(at), signed(x)) for x in rest[near]]
            else:
                from_here, reached = np.array(reached), []
                near = np.zeros(len(rest), bool)
                for k, x in enumerate(rest):
                    ends = is_near(from_here, x, most_bits)
                    if ends.any():
                        near[k] = True
                        links.append((signed(from_here[np.argmax(ends)]), signed(x)))
            reached += list(rest[near])
            rest = rest[~near]
    return links


def near_links(distinct: DataFrame, most_bits: int = 4, small: int = 1 << 23) -> DataFrame:
    """Links (src, dst) between the nodes of distinct fingerprints (fp, node) that differ in few bits.

    The links have the same components as all pairs within ``most_bits``. Two such
    fingerprints differ in at most four of eight bytes, so they agree on one of a covering
    family of byte positions: each fingerprint enters the inverted index under its bytes at
    each set of the family, and only what shares a list is compared. Sets have three
    positions (20 lists a fingerprint) up to ``small`` fingerprints and four (70) beyond,
    where lists of three would grow long by chance; both find every pair.
    """
    count = distinct.count()
    family = covering(8, most_bits, 3 if count <= small and most_bits == 4 else 8 - most_bits)
    masks = [sum(0xFF << 8 * p for p in c) for c in family]
    masks = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("set"), F.col("fp").bitwiseAND(F.lit(m)).alias("bytes")) for i, m in enumerate(masks)]))
    spark = distinct.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), count * len(masks) // 2_000_000)
    listed = distinct.select("fp", "node", keys.alias("k")).select("fp", "node", "k.set", "k.bytes").repartition(parts, "set", "bytes")

    @tidied
    def run(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        all_rows = pa.Table.from_batches(got)
        fp, node, which, key = (all_rows.column(c).to_numpy() for c in ("fp", "node", "set", "bytes"))
        order = np.lexsort((fp, key, which))
        fp, node, which, key = fp[order], node[order], which[order], key[order]
        new = np.flatnonzero(np.concatenate([[True], (which[1:] != which[:-1]) | (key[1:] != key[:-1])]))
        ends = np.append(new[1:], len(fp))
        links: list = []
        for a, b in zip(new[ends - new > 1].tolist(), ends[ends - new > 1].tolist(), strict=True):
            if found := bucket_links(fp[a:b], most_bits):
                name = dict(zip(fp[a:b].tolist(), node[a:b].tolist(), strict=True))
                links += [(name[x], name[y]) for x, y in found]
            if len(links) > 100_000:
                yield records([[x[0] for x in links], [x[1] for x in links]], LINKS)
                links = []
        yield records([[x[0] for x in links], [x[1] for x in links]], LINKS)

    return listed.mapInArrow(run, "src bigint, dst bigint")


def print_nodes(prints: DataFrame) -> DataFrame:
    """(fp, node) of the distinct fingerprints in ``prints`` (doc_id, fp).

    A fingerprint's node is the smallest id that has it, so a component's smallest node is
    its id. Fingerprints of rows without ids get nodes above all ids, which are below 2^62;
    two may share one only if they differ in the two lowest bits, hence are linked.
    """
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    return durable(distinct.select("fp", F.coalesce("first_id", F.lit(NAMELESS) + F.shiftrightunsigned("fp", 2)).alias("node")))


def near_duplicates(docs: DataFrame, width: int = 4, most_bits: int = 4) -> DataFrame:
    """Group documents whose fingerprints are linked.

    One row per row of ``docs`` (doc_id, text): doc_id, fingerprint (16 hex digits),
    component_id (the smallest doc_id reachable; null only where no member has an id).
    Null texts and texts without words have fingerprint zero and are linked like any other.
    Equal fingerprints are brought to one row before any comparison, so exact copies,
    however many, cost nothing further; repeated rows stay. An empty table gives an empty
    result; other columns are ignored.
    """
    prints = durable(fingerprints(docs, width))
    distinct = print_nodes(prints)
    linked = connected_components(near_links(distinct, most_bits))
    named = distinct.join(linked, "node", "left").select("fp", F.coalesce("component", "node").alias("component"))
    of_print = named.select("fp", F.when(F.col("component") < NAMELESS, F.col("component")).alias("component_id"))
    return prints.join(of_print, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def band_keys(h: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """The MinHash bands of a set of 64-bit hashes: a key (as int64) of ``rows`` minima for each of ``bands``."""
    rnd = np.random.default_rng(SEED)
    flip, odd = rnd.integers(0, 1 << 64, (2, bands * rows, 1), np.uint64)
    least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(h), 1 << 12):
        np.minimum(least, ((h[None, k : k + (1 << 12)] ^ flip) * (odd | np.uint64(1))).min(axis=1), out=least)
    minima = least.reshape(bands, rows)
    return np.array([xxhash.xxh64_intdigest(m.tobytes(), b) for b, m in enumerate(minima)], np.uint64).view(np.int64)


def set_links(sizes: np.ndarray, members: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Links that join similar sets of one list, a tree per component, as pairs of places.

    ``members`` holds the elements of the sets in turn, those of one set distinct. Searches
    outwards like ``bucket_links``: what is reached leaves the rest and is compared with the
    rest only, all of the rest at once, so a dense group costs about its size.
    """
    links: list[tuple[int, int]] = []
    values, members = np.unique(members, return_inverse=True)
    own = np.split(members, np.cumsum(sizes)[:-1])
    mark = np.zeros(len(values), bool)
    rest = np.arange(len(sizes))
    while len(rest) > 1:
        reached, rest = [int(rest[0])], rest[1:]
        begins = np.cumsum(sizes[rest]) - sizes[rest]
        members = np.concatenate([own[i] for i in rest])
        while reached and len(rest):
            at = reached.pop()
            mark[own[at]] = True
            shared = np.add.reduceat(mark[members], begins, dtype=np.int64)
            mark[own[at]] = False
            near = shared >= least * (sizes[at] + sizes[rest] - shared)
            if near.any():
                found = rest[near].tolist()
                links += [(at, x) for x in found]
                reached += found
                members = members[np.repeat(~near, sizes[rest])]
                rest = rest[~near]
                begins = np.cumsum(sizes[rest]) - sizes[rest]
    return links


def similar_links(docs: DataFrame, width: int = 5, least: float = 0.8, bands: int = 40, rows: int = 5, block: int = 4096) -> DataFrame:
    """Links (src, dst) between rows of ``docs`` (doc_id, text) whose sets of shingles are similar.

    The links have the components of all pairs with a Jaccard similarity of ``least`` or
    more over shingles of ``width`` words that share a MinHash band; a pair at 0.8 misses
    all 40 bands of 5 with a chance of 1.3e-7. Equal sets become one first. Nodes that share
    a band form a list; of lists with the same nodes one is taken. A list's sets (32-bit
    hashes of the shingles, made from the whole texts) are brought together and searched
    outwards, so every link is verified. A list of more than ``block`` nodes is dealt into
    blocks and these are taken two by two, so a task never holds more than two blocks.
    Texts without a word have no shingle and no link; rows without ids have none either.
    """

    @tidied
    def sign(batches):
        for batch in batches:
            for part, texts in slices(batch, "text", 4_000_000):
                sets = [np.unique(fingerprint_sums(t, width)) for t in texts]
                some = np.array([len(h) > 0 for h in sets], bool)
                sets = [h for h in sets if len(h)]
                digests = np.array([xxhash.xxh64_intdigest(h.tobytes(), SEED) for h in sets], np.uint64).view(np.int64)
                yield records([column_of(part, "doc_id").filter(pa.array(some)), digests, [band_keys(h, bands, rows) for h in sets]], SIGNED)

    @tidied
    def deal(batches):
        """The set of each node, once for every list and block that wants it."""
        for batch in batches:
            for part, texts in slices(batch, "text", 1_000_000):
                sets = pa.array([np.unique(fingerprint_sums(t, width).astype(np.uint32)).view(np.int32) for t in texts], pa.list_(pa.int32()))
                places = column_of(part, "places")
                for at in range(0, len(sets), 64):
                    wanted = places.slice(at, 64)
                    flat, which = wanted.flatten(), pa.array(np.repeat(np.arange(len(wanted)), np.diff(wanted.offsets.to_numpy())))
                    yield records([*(flat.field(k) for k in range(3)), column_of(part, "node").slice(at, 64).take(which), sets.slice(at, 64).take(which)], DEALT)

    @tidied
    def search(batches):
        held: list = []
        links: list = []

        def close():
            node = np.concatenate([h[0] for h in held])
            found = set_links(np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held]), least)
            held.clear()
            return [(int(node[a]), int(node[b])) for a, b in found]

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([column_of(batch, c).to_numpy() for c in ("band", "a", "b")])
            node, sets = column_of(batch, "node").to_numpy(), column_of(batch, "members")
            sizes, members = np.diff(sets.offsets.to_numpy()), sets.flatten().to_numpy()
            at = np.concatenate([[0], np.cumsum(sizes)])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), len(node)]
            for x, y in zip(cuts, cuts[1:]):
                if held and last != keys[:, x].tolist():
                    links += close()
                last = keys[:, x].tolist()
                held.append((node[x:y], sizes[x:y], members[at[x] : at[y]]))
            if len(links) > 100_000:
                yield records([[x[0] for x in links], [x[1] for x in links]], LINKS)
                links = []
        if held:
            links += close()
        yield records([[x[0] for x in links], [x[1] for x in links]], LINKS)

    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = durable(docs.mapInArrow(sign, "doc_id bigint, digest bigint, bands array<bigint>"))
    one = signed.groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands"))
    equal = signed.select("doc_id", "digest").join(one.select("digest", "node"), "digest").where("doc_id <> node").select(F.col("node").alias("src"), F.col("doc_id").alias("dst"))
    listed = durable(one.select("node", F.posexplode("bands").alias("k", "band")).select("node", F.xxhash64("k", "band").alias("band")))
    lists = listed.groupBy("band").agg(F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("who"), F.min("node").alias("least")).where("n > 1")
    lists = lists.groupBy("n", "who", "least").agg(F.min("band").alias("band")).select("band", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("node", F.lit("block")), "blocks").cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.col("band"), F.least(x, "mine").alias("a"), F.greatest(x, "mine").alias("b")))
    wanted = listed.join(lists, "band").withColumn("mine", mine).groupBy("node").agg(F.flatten(F.collect_list(pairs)).alias("places"))
    whole = docs.join(wanted, F.col("doc_id") == F.col("node")).select("node", "text", "places").distinct()
    dealt = whole.mapInArrow(deal, "band bigint, a int, b int, node bigint, members array<int>")
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    found = dealt.repartition(parts, "band", "a", "b").sortWithinPartitions("band", "a", "b").mapInArrow(search, "src bigint, dst bigint")
    return equal.unionByName(found)


def keep_first(docs: DataFrame, width: int = 4, most_bits: int = 4, similar_width: int = 5, least: float | None = None) -> DataFrame:
    """One row of each group of near duplicates in ``docs``, all columns.

    Rows are linked whose fingerprints are (``near_duplicates``) and, given ``least``, those
    whose sets of shingles of ``similar_width`` words have that Jaccard similarity or more
    (``similar_links``), as few bits miss most of these. The row with the smallest doc_id
    stays, one of them if the id is repeated. A row without an id goes under a number above
    all ids (2^62 and more) made of its content, so that it is grouped like any other, equal
    rows are one, and a row with an id stays before it. Texts without a word are one group.
    Columns may have any names; an empty table gives an empty result.
    """
    taken = {c.lower() for c in docs.columns}  # Spark's names are equal in any case
    key = "key"
    while key in taken or f"{key}_row" in taken:
        key += "_"
    columns = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]
    content = F.to_json(F.struct(*columns)) if docs.columns else F.lit("")
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(NAMELESS) + F.shiftrightunsigned(F.xxhash64(content), 2))
    keyed = docs.withColumn(key, own)
    texts = keyed.select(F.col(key).alias("doc_id"), "text")
    prints = durable(fingerprints(texts, width))
    distinct = print_nodes(prints)
    # Links are between the nodes of distinct fingerprints, however many rows have one.
    of = prints.join(distinct, "fp").select("doc_id", "node").distinct()
    own_first = of.groupBy("doc_id").agg(F.min("node").alias("src"))
    links = near_links(distinct, most_bits).unionByName(of.join(own_first, "doc_id").select("src", F.col("node").alias("dst")).where("src <> dst"))
    if least is not None:
        similar = similar_links(texts, similar_width, least)
        similar = similar.join(of, F.col("dst") == F.col("doc_id")).select("src", F.col("node").alias("to")).distinct()
        links = links.unionByName(similar.join(of, F.col("src") == F.col("doc_id")).select(F.col("node").alias("src"), F.col("to").alias("dst")))
    later = connected_components(links).where("node <> component").select("node")
    kept = distinct.select("node").distinct().join(later, "node", "left_anti").select(F.col("node").alias(key))
    one = F.row_number().over(Window.partitionBy(key).orderBy(key))
    row = f"{key}_row"
    return keyed.join(kept, key, "left_semi").withColumn(row, one).where(F.col(row) == 1).select(*columns)
