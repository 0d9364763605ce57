"""Near-duplicate documents: fast similarity sketches, bands, exact verification, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import one_of_each, removed, text_slices, written
from .similarity import band_keys, set_digests, shared, shingle_sets, sketches
from .textarrays import flat_text

#: A band is a stretch of so many bins of a sketch.
ROWS = 5
#: A link needs PERCENT / 100 of the union in the intersection; a pair at the threshold shares none of BANDS bands once in 2 million.
PERCENT, BANDS = 85, 25
#: Members of a bucket are compared in blocks of about so many, and of about so many shingles; a task holds two at a time.
BLOCK, BLOCK_SHINGLES = 256, 1 << 19


def profiles(docs: DataFrame, bands: int) -> DataFrame:
    """Each document's shingle count, set digest and band keys; digest and bands are null for empty sets. docs: doc_id, mark, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            sets = shingle_sets(*flat_text(batch.column("text")))
            some = [i for i, x in enumerate(sets) if len(x)]
            digests: list[bytes | None] = [None] * len(sets)
            keys: list[np.ndarray | None] = [None] * len(sets)
            if some:
                own = [sets[i] for i in some]
                for i, digest, row in zip(some, set_digests(own), band_keys(sketches(own, bands * ROWS), bands, ROWS), strict=True):
                    digests[i], keys[i] = digest, row
            columns = [batch.column("doc_id"), batch.column("mark"), pa.array([len(x) for x in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "mark", "n_shingles", "digest", "bands"])

    return docs.mapInArrow(run, "doc_id long, mark long, n_shingles long, digest binary, bands array<long>")


def shingles_of(texts: DataFrame) -> DataFrame:
    """The sets themselves: digest, shingles (sorted hashes). texts: text, digest; a text of another digest is left out, a task gives a digest once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in text_slices(batches, "text"):
            sets, wanted, chosen = shingle_sets(*flat_text(batch.column("text"))), batch.column("digest").to_pylist(), []
            for i, digest in enumerate(set_digests(sets)):
                if digest == wanted[i] and digest not in seen:
                    seen.add(digest)
                    chosen.append(i)
            flat = np.concatenate([*(sets[i] for i in chosen), np.zeros(0, np.uint64)]).view(np.int64)
            offsets = np.concatenate([[0], np.cumsum([len(sets[i]) for i in chosen])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([wanted[i] for i in chosen], pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["digest", "shingles"])

    return texts.mapInArrow(run, "digest binary, shingles array<long>")


def crowded_buckets(bands: DataFrame) -> DataFrame:
    """Memberships of the buckets that matter: key, digest, lead (the bucket's least digest), blocks (that it needs), n_shingles (null where one block does).

    bands: digest, n_shingles, key. Buckets of one member say nothing. Of
    buckets with the very same members (near copies meet in many bands) one is
    enough: they share count, least and greatest digest and the sum of the
    members' 64-bit hashes, and the one of least key stays.
    """
    member = F.xxhash64("digest")
    sizes = bands.groupBy("key").agg(
        F.count(F.lit(1)).alias("n_bucket"),
        F.sum(F.shiftright(member, 20)).alias("total"),
        F.sum("n_shingles").alias("weight"),
        F.min("digest").alias("least"),
        F.max("digest").alias("most"),
    )
    chosen = sizes.where("n_bucket > 1").groupBy("n_bucket", "total", "least", "most").agg(F.min("key").alias("key"), F.max("weight").alias("weight"))
    blocks = F.ceil(F.greatest(F.col("n_bucket") / BLOCK, F.col("weight") / BLOCK_SHINGLES)).cast("int")
    kept = bands.join(chosen.select("key", F.col("least").alias("lead"), blocks.alias("blocks")), "key")
    return kept.select("key", "digest", "lead", "blocks", F.when(F.col("blocks") > 1, F.col("n_shingles")).alias("n_shingles"))


def star_rows(members: DataFrame) -> DataFrame:
    """Rows that compare each member with its bucket's lead: key, low, high, block, label, digest; a lead is block 0 and meets its members by the block."""
    own = members.where("digest <> lead").select(F.col("lead").alias("key"), F.pmod(F.xxhash64("digest", F.lit(5)), F.col("blocks")).cast("int").alias("high"), "digest").distinct()
    leads = own.select("key", "high").distinct().select("key", "high", F.lit(0).alias("block"), F.col("key").alias("digest"))
    rows = own.select("key", "high", F.lit(1).alias("block"), "digest").unionByName(leads)
    return rows.select(F.hex("key").alias("key"), F.lit(-1).cast("long").alias("low"), F.col("high").cast("long").alias("high"), F.col("block").cast("long").alias("block"), F.col("digest").alias("label"), "digest")


def block_rows(members: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each pair of blocks that a member takes part in: key, low, high (blocks), block (its own), label, digest.

    members: key, digest, label; labels: key, label, n (members), weight (their
    shingles). Members of one label need no comparison: a label with more than
    half a block of members or shingles fills blocks of its own, which do not
    meet each other; the others are dealt by label.
    """
    needed = lambda n, weight: F.ceil(F.greatest(n / BLOCK, weight / BLOCK_SHINGLES)).cast("int")
    wide = (F.col("n") > BLOCK // 2) | (F.col("weight") > BLOCK_SHINGLES // 2)
    pools = labels.where(~wide).groupBy("key").agg(needed(F.sum("n"), F.sum("weight")).alias("pools"))
    of = F.when(wide, F.least(needed(F.col("n"), F.col("weight")), F.col("n"))).otherwise(F.col("pools")).cast("int")
    sized = labels.join(pools, "key", "left").select("key", "label", F.when(wide, F.abs(F.xxhash64("label"))).otherwise(F.lit(-1).cast("long")).alias("group"), of.alias("of"))
    block = F.pmod(F.when(F.col("group") == -1, F.xxhash64("label", F.lit(6))).otherwise(F.xxhash64("digest", F.lit(5))), F.col("of")).cast("int")
    dealt = members.join(sized, ["key", "label"]).select("key", "group", block.alias("block"), "label", "digest")
    blocks = sized.select("key", "group", F.explode(F.sequence(F.lit(0), F.col("of") - 1)).alias("block")).distinct().withColumn("name", F.xxhash64("group", "block"))
    other = blocks.select("key", F.col("group").alias("_group"), F.col("name").alias("_name"))
    meets = (F.col("group") != F.col("_group")) | (F.col("group") == -1)
    pairs = blocks.join(other, "key").where(meets).select("key", "group", "block", F.least("name", "_name").alias("low"), F.greatest("name", "_name").alias("high"), "name")
    return dealt.join(pairs, ["key", "group", "block"]).select(F.col("key").cast("string").alias("key"), "low", "high", F.col("name").alias("block"), "label", "digest")


def links_among(digests: list[bytes], blocks: np.ndarray, labels: list[bytes], sets: list[np.ndarray], percent: int) -> list[tuple[bytes, bytes]]:
    """Links between members of different labels and, where there are two blocks, of different blocks, as stars around the least of the linked ones."""
    sizes = np.array([len(x) for x in sets], np.int64)
    n = len(sets)
    several = blocks.min() != blocks.max()
    if n <= 8:
        common = np.zeros((n, n), np.int64)
        for i in range(n):
            for j in range(i):
                if 100 * min(sizes[i], sizes[j]) >= percent * max(sizes[i], sizes[j]):
                    common[i, j] = common[j, i] = shared(sets[i], sets[j])
    else:
        common = overlaps(sets)
    union = sizes[:, None] + sizes[None, :] - common
    linked = np.tril(100 * common >= percent * union, -1)
    if several:
        linked &= blocks[:, None] != blocks[None, :]
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in np.argwhere(linked).tolist():
        if labels[i] != labels[j]:
            a, b = root(i), root(j)
            parent[a] = b
    groups: dict[int, list[bytes]] = {}
    for i in range(n):
        groups.setdefault(root(i), []).append(digests[i])
    return [(least, x) for own in groups.values() if len(own) > 1 for least in [min(own)] for x in own if x != least]


def star_links(blocks: list[int], digests: list[bytes], sets: list[np.ndarray], percent: int) -> list[tuple[bytes, bytes]]:
    """Links of a lead (the member of block 0) with the others."""
    at = blocks.index(0)
    lead, found = sets[at], []
    for i, own in enumerate(sets):
        if i != at:
            common = shared(lead, own)
            if 100 * common >= percent * (len(lead) + len(own) - common):
                found.append((digests[at], digests[i]))
    return found


def overlaps(sets: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Intersection sizes of all pairs: products of incidence matrices over stretches of the shingles that recur."""
    n = len(sets)
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(n), [len(x) for x in sets])
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    column = np.cumsum(new) - 1
    recurs = np.bincount(column) > 1
    rank = np.cumsum(recurs) - 1
    keep = recurs[column]
    row, column = row[keep], rank[column[keep]]
    common = np.zeros((n, n), np.float64)
    cuts = np.searchsorted(column, np.arange(0, int(recurs.sum()) + width, width))
    for first, (a, b) in zip(range(0, int(recurs.sum()), width), zip(cuts[:-1], cuts[1:], strict=True), strict=False):
        part = np.zeros((n, width), np.float32)
        part[row[a:b], column[a:b] - first] = 1
        common += part @ part.T
    return common.astype(np.int64)


def verified_links(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between digests that are confirmed on their full sets. rows: as of `star_rows` (low is -1) and `block_rows`."""
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = rows.join(sets.hint("merge"), "digest").repartition(parts, "key", "low", "high").sortWithinPartitions("key", "low", "high", "block")

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held, name, weight = [], None, 0
        for batch in batches:
            heads = list(zip(*(batch.column(x).to_pylist() for x in ("key", "low", "high")), strict=True))
            own_blocks, labels, digests, lists = *(batch.column(x).to_pylist() for x in ("block", "label", "digest")), batch.column("shingles")
            values, offsets = lists.flatten().to_numpy().view(np.uint64), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            for i, head in enumerate(heads):
                # A star's lead comes first; its members are compared as they come.
                if head != name or (head[1] == -1 and (len(held) > BLOCK or weight > BLOCK_SHINGLES)):
                    if len(held) > 1:
                        yield name, held
                    held = held[:1] if head == name else []
                    name, weight = head, 0
                weight += int(offsets[i + 1] - offsets[i])
                held.append((own_blocks[i], labels[i], digests[i], values[offsets[i] : offsets[i + 1]].copy()))
        if len(held) > 1:
            yield name, held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[bytes, bytes]] = []
        for (_, low, _), held in groups(batches):
            blocks, labels, digests, own = (list(x) for x in zip(*held, strict=True))
            found += star_links(blocks, digests, own, percent) if low == -1 else links_among(digests, np.array(blocks), labels, own, percent)
            if len(found) > 10_000:
                yield links_batch(found)
                found = []
        if found:
            yield links_batch(found)

    return placed.mapInArrow(run, "a binary, b binary").distinct()


def links_batch(found: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    a, b = zip(*found, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])


def links_of(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Confirmed links (a, b) that join each component. members: as of `crowded_buckets`, written.

    A bucket of one block is compared within a task. In a larger one all
    members first meet the lead, which is linear; those linked with one lead,
    or with leads that share one, are one label. Members of different labels
    are then compared block by block, the lead left out.
    """
    single = members.where("blocks = 1").select(F.col("key").cast("string").alias("key"), *[F.lit(0).cast("long").alias(x) for x in ("low", "high", "block")], F.col("digest").alias("label"), "digest")
    large = members.where("blocks > 1")
    if large.isEmpty():
        return written(verified_links(single, sets, percent), "near-links", True)
    links = written(verified_links(single.unionByName(star_rows(large)), sets, percent), "near-links", True)
    # The lead of a lead is a label, too: what shares one is connected.
    nearest = links.select(F.greatest("a", "b").alias("digest"), F.least("a", "b").alias("label")).groupBy("digest").agg(F.min("label").alias("label"))
    nearest = written(nearest, "near-labels", True)
    further = nearest.join(nearest.select(F.col("digest").alias("label"), F.col("label").alias("_label")), "label", "left").select("digest", F.coalesce("_label", "label").alias("label"))
    rest = large.where("digest <> lead").select("key", "digest", "n_shingles").join(further, "digest", "left").select("key", "digest", "n_shingles", F.coalesce("label", "digest").alias("label"))
    rest = written(rest, "near-rest", True)
    mixed = written(rest.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("key"), "near-mixed", True)
    if not mixed.isEmpty():
        rows = rest.join(mixed, "key", "left_semi")
        labels = written(rows.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("weight")), "near-label-sizes", True)
        before, links = links, written(links.unionByName(verified_links(block_rows(rows, labels), sets, percent)), "near-links", True)
        removed(before, labels)
    removed(nearest, rest, mixed)
    return links


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, bands: int = BANDS) -> DataFrame:
    """Groups of near-duplicate documents: doc_id, n_shingles, component_id, kept.

    Two documents are linked if their sets of distinct 5-word shingles have
    100 * intersection >= percent * union; component_id is the smallest doc_id
    reachable over links, itself included. Texts without words, null ones too,
    are linked with nothing. Rows repeated under one id are nodes each. A null
    id is never a component's id unless it is alone in it. A row gives a row,
    an empty table none; other columns are not read.

    Documents of equal sets are one node from the start. Nodes that share a
    band's key meet in a bucket, whose members are compared on their full
    sets of 64-bit shingle hashes inside the tasks (`links_of`): what leaves
    a task are stars of links, never its pairs, and there is no cap on a bucket.
    """
    joined = placed_rows(docs, doc_id, text, percent, bands)
    component = F.when(F.col("component_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def mark_of(text: Column) -> Column:
    """A 64-bit digest of the text, which tells texts under one id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def placed_rows(docs: DataFrame, doc_id: str, text: str, percent: int, bands: int) -> DataFrame:
    """Each row's doc_id, mark and n_shingles with its component_id, and what is first in the component: digest, first_digest, first_mark.

    Of a row that no other is linked with or equal to, all but the first three are null.
    """
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), mark_of(F.col(text)).alias("mark"), F.col(text).alias("text"))
    profile = written(profiles(source, bands), "near-profiles")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "mark"))
    nodes = profile.where("digest is not null").groupBy("digest").agg(first.alias("m"), F.max(F.struct("n_shingles", "bands")).alias("b"), F.count(F.lit(1)).alias("copies"))
    nodes = written(nodes.select("digest", F.col("m.doc_id").alias("first_id"), F.col("m.mark").alias("first_mark"), "copies", "b.n_shingles", "b.bands"), "near-nodes")
    members = written(crowded_buckets(nodes.select("digest", "n_shingles", F.explode("bands").alias("key"))), "near-buckets")
    # One text of each node that is in a bucket, found by id and text: rows without an id, or under one id, meet their own node only.
    # What decides on documents grows with them: merged at every size, so that the plan for few documents is the one for many.
    wanted = members.select("digest").distinct().join(nodes.select("digest", "first_id", "first_mark"), "digest")
    texts = source.join(wanted.hint("merge"), (source.mark == F.col("first_mark")) & source.doc_id.eqNullSafe(F.col("first_id")))
    sets = written(shingles_of(texts.select("text", "digest")), "near-sets")
    links = links_of(members, sets, percent)
    labels = written(connected_components(links), "near-labels", True)
    removed(members, sets, links)
    known = nodes.select("digest", "first_id", "first_mark", "copies").join(labels.withColumnRenamed("node", "digest"), "digest", "left")
    linked = known.where("label is not null")
    least = linked.groupBy("label").agg(F.min(F.struct(F.col("first_id").isNull(), "first_id", "digest", "first_mark")).alias("f"))
    firsts = [F.col(f"f.{x}").alias(y) for x, y in (("first_id", "component_id"), ("digest", "first_digest"), ("first_mark", "first_mark"))]
    placed = linked.select("label", "digest").join(least, "label").select("digest", *firsts)
    placed = placed.unionByName(known.where("label is null and copies > 1").select("digest", F.col("first_id").alias("component_id"), F.col("digest").alias("first_digest"), "first_mark"))
    placed = written(placed, "near-components", True)
    removed(labels, nodes)
    return profile.select("doc_id", "mark", "n_shingles", "digest").join(placed, "digest", "left")


def keep_one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, bands: int = BANDS) -> DataFrame:
    """The documents that represent their component, with all their columns.

    At 80 percent 36 bands are right: a pair at the threshold shares none once in 1.6 million.

    A decision holds for an id and text together: of a component, the text of
    the least id (null last) and digest stays, whatever other rows share its
    id. Of rows that repeat under one id and text, one stays.
    """
    rows = placed_rows(docs, doc_id, text, percent, bands).where("first_digest is not null")
    stays = (F.col("digest") == F.col("first_digest")) & F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("mark") == F.col("first_mark"))
    decided = written(rows.select("doc_id", "mark", stays.alias("stays")).groupBy("doc_id", "mark", "stays").agg(F.count(F.lit(1)).alias("n")), "near-decided", True)
    gone = decided.where("not stays or n > 1").select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"))
    same = (mark_of(docs[text]) == F.col("_mark")) & docs[doc_id].cast("long").eqNullSafe(F.col("_id"))
    kept = docs.join(gone.hint("merge"), same, "left_anti")
    repeated = decided.where("stays and n > 1").select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"))
    if repeated.isEmpty():
        return kept
    return kept.unionByName(one_of_each(docs.join(repeated, same), ["_id", "_mark"], docs.columns))
