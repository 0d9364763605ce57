"""Exact deduplication by Patricia tries that own partitions of the texts."""

from __future__ import annotations

import os
import pickle
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import BLANKS, one_of_each, written

#: What a partial group is: digest, blank-free text, most code points, smallest id of those, members, rows of that id and so many points.
PARTIAL = "text_sha256 string, n_bytes long, body binary, best_chars long, best_id long, members long, rows long"
OWNER = "text_sha256 string, keep_id long, group_size long, keep_chars long, keep_rows long"


class Node:
    """A node of a radix trie: the bytes that lead to it, its children by first byte, and its terminal."""

    __slots__ = ("edge", "kids", "terminal")

    def __init__(self, edge: bytes, terminal: list | None = None):
        self.edge, self.kids, self.terminal = edge, {}, terminal


def shared_prefix(a: bytes, b: bytes, at: int) -> int:
    """How many leading bytes of `a` equal those of `b` from `at` on."""
    low, high = 0, min(len(a), len(b) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if b.startswith(a[:middle], at):
            low = middle
        else:
            high = middle - 1
    return low


def better(a: list, b: list) -> None:
    """Merge terminal b = [digest, chars, id, members, rows] into a: more code points win, then the smaller id."""
    a[3] += b[3]
    own, other = (-a[1], a[2] is None, a[2] or 0), (-b[1], b[2] is None, b[2] or 0)
    if other < own:
        a[1], a[2], a[4] = b[1], b[2], b[4]
    elif other == own:
        a[4] += b[4]


class Patricia:
    """A compressed radix trie of whole byte strings with a memory budget.

    Beyond the budget the heaviest subtree below the first branching is
    written to a file of the task's own temporary folder, and later strings
    under the same prefix follow it; `drain` folds each such file in turn.
    """

    def __init__(self, budget: int):
        self.budget, self.held, self.root, self.spilled = budget, 0, Node(b""), {}

    def add(self, body: bytes, terminal: list) -> None:
        for prefix, file in self.spilled.items():
            if body.startswith(prefix):
                pickle.dump((body, terminal), file, protocol=5)
                return
        node, at = self.root, 0
        while True:
            if at == len(body):
                if node.terminal:
                    better(node.terminal, terminal)
                else:
                    node.terminal = terminal
                return
            kid = node.kids.get(body[at])
            if kid is None:
                node.kids[body[at]] = Node(body[at:], terminal)
                self.held += len(body) - at + 400
                break
            if body.startswith(kid.edge, at):
                node, at = kid, at + len(kid.edge)
                continue
            n = shared_prefix(kid.edge, body, at)
            fork = Node(kid.edge[:n])
            kid.edge = kid.edge[n:]
            fork.kids[kid.edge[0]] = kid
            node.kids[fork.edge[0]] = fork
            self.held += 300
            node, at = fork, at + n
        if self.held > self.budget:
            self.spill()

    def spill(self) -> None:
        node, path = self.root, b""
        while len(node.kids) == 1 and not node.terminal:
            node = next(iter(node.kids.values()))
            path += node.edge
        if not node.kids:
            return
        weights = {first: sum(len(x.edge) + 400 for x, _ in walk(kid, b"")) for first, kid in node.kids.items()}
        first = max(weights, key=weights.get)
        file = tempfile.TemporaryFile()
        for x, body in walk(node.kids.pop(first), path):
            if x.terminal:
                pickle.dump((body, x.terminal), file, protocol=5)
        self.spilled[path + bytes([first])] = file
        self.held -= weights[first]

    def drain(self) -> Iterator[tuple[bytes, list]]:
        """Every distinct string with its merged terminal."""
        for node, body in walk(self.root, b""):
            if node.terminal:
                yield body, node.terminal
        self.root = Node(b"")
        for file in self.spilled.values():
            file.seek(0)
            part = Patricia(self.budget)
            for body, terminal in stored(file):
                part.add(body, terminal)
            file.close()
            yield from part.drain()


def walk(node: Node, path: bytes) -> Iterator[tuple[Node, bytes]]:
    """A subtree's nodes with their full strings, without recursion."""
    stack = [(node, path)]
    while stack:
        node, path = stack.pop()
        path += node.edge
        yield node, path
        stack += [(kid, path) for kid in node.kids.values()]


def stored(file) -> Iterator[tuple[bytes, list]]:
    size = os.fstat(file.fileno()).st_size
    while file.tell() < size:
        yield pickle.load(file)


def terminals(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[bytes, list]]:
    for batch in batches:
        names = ("text_sha256", "best_chars", "best_id", "members", "rows")
        columns = [batch.column(x).to_pylist() for x in names]
        for body, *terminal in zip(batch.column("body"), *columns, strict=True):
            yield body.as_py(), terminal


def owners_of_slices(budget: int):
    """Map side: distinct texts of as much input as the budget holds, so that copies meet before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Patricia(1 << 62)
        for body, terminal in terminals(batches):
            trie.add(body, terminal)
            if trie.held > budget:
                yield from partials(trie)
                trie = Patricia(1 << 62)
        yield from partials(trie)

    return run


def partials(trie: Patricia, rows: int = 512) -> Iterator[pa.RecordBatch]:
    found: list = []
    for body, (digest, chars, best, members, own) in trie.drain():
        found.append((digest, len(body), body, chars, best, members, own))
        if len(found) == rows:
            yield batch_of(found)
            found = []
    if found:
        yield batch_of(found)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"text_sha256": pa.string(), "n_bytes": pa.int64(), "body": pa.binary(), "best_chars": pa.int64(), "best_id": pa.int64(), "members": pa.int64(), "rows": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))


def owners_of_partition(budget: int):
    """Reduce side: one trie owns the partition's texts and spills by subtree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Patricia(budget)
        for body, terminal in terminals(batches):
            trie.add(body, terminal)
        found: list = []
        for _, (digest, chars, best, members, own) in trie.drain():
            if members > 1:
                found.append((digest, best, members, chars, own))
            if len(found) == 4096:
                yield owners_batch(found)
                found = []
        if found:
            yield owners_batch(found)

    return run


def owners_batch(rows: list[tuple]) -> pa.RecordBatch:
    digests, *numbers = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), *(pa.array(x, pa.int64()) for x in numbers)], names=["text_sha256", "keep_id", "group_size", "keep_chars", "keep_rows"])


def without_blanks(text: Column) -> Column:
    """The text after deleting every character of `[\\x20\\x09-\\x0D]`; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def owners_of(plain: DataFrame, budget: int) -> DataFrame:
    """Each group of two or more equal texts: its digest, the row that stays (id, code points, how many rows are just so), and its size. plain: doc_id, text, plain.

    Each input task merges copies in a trie of about `budget` bytes, so that a
    hot text leaves it once and not once a copy. Partial groups are dealt by
    length and content hash; the trie there owns its strings and spills by
    subtree to its task's temporary folder, which a repeated task makes anew.
    """
    entries = plain.select(
        F.sha2(F.col("plain").cast("binary"), 256).alias("text_sha256"),
        F.col("plain").cast("binary").alias("body"),
        code_points(F.col("text")).alias("best_chars"),
        F.col("doc_id").alias("best_id"),
        F.lit(1).cast("long").alias("members"),
        F.lit(1).cast("long").alias("rows"),
    )
    parts = max(1, int(plain.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    partial = entries.mapInArrow(owners_of_slices(budget), PARTIAL).repartition(parts, "n_bytes", "text_sha256")
    return partial.mapInArrow(owners_of_partition(budget), OWNER)


def code_points(text: Column) -> Column:
    return F.length(F.coalesce(text, F.lit(""))).cast("long")


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", budget: int = 32 << 20) -> DataFrame:
    """Which row of each group of equal texts stays: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without blanks. The row with the most code
    points in its original text stays, then the smallest id. Null and
    blank-only texts are one group. A null id comes after every other; rows
    repeated under one id are members each and share the id's decision. An
    empty table gives no rows; other columns are not read.

    Only the digests of groups of two or more are joined back, by a join whose
    hot keys Spark can split.
    """
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("plain", without_blanks(F.col("text")))
    owners = owners_of(plain, budget)
    return (
        plain.select("doc_id", F.sha2(F.col("plain").cast("binary"), 256).alias("text_sha256"))
        .join(owners, "text_sha256", "left")
        .select(
            "doc_id",
            F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
            F.when(F.col("group_size").isNull(), True).otherwise(F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
            "text_sha256",
        )
    )


def keep_first_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", budget: int = 32 << 20) -> DataFrame:
    """The row that stays of each group of equal texts, with all its columns.

    It is the one of most code points in its original text, then of the
    smallest id; of rows that repeat under that id too, one stays. A text
    that no other equals stays, whatever its id.
    """
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("plain", without_blanks(F.col("text")))
    owners = written(owners_of(plain, budget), "exact-owners").select(F.col("text_sha256").alias("_sha256"), F.col("keep_id").alias("_id"), F.col("keep_chars").alias("_chars"), F.col("keep_rows").alias("_rows"))
    same = F.sha2(without_blanks(docs[text]).cast("binary"), 256) == F.col("_sha256")
    is_first = (code_points(docs[text]) == F.col("_chars")) & docs[doc_id].cast("long").eqNullSafe(F.col("_id"))
    # Owners grow with the documents: merged at every size, so that the plan for few documents is the one for many.
    kept = docs.join(owners.hint("merge"), same, "left").where(F.col("_sha256").isNull() | (is_first & (F.col("_rows") == 1))).select(*[docs[x] for x in docs.columns])
    repeated = owners.where("_rows > 1")
    if repeated.isEmpty():
        return kept
    return kept.unionByName(one_of_each(docs.join(repeated, same & is_first), ["_sha256"], docs.columns))
