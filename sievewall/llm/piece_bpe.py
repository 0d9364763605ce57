"""SentencePiece BPE encoding and decoding by vectorised merge rounds."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .shared import text_slices
from .textarrays import gathered

SPACE = "▁"
#: A symbol that no vocabulary entry holds, and the rank of a pair that does not merge.
FOREIGN, NEVER = (1 << 20) - 1, (1 << 31) - 1
#: A task's table of encoded units starts anew beyond so many; so many bytes of text are encoded at once.
MOST_UNITS, SLICE = 250_000, 1 << 20


def space_run(length: int, pieces: set[int]) -> list[int]:
    """How a run of spaces merges: all such pieces rank alike, so the leftmost pair that spells one merges first."""
    parts = [1] * length
    while True:
        at = next((i for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in pieces), None)
        if at is None:
            return parts
        parts[at : at + 2] = [parts[at] + parts[at + 1]]


class PieceModel:
    """A BPE model file with byte fallback as arrays: symbols, mergeable pairs and their ranks.

    Symbols are the vocabulary's pieces and the characters in them. A pair of
    symbols merges if together they spell a piece; pieces of higher score
    merge first, equal scores from the left.
    """

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        self.eos = sp.eos_id()
        names = [sp.id_to_piece(i) for i in ids]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) for i in ids]
        own = {names[i]: i for i in ids if not special[i]}
        symbols = dict.fromkeys([*own, *(c for name in own for c in name)])
        number = {s: k for k, s in enumerate(symbols)}
        self.symbol_id = np.array([own.get(s, -1) for s in symbols], np.int64)
        scores = np.array([-sp.get_score(own[s]) if s in own else np.inf for s in symbols])
        rank = np.unique(scores, return_inverse=True)[1].astype(np.int64)
        keys, merged = [], []
        for name in own:
            for cut in range(1, len(name)):
                left, right = number.get(name[:cut]), number.get(name[cut:])
                if left is not None and right is not None:
                    keys.append(left << 20 | right)
                    merged.append(number[name])
        order = np.argsort(np.array(keys, np.int64))
        self.pair_keys = np.array(keys, np.int64)[order]
        self.pair_symbol = np.array(merged, np.int64)[order]
        self.pair_rank = rank[self.pair_symbol]
        chars = sorted((ord(s), k) for s, k in number.items() if len(s) == 1)
        self.char_points = np.array([x for x, _ in chars], np.int64)
        self.char_symbols = np.array([x for _, x in chars], np.int64)
        self.space_symbol = number.get(SPACE, FOREIGN)
        runs = sorted(len(s) for s in own if not s.strip(SPACE))
        inner = [s for s in own if SPACE in s.lstrip(SPACE) or s.startswith(SPACE * 2) and s.strip(SPACE)]
        flat = {sp.get_score(own[SPACE * n]) for n in runs}
        if 1 not in runs or inner or len(flat) > 1 or flat and min(flat) > min(map(sp.get_score, own.values())) or any(sp.is_unused(i) for i in ids):
            raise ValueError("the model's pieces are not of the kind this encoder reads")
        self.longest_run = runs[-1]
        self.run_ids = [np.array([own[SPACE * n] for n in space_run(length, set(runs))], np.int64) for length in range(runs[-1] + 1)]
        self.byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        self.cuts_lines = not any("\n" in s for s in own)
        self.units = re.compile(" *[^ \n]+| +|\n" if self.cuts_lines else " *[^ ]+| +")
        spelled = [b"" if sp.is_control(i) else bytes([int(names[i][3:5], 16)]) if sp.is_byte(i) else names[i].replace(SPACE, " ").encode() for i in ids]
        if sp.unk_id() >= 0:
            spelled[sp.unk_id()] = " ⁇ ".encode()
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        sizes = np.array([len(x) for x in spelled], np.int64)
        self.spelled_at = np.cumsum(sizes) - sizes
        self.spelled_size = sizes
        self.opens_with_space = np.array([x[:1] == b" " and not special[i] for i, x in enumerate(spelled)])
        self.is_control = np.array([sp.is_control(i) for i in ids])
        probes = ["", " a  b ", "Zürich\n\n x=1;  日本\U0001f600", "aaaaaaa  " * 3, *(" " * n for n in range(3 * runs[-1]))]
        for probe in probes:
            if Encoder(self).ids(probe) != sp.encode(probe, add_eos=True):
                raise ValueError("the model's normalisation is not of the kind this encoder reads")

    def ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rank of each pair, NEVER where it does not merge, and the symbol it makes."""
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        hit = self.pair_keys[at] == key
        return np.where(hit, self.pair_rank[at], NEVER), self.pair_symbol[at]

    def merge_rounds(self, symbol: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The first character's place, symbol and word of what remains after all merges, in order.

        In a round every word finds its least pair rank and merges all pairs
        of it at once, leftmost first where they overlap. Merging one by one
        could meet a new pair of no higher rank before the next of these; a
        word in which a merge makes such a pair takes only its leftmost merge
        in that round. Words without a pair leave the arrays.
        """
        place = np.arange(len(symbol))
        rank = np.full(len(symbol), NEVER, np.int64)
        made = np.zeros(len(symbol), np.int64)
        if len(symbol) > 1:
            rank[:-1], made[:-1] = self.ranks(symbol[:-1], symbol[1:])
            rank[:-1][word[:-1] != word[1:]] = NEVER
        done: list[tuple] = []
        while len(symbol):
            head = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            sizes = np.diff(np.append(head, len(word)))
            least = np.minimum.reduceat(rank, head)
            over = np.repeat(least == NEVER, sizes)
            if over.any():
                done.append((place[over], symbol[over], word[over]))
                stay = ~over
                symbol, word, rank, made, place = symbol[stay], word[stay], rank[stay], made[stay], place[stay]
                if not len(symbol):
                    break
                sizes, least = sizes[least != NEVER], least[least != NEVER]
            low = np.repeat(least, sizes)
            due = rank == low
            at = np.flatnonzero(due)
            fresh = np.concatenate([[True], np.diff(at) > 1])
            run_start = np.maximum.accumulate(np.where(fresh, at, 0))
            at = at[(at - run_start) % 2 == 0]
            several = np.concatenate([[False], word[at[1:]] == word[at[:-1]]])
            if several.any():
                new, r, n = made[at], low[at], len(symbol)
                ahead = np.minimum(at + 2, n - 1)
                right = np.where((at + 2 < n) & (word[ahead] == word[at]), self.ranks(new, symbol[ahead])[0], NEVER)
                before = np.maximum(at - 1, 0)
                previous = symbol[before]
                joined = np.concatenate([[False], (at[1:] == at[:-1] + 2) & several[1:]])
                previous = np.where(joined, np.concatenate([[0], new[:-1]]), previous)
                left = np.where((at > 0) & (word[before] == word[at]), self.ranks(previous, new)[0], NEVER)
                unsafe = np.minimum(left, right) <= r
                if unsafe.any():
                    at = at[~(several & np.isin(word[at], word[at[unsafe]]))]
            symbol[at] = made[at]
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            now = np.cumsum(keep)[at] - 1
            symbol, word, rank, made, place = symbol[keep], word[keep], rank[keep], made[keep], place[keep]
            touched = np.concatenate([now, now[now > 0] - 1])
            touched = touched[touched < len(symbol) - 1]
            rank[touched], made[touched] = self.ranks(symbol[touched], symbol[touched + 1])
            rank[touched[word[touched] != word[touched + 1]]] = NEVER
            rank[-1] = NEVER
        if not done:
            return place, symbol, word
        place, symbol, word = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(place, kind="stable")
        return place[order], symbol[order], word[order]

    def unit_ids(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each unit (spaces, then a word), end to end, and how many each has."""
        cores = [u.lstrip(" ") for u in units]
        spaces = np.array([len(u) - len(c) for u, c in zip(units, cores, strict=True)], np.int64)
        spelled = [(SPACE if n and c else "") + c for n, c in zip(spaces.tolist(), cores, strict=True)]
        points = np.frombuffer("".join(spelled).encode("utf-32-le"), np.uint32).astype(np.int64)
        word = np.repeat(np.arange(len(units)), [len(s) for s in spelled])
        at = np.minimum(np.searchsorted(self.char_points, points), len(self.char_points) - 1)
        symbol = np.where(self.char_points[at] == points, self.char_symbols[at], FOREIGN)
        place, merged, owner = self.merge_rounds(symbol.copy(), word)
        has_word = np.array([bool(c) for c in cores], bool)
        return self._spelled_out(points[place], merged, owner, spaces, has_word)

    def _spelled_out(self, points, symbol, owner, spaces, has_word):
        """Symbols to ids: byte pieces for characters without one, runs of spaces in front."""
        n = len(spaces)
        known = symbol < len(self.symbol_id)
        ids = np.where(known, self.symbol_id[np.minimum(symbol, len(self.symbol_id) - 1)], -1)
        bare = ids < 0
        raw = [chr(x).encode() for x in points[bare].tolist()]
        sizes = np.ones(len(ids), np.int64)
        sizes[bare] = [len(x) for x in raw]
        out = np.repeat(ids, sizes)
        if raw:
            out[np.repeat(bare, sizes)] = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        counts = np.bincount(owner, weights=sizes, minlength=n).astype(np.int64)
        # the run of spaces before the word: one less where the word took the last, none of its own otherwise
        first = np.searchsorted(owner, np.arange(n))
        lone = np.zeros(n, bool)
        some = np.flatnonzero(has_word & (spaces > 0))
        lone[some] = symbol[first[some]] == self.space_symbol
        run = np.where(has_word, np.maximum(spaces - 1, 0) + lone, spaces)
        run = np.where(has_word & lone & (spaces == 1), 0, run)
        if not run.any():
            return out, counts
        pieces: list[np.ndarray] = []
        begin = np.cumsum(counts) - counts
        for i in range(n):
            own = out[begin[i] : begin[i] + counts[i]]
            if run[i]:
                full, rest = divmod(int(run[i]), self.longest_run)
                lead = [self.run_ids[-1]] * full + [self.run_ids[rest]]
                own = np.concatenate([*lead, own[1:] if lone[i] else own])
                counts[i] = len(own)
            pieces.append(own)
        return np.concatenate(pieces), counts


class Units(dict):
    """Numbers of units; a unit not met before gets the next number and waits to be learnt."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, unit: str) -> int:
        self[unit] = n = len(self)
        self.new.append(unit)
        return n


class Encoder:
    """Encodes texts unit by unit; units met before are looked up."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.reset()

    def reset(self) -> None:
        self.known = Units()
        self.pool, self.starts, self.sizes, self.used = np.zeros(1 << 16, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    def cut(self, text: str | None) -> list[str]:
        """The text's units with the space in front; empty ones stand for nothing."""
        if not text:
            return []
        text = " " + text.replace(SPACE, " ")
        if "  " in text or "\x01" in text or not self.model.cuts_lines:
            return self.model.units.findall(text)
        return text.replace(" ", "\x01 ").replace("\n", "\x01\n\x01").split("\x01")

    def learn(self, units: list[str]) -> None:
        ids, counts = self.model.unit_ids(units)
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(ids)), np.int32)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.starts = np.concatenate([self.starts, self.used + np.cumsum(counts) - counts])
        self.sizes = np.concatenate([self.sizes, counts])
        self.used += len(ids)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, each with an end id, and the n + 1 offsets."""
        if len(self.known) > MOST_UNITS:
            self.reset()
        units = [self.cut(t) for t in texts]
        lengths = [len(own) for own in units]
        at = np.fromiter(map(self.known.__getitem__, chain.from_iterable(units)), np.int64, sum(lengths))
        if self.known.new:
            self.learn(self.known.new)
            self.known.new = []
        sizes = self.sizes[at]
        ids = self.pool[gathered(self.starts[at], sizes)]
        text_of = np.repeat(np.arange(len(texts)), lengths)
        own = np.bincount(text_of, weights=sizes, minlength=len(texts)).astype(np.int64)
        offsets = np.concatenate([[0], np.cumsum(own + 1)])
        out = np.full(int(offsets[-1]), self.model.eos, np.int32)
        out[gathered(offsets[:-1], own)] = ids
        return out, offsets

    def ids(self, text: str) -> list[int]:
        return self.encode([text])[0].tolist()


def decode_ids(model: PieceModel, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
    """The text of each run of ids: control ids spell nothing, byte ids their byte, and one space at the start goes."""
    sizes = model.spelled_size[ids]
    flat = model.spelled[gathered(model.spelled_at[ids], sizes)]
    bounds = np.concatenate([[0], np.cumsum(sizes)])[offsets]
    silent = np.concatenate([[0], np.cumsum(model.is_control[ids])])
    # the first id that is no control id
    first = np.searchsorted(np.arange(1, len(ids) + 1) - silent[1:], np.arange(len(ids) + 1)[offsets[:-1]] - silent[offsets[:-1]] + 1)
    first = np.minimum(first, len(ids) - 1) if len(ids) else first
    opens = (offsets[:-1] < offsets[1:]) & (first < offsets[1:])
    if len(ids):
        opens &= model.opens_with_space[ids[first]]
    whole = flat.tobytes()
    return [whole[a + s : b].decode("utf-8", "replace") for a, b, s in zip(bounds[:-1].tolist(), bounds[1:].tolist(), opens.tolist(), strict=True)]


def encode(docs: DataFrame, model_file: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """The frame with a column of ids, as sentencepiece encodes its texts with an end id.

    With a name for `decoded`, also the text that the ids spell, decoded from
    them in the same pass over the rows. Null and empty texts have the end id
    alone. Texts are cut at spaces, and at line ends where no piece holds
    one, which no merge can cross; equal units of a task are merged once. The
    model's arrays are a fixed size and travel with the function. All columns
    stay; ones named like the new ones are replaced. An empty table gives no
    rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(PieceModel(model_file))
    kept = [x for x in docs.columns if x not in (ids, decoded)]
    fields = [docs.schema[x] for x in kept] + [T.StructField(ids, T.ArrayType(T.IntegerType(), False))]
    if decoded:
        fields.append(T.StructField(decoded, T.StringType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model.value)
        for batch in text_slices(batches, text, SLICE):
            flat, offsets = encoder.encode(batch.column(text).to_pylist())
            new = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))]
            if decoded:
                new.append(pa.array(decode_ids(model.value, flat, offsets), pa.string()))
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in kept), *new], names=[x.name for x in fields])

    return docs.mapInArrow(run, T.StructType(fields))


def decode(encoded: DataFrame, model_file: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """The frame with the text that its ids spell; a null list spells nothing.

    All columns stay; one named like `decoded` is replaced.
    """
    model = encoded.sparkSession.sparkContext.broadcast(PieceModel(model_file))
    kept = [x for x in encoded.columns if x != decoded]
    schema = T.StructType([encoded.schema[x] for x in kept] + [T.StructField(decoded, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = max(1, SLICE // 4 * batch.num_rows // max(1, len(batch.column(ids).flatten())))
            for begin in range(0, batch.num_rows, rows):
                part = batch.slice(begin, rows)
                column = part.column(ids)
                sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                texts = decode_ids(model.value, flat, np.concatenate([[0], np.cumsum(sizes)]))
                yield pa.RecordBatch.from_arrays([*(part.column(x) for x in kept), pa.array(texts, pa.string())], names=[*kept, decoded])

    return encoded.mapInArrow(run, schema)
