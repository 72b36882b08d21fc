"""SentencePiece encoding with seeded merge-dropout, and lossless decoding.

Texts are encoded by byte-pair merges of a given, trained model. Merges are
taken from an agenda, best score first and leftmost among equals; when a
candidate merge is taken, a hash keyed by seed, document, the word's place and
the candidate's turn decides whether it is skipped, so that a word is cut
differently in different places and documents, and the same way in every run.
The hash is compared at 16 bits. Characters that the model does not know become
byte pieces. With dropout 0 the result is the
model's ordinary encoding.

Merges never cross from a word to the spaces after it (checked when the model
is loaded), so the agenda of each unit, spaces and the word after them, is
independent: most units run side by side in numpy, taking one candidate each a
turn; units of over LONG_UNIT characters, where that would take quadratic
time, run through a heap. Equal units that skip in the same turns are cut
alike, so a unit of up to MASKED_UNIT characters is worked out once for each
set of turns it skips (turns from its length on draw from that set and its
characters) and looked up afterwards, its characters compared. Texts are read
in stretches that begin with a unit, so memory does not follow their length.

Edge cases: a null text stays null; an empty text has no pieces; U+2581 in a
text is coded as bytes, since as a piece it means a space; rows with equal id
and text are encoded alike unless `copies` is set; an empty table gives no rows; input columns that
clash with an added column are replaced by it.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideledger.llm.common import in_small_batches, powers, read_table, shuffle_partitions, splitmix

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT = 0.1
SEED = 42
LONG_UNIT = 256
MASKED_UNIT = 64
MAX_CUTS = 1 << 17
BATCH_CHARS = 1 << 18
GROUP_BYTES = 1 << 22
COPY_BLOCK = 64
UNIT_START = re.compile("(?<! ) ")
SPACE_MARK = "▁"
NEVER = np.int64(1) << 62
OFFSET_A, OFFSET_B, OFFSET_C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


class PieceModel:
    """Tables of a byte-pair model: merges by pair of symbols, characters, bytes.

    Symbols are the model's ids; characters that occur in pieces without being
    one themselves get ids after those.
    """

    def __init__(self, proto: bytes) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.size = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(self.size)]
        special = [sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(self.size)]
        self.byte_ids = np.zeros(256, np.int32)
        self.byte_of = {}
        for i in range(self.size):
            if sp.is_byte(i):
                value = int(self.pieces[i][1:-1], 16)
                self.byte_ids[value], self.byte_of[i] = i, value
        if len(self.byte_of) != 256:
            raise ValueError("the model has no byte pieces, so it cannot be lossless")
        known = {p: i for i, p in enumerate(self.pieces) if not special[i]}
        if any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in known):
            raise ValueError("the model has pieces across words")
        symbols = dict(known)
        for p in known:
            for c in p:
                symbols.setdefault(c, len(self.pieces) + len(symbols))
        self.char_id = np.full(0x110000, -1, np.int32)
        for p, i in symbols.items():
            if len(p) == 1:
                self.char_id[ord(p)] = i
        self.space = int(self.char_id[ord(SPACE_MARK)])
        self.char_id[ord(" ")], self.char_id[ord(SPACE_MARK)] = self.space, -1
        order = sorted(known, key=lambda p: (-sp.get_score(known[p]), known[p]))
        merges = []
        for rank, p in enumerate(order):
            for cut in range(1, len(p)):
                if p[:cut] in symbols and p[cut:] in symbols:
                    merges.append(((symbols[p[:cut]] << 32) | symbols[p[cut:]], rank, known[p]))
        merges.sort()
        self.keys, self.ranks = np.array([m[0] for m in merges], np.int64), np.array([m[1] for m in merges], np.int64)
        self.merged = np.array([m[2] for m in merges], np.int32)
        self.known_piece = np.zeros(max(symbols.values()) + 1, bool)
        self.known_piece[list(known.values())] = True
        bytes_of = [bytes([self.byte_of[i]]) if i in self.byte_of else p.replace(SPACE_MARK, " ").encode() for i, p in enumerate(self.pieces)]
        self.flat_bytes, self.byte_sizes = np.frombuffer(b"".join(bytes_of), np.uint8), np.array([len(b) for b in bytes_of])
        self.byte_starts = np.cumsum(self.byte_sizes) - self.byte_sizes
        self._index_merges()

    def _index_merges(self) -> None:
        """An open hash table of the pairs, four to eight times as large as their number."""
        self.shift = np.uint64(64 - max(4, len(self.keys).bit_length() + 2))
        slots = 1 << (64 - int(self.shift))
        self.table, self.entry = np.full(slots + len(self.keys), -1, np.int64), np.full(slots + len(self.keys), -1, np.int64)
        for i, at in enumerate(self._slot(self.keys).tolist()):
            while self.table[at] >= 0:
                at += 1
            self.table[at], self.entry[at] = self.keys[i], i

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * OFFSET_A) >> self.shift).astype(np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Index of each pair's merge, or -1."""
        keys = (left.astype(np.int64) << 32) | right
        at = self._slot(keys)
        found = self.table[at]
        result = np.where(found == keys, self.entry[at], -1)
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        while len(open_):
            at[open_] += 1
            found = self.table[at[open_]]
            hit = found == keys[open_]
            result[open_[hit]] = self.entry[at[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return np.where((left >= 0) & (right >= 0), result, -1)

    def decode(self, ids: np.ndarray) -> str:
        """The text: pieces joined, byte pieces as bytes, marks as spaces, without the mark put before every text."""
        out = []
        for low in range(0, len(ids), BATCH_CHARS):
            part = np.asarray(ids[low : low + BATCH_CHARS])
            out.append(self.flat_bytes[_spread(self.byte_starts[part], self.byte_sizes[part])].tobytes())
        return b"".join(out)[1:].decode()


@functools.lru_cache(maxsize=2)
def load(proto: bytes) -> PieceModel:
    return PieceModel(proto)


def _threshold(dropout: float) -> int:
    """How many of 65,536 equal draws skip a merge."""
    return round(dropout * 65536)


def _draws(keys: np.ndarray, turn: int, threshold: int) -> np.ndarray:
    """Whether the units of these keys skip the candidate that their agendas give in this turn."""
    word = splitmix(keys + np.uint64((turn // 4 + 1) * int(OFFSET_A) % 2**64))
    return ((word >> np.uint64(16 * (turn % 4))) & np.uint64(0xFFFF)) < threshold


def skip_masks(keys: np.ndarray, turns: np.ndarray, threshold: int) -> np.ndarray:
    """The draws of each unit's first turns as bits; keys come from seed, document and place."""
    masks = np.zeros(len(keys), np.uint64)
    if threshold <= 0:
        return masks
    for turn in range(int(turns.max(initial=0))):
        live = np.flatnonzero(turns > turn)
        masks[live] |= _draws(keys[live], turn, threshold).astype(np.uint64) << np.uint64(turn)
    return masks


def merge_one(model: PieceModel, symbols: np.ndarray, key: np.ndarray, threshold: int) -> tuple[list[int], list[int]]:
    """Merge one long unit by a heap; symbols and their places. key: an array of one."""
    n = len(symbols)
    sym, following, before = symbols.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
    alive, agenda, turn = [True] * n, [], 0

    def offer(a: int, b: int) -> None:
        if a >= 0 and b < n:
            at = int(model.lookup(np.array([sym[a]]), np.array([sym[b]]))[0])
            if at >= 0:
                heapq.heappush(agenda, (int(model.ranks[at]), a, b, sym[a], sym[b], at))

    for at in np.flatnonzero(model.lookup(symbols[:-1], symbols[1:]) >= 0).tolist():
        offer(at, at + 1)
    while agenda:
        _, a, b, sa, sb, at = heapq.heappop(agenda)
        if not (alive[a] and alive[b] and sym[a] == sa and sym[b] == sb and following[a] == b):
            continue
        turn += 1
        if _draws(key, turn - 1, threshold)[0]:
            continue
        sym[a], alive[b] = int(model.merged[at]), False
        following[a] = following[b]
        if following[a] < n:
            before[following[a]] = a
        offer(before[a], a)
        offer(a, following[a])
    live = [i for i in range(n) if alive[i]]
    return [sym[i] for i in live], live


def merge_units(model: PieceModel, sym: np.ndarray, unit: np.ndarray, masks: np.ndarray, turns: np.ndarray, keys: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Merge many units at once, one candidate of each a turn.

    sym: symbols, unit: the unit of each (ascending); masks: what each unit
    skips in its first `turns` turns, keys: what later turns draw from. Returns
    symbols and their indices.
    """
    index, turn = np.arange(len(sym)), 0
    done_sym, done_index = [], []

    def rank(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merge of the pairs that begin at these positions."""
        beyond = np.minimum(at + 1, len(sym) - 1)
        found = np.where((at + 1 < len(sym)) & (unit[at] == unit[beyond]), model.lookup(sym[at], sym[beyond]), -1)
        return np.where(found >= 0, model.ranks[found], NEVER >> 32), found

    if not len(sym):
        return sym, index
    ranks, merges = rank(np.arange(len(sym)))
    while len(sym):
        starts = np.flatnonzero(np.diff(unit, prepend=-1))
        best = np.minimum.reduceat((ranks << 32) | np.arange(len(sym)), starts)
        going = (best >> 32) < (NEVER >> 32)
        chosen = (best & 0xFFFFFFFF)[going]
        if threshold > 0:
            u = unit[chosen]
            skip = ((masks[u] >> np.uint64(min(turn, 63))) & np.uint64(1)).astype(bool)
            later = np.flatnonzero(turns[u] <= turn)
            skip[later] = _draws(keys[u[later]], turn, threshold)
            ranks[chosen[skip]] = NEVER >> 32
            chosen = chosen[~skip]
        turn += 1
        sym[chosen] = model.merged[merges[chosen]]
        keep = np.ones(len(sym), bool)
        keep[chosen + 1] = False
        stays = np.repeat(going, np.diff(starts, append=len(sym)))
        ended = keep & ~stays
        done_sym.append(sym[ended])
        done_index.append(index[ended])
        keep &= stays
        place = np.cumsum(keep) - 1
        fresh = np.zeros(int(keep.sum()), bool)
        merged = place[chosen]
        fresh[merged], fresh[np.maximum(merged - 1, 0)] = True, True
        sym, unit, index, ranks, merges = (x[keep] for x in (sym, unit, index, ranks, merges))
        touched = np.flatnonzero(fresh)
        if len(touched):
            # a pair before a merge is new even if its left symbol was skipped with the old one
            ranks[touched], merges[touched] = rank(touched)
    order = np.argsort(np.concatenate(done_index))
    return np.concatenate(done_sym)[order], np.concatenate(done_index)[order]


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indices of runs that begin at `starts`, one run after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def cut_units(model: PieceModel, codes: np.ndarray, sizes: np.ndarray, masks: np.ndarray, turns: np.ndarray, keys: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of units (code points, one unit after the other), and how many each has."""
    sym, unit = model.char_id[codes], np.repeat(np.arange(len(sizes)), sizes)
    short = sizes[unit] <= LONG_UNIT
    places = np.flatnonzero(short)
    got, index = merge_units(model, sym[short], unit[short], masks, turns, keys, threshold)
    ids, place = [got], [places[index]]
    starts = np.cumsum(sizes) - sizes
    for u in np.flatnonzero(sizes > LONG_UNIT).tolist():
        out, at = merge_one(model, sym[starts[u] : starts[u] + sizes[u]], keys[u : u + 1], threshold)
        ids.append(np.array(out, np.int32))
        place.append(np.array(at) + starts[u])
    place = np.concatenate(place)
    order = np.argsort(place)
    place, ids = place[order], np.concatenate(ids)[order]
    counts = np.ones(len(ids), np.int64)
    odd = (ids < 0) | ~model.known_piece[ids]
    if odd.any():  # characters without a piece: their UTF-8 bytes
        raw = [chr(c).encode() for c in codes[place[odd]].tolist()]
        counts[odd] = [len(r) for r in raw]
        ids = np.repeat(ids, counts)
        ids[np.repeat(odd, counts)] = model.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
    return ids.astype(np.int32), np.bincount(np.repeat(unit[place], counts), minlength=len(sizes))


class _Runs:
    """Runs of numbers, appended one after the other."""

    def __init__(self, kind: type) -> None:
        self.flat, self.used = np.empty(1 << 12, kind), 0
        self.starts, self.sizes = np.empty(0, np.int64), np.empty(0, np.int64)

    def append(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        self.flat[self.used : self.used + len(flat)] = flat
        self.starts = np.concatenate([self.starts, self.used + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.used += len(flat)


class Cuts:
    """Cuts that were worked out before, by a unit's characters and what it skips; at most about MAX_CUTS."""

    def __init__(self) -> None:
        self.index: dict[int, int] = {}
        self.chars, self.ids = _Runs(np.uint32), _Runs(np.int32)


class Encoder:
    def __init__(self, model: PieceModel, dropout: float) -> None:
        self.model, self.threshold, self.cuts = model, _threshold(dropout), Cuts()

    def batch(self, texts: list[str], first: list[int], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of stretches of texts that begin with a unit, and how many each has; first: the place of each in its text."""
        codes = [np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in texts]
        lengths = np.array([len(c) for c in codes])
        flat = np.concatenate(codes)
        ends = np.cumsum(lengths)
        space = flat == ord(" ")
        begins = space.copy()
        begins[1:] &= ~space[:-1]
        begins[(ends - lengths)[lengths > 0]] = True
        starts = np.flatnonzero(begins)
        sizes = np.diff(starts, append=len(flat))
        owner = np.searchsorted(ends, starts, side="right")
        places = starts - (ends - lengths)[owner] + np.array(first, np.int64)[owner]
        drawn = splitmix(splitmix(places.astype(np.uint64) * OFFSET_B) ^ keys[owner])
        turns = np.where(sizes <= MASKED_UNIT, sizes - 1, 0)
        masks = skip_masks(drawn, turns, self.threshold)
        ids, starts_of, counts = self._cut(flat, starts, sizes, masks, turns, drawn)
        found = ids[_spread(starts_of, counts)]
        return found, np.bincount(np.repeat(owner, counts), minlength=len(texts))

    def _cut(self, flat, starts, sizes, masks, turns, drawn) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where the run of each unit begins in them and how long it is."""
        up, down = powers(len(flat) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(splitmix(flat + np.uint64(1)) * up[: len(flat)])])
        names = splitmix((sums[starts + sizes] - sums[starts]) * down[starts] ^ splitmix(masks + OFFSET_C))
        if len(self.cuts.index) > MAX_CUTS:
            self.cuts = Cuts()
        cuts, kept = self.cuts, np.flatnonzero(turns == sizes - 1)
        entries = np.full(len(starts), -1)
        known = names[kept].tolist()
        entries[kept] = [cuts.index.get(k, -1) for k in known]
        new = kept[entries[kept] < 0]
        if len(new):
            fresh, one = np.unique(names[new], return_index=True)
            one = new[one]
            chars = flat[_spread(starts[one], sizes[one])]
            ids, counts = cut_units(self.model, chars, sizes[one], masks[one], turns[one], fresh, self.threshold)
            cuts.index.update(zip(fresh.tolist(), range(len(cuts.chars.sizes), len(cuts.chars.sizes) + len(one)), strict=True))
            cuts.chars.append(chars, sizes[one])
            cuts.ids.append(ids, counts)
            entries[new] = [cuts.index[k] for k in names[new].tolist()]
        same = np.zeros(len(starts), bool)
        same[kept] = cuts.chars.sizes[entries[kept]] == sizes[kept]
        sure = np.flatnonzero(same)
        if len(sure):  # other characters under an equal name must not share a cut
            differ = cuts.chars.flat[_spread(cuts.chars.starts[entries[sure]], sizes[sure])] != flat[_spread(starts[sure], sizes[sure])]
            same[sure] = ~np.logical_or.reduceat(differ, np.cumsum(sizes[sure]) - sizes[sure])
        starts_of, counts_of = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        starts_of[same], counts_of[same] = cuts.ids.starts[entries[same]], cuts.ids.sizes[entries[same]]
        alone = np.flatnonzero(~same)
        found = cuts.ids.flat[: cuts.ids.used]
        if len(alone):
            ids, counts = cut_units(self.model, flat[_spread(starts[alone], sizes[alone])], sizes[alone], masks[alone], turns[alone], drawn[alone], self.threshold)
            starts_of[alone], counts_of[alone] = len(found) + np.cumsum(counts) - counts, counts
            found = np.concatenate([found, ids])
        return found, starts_of, counts_of


def stretches(text: str) -> Iterator[tuple[int, str]]:
    """The text with the mark put before it, in stretches of about BATCH_CHARS that begin with a unit."""
    marked, at = f" {text}", 0
    while text and at < len(marked):
        cut = UNIT_START.search(marked, at + BATCH_CHARS)
        end = cut.start() if cut else len(marked)
        yield at, marked[at:end]
        at = end


def encode_rows(model: PieceModel, texts: list[str | None], keys: np.ndarray, dropout: float) -> list[np.ndarray | None]:
    """Piece ids of every text, in batches of about BATCH_CHARS characters; keys: one 64-bit number for each."""
    encoder = encoder_of(model, dropout)
    parts: list[list[np.ndarray]] = [[] for _ in texts]
    held: list[tuple[int, int, str]] = []

    def flush() -> None:
        rows = [h[0] for h in held]
        ids, counts = encoder.batch([h[2] for h in held], [h[1] for h in held], keys[rows])
        for r, part in zip(rows, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
            parts[r].append(part)
        held.clear()

    size = 0
    for i, t in enumerate(texts):
        for at, stretch in stretches(t or ""):
            if held and size + len(stretch) > BATCH_CHARS:
                flush()
                size = 0
            held.append((i, at, stretch))
            size += len(stretch)
    if held:
        flush()
    joined = (p[0] if len(p) == 1 else np.concatenate(p) if p else np.empty(0, np.int32) for p in parts)
    return [None if t is None else ids for t, ids in zip(texts, joined, strict=True)]


@functools.lru_cache(maxsize=2)
def encoder_of(model: PieceModel, dropout: float) -> Encoder:
    return Encoder(model, dropout)


def row_groups(text: pa.Array, limit: int = GROUP_BYTES) -> Iterator[pa.Array]:
    """Consecutive slices of about `limit` bytes, so that memory follows these and not the whole batch."""
    sizes = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)
    group = (np.cumsum(sizes) - sizes) // limit
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(text)]
    for s, e in itertools.pairwise(edges):
        if e > s:
            yield text.slice(s, e - s)


def _ids_array(rows: list[np.ndarray | None]) -> pa.Array:
    return pa.array(rows, pa.list_(pa.int32()))


def _keys_of(key: pa.Array) -> np.ndarray:
    return key.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _joined(parts: list[pa.Array], kind: pa.DataType) -> pa.Array:
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def _encoder(proto: bytes, dropout: float):
    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def udf(text: pa.Array, key: pa.Array) -> pa.Array:
        keys, parts, at = _keys_of(key), [], 0
        for rows in row_groups(text):
            parts.append(_ids_array(encode_rows(load(proto), rows.to_pylist(), keys[at : at + len(rows)], dropout)))
            at += len(rows)
        return _joined(parts, pa.list_(pa.int32()))

    return udf


def _decoder(proto: bytes):
    @F.arrow_udf(T.StringType())
    def udf(ids: pa.Array) -> pa.Array:
        model = load(proto)
        return pa.array((model.decode(row.values.to_numpy()) if row.is_valid else None for row in ids), pa.string())

    return udf


CODED = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("lossless", T.BooleanType())])


def _coder(proto: bytes, dropout: float):
    """Encodes, decodes the pieces again and compares, so that texts needn't come back from Python."""

    @F.arrow_udf(CODED)
    def udf(text: pa.Array, key: pa.Array) -> pa.Array:
        model, keys, parts, at = load(proto), _keys_of(key), [], 0
        kind = pa.struct([pa.field("ids", pa.list_(pa.int32())), pa.field("lossless", pa.bool_())])
        for group in row_groups(text):
            texts = group.to_pylist()
            rows = encode_rows(model, texts, keys[at : at + len(texts)], dropout)
            lossless = [t is None or model.decode(r) == t for t, r in zip(texts, rows, strict=True)]
            parts.append(pa.StructArray.from_arrays([_ids_array(rows), pa.array(lossless, pa.bool_())], fields=list(kind)))
            at += len(texts)
        return _joined(parts, kind)

    return udf


def read_model(path: str = MODEL_PATH) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def encoded(text: Column, key: Column, proto: bytes, dropout: float = DROPOUT, seed: int = SEED) -> Column:
    """Piece ids of a text column; `key` names the document that the dropout varies by."""
    return _encoder(proto, dropout)(text, F.xxhash64(F.lit(seed), key))


def decoded(ids: Column, proto: bytes) -> Column:
    return _decoder(proto)(ids)


def numbered_copies(docs: DataFrame, block: int = COPY_BLOCK) -> DataFrame:
    """(doc_id, text, copy): every row, with a number from 1 among those of equal doc_id and text.

    Equal rows are counted before the shuffle and drawn out again after it;
    those of over `block` copies are dealt out by blocks.
    """
    counted = docs.groupBy("doc_id", "text").agg(F.count("*").alias("n"))
    few = counted.filter(F.col("n") <= block).select("doc_id", "text", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy"))
    blocks = counted.filter(F.col("n") > block).select("doc_id", "text", "n", F.explode(F.sequence(F.lit(1).cast("long"), "n", F.lit(block).cast("long"))).alias("at"))
    dealt = blocks.repartition(shuffle_partitions(docs.sparkSession), "doc_id", "at")
    most = F.least("n", F.col("at") + (block - 1))
    return few.unionByName(dealt.select("doc_id", "text", F.explode(F.sequence("at", most)).alias("copy")))


def encode_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model_path: str = MODEL_PATH, dropout: float = DROPOUT, seed: int = SEED, copies: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids, lossless): pieces of each text, and whether they decode to it; with `copies`, equal rows are each cut in their own way."""
    given = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    names = ["doc_id", "copy"] if copies else ["doc_id"]
    coded = _coder(read_model(model_path), dropout)(F.col("text"), F.xxhash64(F.lit(seed), *[F.col(c) for c in names]))
    rows = in_small_batches(numbered_copies(given) if copies else given).select("doc_id", coded.alias("_coded"))
    ids = F.col("_coded.ids")
    return rows.select("doc_id", F.size(F.coalesce(ids, F.array().cast("array<int>"))).cast("long").alias("n_tokens"), ids.alias("ids"), F.col("_coded.lossless").alias("lossless"))


def op9_piece_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
