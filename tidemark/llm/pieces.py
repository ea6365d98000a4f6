"""SentencePiece encoding with seeded merge-dropout, and lossless decoding.

A text is cut before runs of spaces and around characters that no longer piece has, which no merge crosses. In each
unit the adjacent pair whose piece ranks best is merged first, until none is left. With dropout a candidate merge is
skipped for good where a keyed hash of the document, the unit's place and the candidate's place in the unit says so. So each
occurrence of a unit is segmented anew, with any of its forms, and the same on every run.
"""

from __future__ import annotations

import heapq
import importlib.util
import re
from collections import defaultdict
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import GOLDEN, filled, mix64, slices, table

SPACE = "▁"
NONE = np.iinfo(np.int32).max
#: Units of more characters are merged one by one, with a heap.
LONG = 48
#: Occurrences that are merged together with dropout, which bounds scratch memory.
BLOCK = 1 << 17


def default_model() -> str:
    """The public vocabulary file's place; another one can be given to every function here."""
    spec = importlib.util.find_spec("public_tokenizers")
    folder = spec.submodule_search_locations[0] if spec else "/opt/tokenizers"
    return f"{folder}/piece_bpe_32k.model"


@dataclass(frozen=True)
class Dropout:
    """share: of candidate merges that are skipped; 0 gives the model's own segmentation."""

    share: float = 0.1
    seed: int = 1


class PieceModel:
    """A merge-type model's pieces and merges as arrays: bounded by its vocabulary, so it is sent with a task."""

    def __init__(self, path: str | None = None):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path or default_model())
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        ids = {names[i]: i for i in plain}
        if any(SPACE in names[i].lstrip(SPACE) for i in plain):
            raise ValueError("a piece has a space after its first characters")
        order = sorted(plain, key=lambda i: (-sp.get_score(i), i))
        self.rank = np.full(n, NONE, np.int32)
        self.rank[order] = np.arange(len(order))
        self.of_rank = np.array(order, np.int32)
        self.size = n
        pairs = sorted((ids[p[:k]] * n + ids[p[k:]], int(self.rank[i])) for p, i in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids)
        self.pair_keys, self.pair_ranks = (np.array(x) for x in zip(*pairs))
        self.pair_ranks = self.pair_ranks.astype(np.int32)
        self._hash_pairs()
        self.char = {p: i for p, i in ids.items() if len(p) == 1}
        self.bytes = {int(names[i][1:-1], 16): i for i in range(n) if sp.is_byte(i)}
        self.text = [bytes([int(names[i][1:-1], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) or sp.is_unknown(i) else names[i].replace(SPACE, " ").encode() for i in range(n)]
        joined = sorted({c for p in ids if len(p) > 1 for c in p} - {SPACE})
        if not set(joined) <= set(self.char):
            raise ValueError("a character of a longer piece is no piece")
        inner = "".join(re.escape(c) for c in joined)
        self.unit = re.compile(f" *[{inner}]+| +(?=[^{inner} ]|$)|[^{inner} ]")
        self.codes = np.full(0x110000, -1, np.int32)
        for c, i in self.char.items():
            self.codes[ord(" " if c == SPACE else c)] = i
        self.codes[ord(SPACE)] = -1

    def lone(self, unit: str) -> list[int]:
        """A character that no merge takes: its piece, or its bytes. The sign that stands for a space goes as bytes."""
        found = self.char.get(unit) if unit != SPACE else None
        return [found] if found is not None else [self.bytes[b] for b in unit.encode()]

    def _slots(self, key: np.ndarray) -> np.ndarray:
        return (mix64(key.astype(np.uint64)) >> np.uint64(64 - self.slot_bits)).astype(np.int64)

    def _hash_pairs(self) -> None:
        """An open-addressing table of the pairs, a quarter full at most."""
        self.slot_bits = max(4, int(len(self.pair_keys) * 4 - 1).bit_length())
        self.slots = np.full(1 << self.slot_bits, -1, np.int32)
        todo, at = np.arange(len(self.pair_keys)), self._slots(self.pair_keys)
        while len(todo):
            free = np.flatnonzero(self.slots[at] < 0)
            taken, first = np.unique(at[free], return_index=True)
            self.slots[taken] = todo[free[first]]
            left = np.ones(len(todo), bool)
            left[free[first]] = False
            todo, at = todo[left], (at[left] + 1) & (len(self.slots) - 1)

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of the piece that each pair makes; NONE if it makes none."""
        key = left.astype(np.int64) * self.size + right
        ranks = np.full(len(key), NONE, np.int32)
        open_, at = np.arange(len(key)), self._slots(key)
        while len(open_):
            pair = self.slots[at]
            hit = (self.pair_keys[pair] == key[open_]) & (pair >= 0)
            ranks[open_[hit]] = self.pair_ranks[pair[hit]]
            on = ~hit & (pair >= 0)
            open_, at = open_[on], (at[on] + 1) & (len(self.slots) - 1)
        return ranks

    @staticmethod
    def skipped(key: np.ndarray, start: np.ndarray, middle: np.ndarray, stop: np.ndarray, share: float) -> np.ndarray:
        place = (start.astype(np.uint64) << np.uint64(42)) ^ (middle.astype(np.uint64) << np.uint64(21)) ^ stop.astype(np.uint64)
        return mix64(mix64(key + place * np.uint64(GOLDEN)) ^ key) < np.uint64(min(int(share * 2**64), 2**64 - 1))

    def merge_units(self, strings: list[str], which: np.ndarray, keys: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
        """The pieces of the units strings[which], one after the other, and how many each has; keys: what the hashes of a unit's candidates are keyed by."""
        codes = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32)
        length = np.fromiter(map(len, strings), np.int64, len(strings))
        begin = np.cumsum(length) - length
        alone = (length == 1) & (self.codes[codes[begin]] < 0)
        special = (length > LONG) | alone
        short = np.flatnonzero(~special[which])
        sizes = np.zeros(len(which), np.int64)
        found: dict[int, np.ndarray] = {}
        for k in np.flatnonzero(special[which]).tolist():
            u = strings[which[k]]
            found[k] = np.array(self.lone(u), np.int32) if alone[which[k]] else self._with_heap(u, keys[k], share)
            sizes[k] = len(found[k])
        flat = np.zeros(0, np.int32)
        if len(short):
            n = length[which[short]]
            place = np.repeat(begin[which[short]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            flat, sizes[short] = self._in_steps(codes[place], n, keys[short], share)
        if not found:
            return flat, sizes
        pool = np.zeros(int(sizes.sum()), np.int32)
        first = np.cumsum(sizes) - sizes
        n = sizes[short]
        pool[np.repeat(first[short] - (np.cumsum(n) - n), n) + np.arange(n.sum())] = flat
        for k, ids in found.items():
            pool[first[k] : first[k] + len(ids)] = ids
        return pool, sizes

    def _in_steps(self, text: np.ndarray, sizes: np.ndarray, keys: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
        """All units at once, of the code points of all and the size of each: each step does every unit's best merge."""
        sym, of = self.codes[text], np.repeat(np.arange(len(sizes)), sizes)
        start = np.arange(len(sym)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        length = sizes
        done_sym, done_of = [], []

        def candidates(i: np.ndarray) -> np.ndarray:
            """Ranks of the pairs (i, i + 1)."""
            ranks = np.full(len(i), NONE, np.int32)
            ok = np.flatnonzero((i >= 0) & (i + 1 < len(sym)))
            ok = ok[of[i[ok]] == of[i[ok] + 1]]
            a = i[ok]
            found = self.ranks_of(sym[a], sym[a + 1])
            if share > 0:
                live = found < NONE
                b = a[live]
                after = np.minimum(b + 2, len(sym) - 1)
                stop = np.where((b + 2 < len(sym)) & (of[after] == of[b]), start[after], length[of[b]])
                found[live] = np.where(self.skipped(keys[of[b]], start[b], start[b + 1], stop, share), NONE, found[live])
            ranks[ok] = found
            return ranks

        rank = candidates(np.arange(len(sym)))
        while len(sym):
            edges = np.flatnonzero(np.diff(of, prepend=-1))
            best = np.minimum.reduceat(rank, edges)
            counts = np.diff(np.append(edges, len(of)))
            each = np.repeat(best, counts)
            over = each == NONE
            if over.any():
                done_sym.append(sym[over])
                done_of.append(of[over])
                sym, of, start, rank, each = (x[~over] for x in (sym, of, start, rank, each))
                if not len(sym):
                    break
            at = np.flatnonzero(rank == each)
            at = at[np.diff(of[at], prepend=-1) != 0]
            sym[at] = self.of_rank[rank[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            place = np.cumsum(keep) - 1
            sym, of, start, rank = (x[keep] for x in (sym, of, start, rank))
            at = place[at]
            both = np.concatenate([at, at - 1])
            fresh = candidates(both)
            ok = both >= 0
            rank[both[ok]] = fresh[ok]
        sym, of = np.concatenate(done_sym), np.concatenate(done_of)
        return sym[np.argsort(of, kind="stable")], np.bincount(of, minlength=len(sizes))

    def _with_heap(self, unit: str, key: np.uint64, share: float) -> np.ndarray:
        """The same for one long unit: an agenda of candidates, best first."""
        sym = self.codes[np.frombuffer(unit.encode("utf-32-le", "surrogatepass"), np.uint32)].tolist()
        n = len(sym)
        after, before, stop = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        agenda: list[tuple[int, int, int, int]] = []

        def offer(places: list[int]) -> None:
            places = [i for i in places if i >= 0 and after[i] < n]
            if not places:
                return
            a = np.array(places)
            b = np.array([after[i] for i in places])
            found = self.ranks_of(np.array([sym[i] for i in places]), np.array([sym[j] for j in b]))
            ends = np.array([stop[j] for j in b])
            if share > 0:
                found = np.where(self.skipped(np.full(len(a), key), a, b, ends, share), NONE, found)
            for i, j, e, r in zip(places, b.tolist(), ends.tolist(), found.tolist()):
                if r < NONE:
                    heapq.heappush(agenda, (r, i, j, e))

        offer(list(range(n)))
        while agenda:
            r, i, j, e = heapq.heappop(agenda)
            if sym[i] < 0 or sym[j] < 0 or after[i] != j or stop[j] != e or stop[i] != j:
                continue
            sym[i], sym[j] = int(self.of_rank[r]), -1
            stop[i], after[i] = e, after[j]
            if after[i] < n:
                before[after[i]] = i
            offer([before[i], i])
        return np.array([s for s in sym if s >= 0], np.int32)

    def decode(self, ids) -> bytes:
        """The text of piece ids, less the space that encoding sets before it."""
        return b"".join(map(self.text.__getitem__, ids))[1:]


class Encoder:
    """Encodes many texts at once. With dropout each occurrence is merged; without, a unit that recurs is merged once while the memory for units lasts.

    Units are numbered as they come. A unit that is merged once has a place and a length in one pool of pieces; after
    `held` units all are forgotten, which changes no result.
    """

    def __init__(self, model: PieceModel, dropout: Dropout, held: int = 250_000):
        self.m, self.d, self.held = model, dropout, held
        self._forget()

    def _forget(self) -> None:
        self.names: dict[str, int] = defaultdict(count().__next__)
        self.length, self.place, self.pool, self.used = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(1 << 16, np.int32), 0

    def _learn(self, kinds: np.ndarray) -> None:
        """Merges the units that are new."""
        short = len(self.names) - len(self.length)
        if short > 0:
            self.length = np.concatenate([self.length, np.full(short, -1, np.int32)])
            self.place = np.concatenate([self.place, np.zeros(short, np.int64)])
        new = kinds[self.length[kinds] < 0]
        if not len(new):
            return
        every = list(self.names)
        flat, sizes = self.m.merge_units([every[k] for k in new.tolist()], np.arange(len(new)), np.zeros(len(new), np.uint64), 0.0)
        if self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(flat)), np.int32)])
        self.pool[self.used : self.used + len(flat)] = flat
        self.length[new], self.place[new] = sizes, self.used + np.cumsum(sizes) - sizes
        self.used += len(flat)

    def _dropped(self, unit: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pieces of all occurrences, one after the other, and how many each has, of their units and keys."""
        every, out = list(self.names), []
        for a in range(0, len(unit), BLOCK):
            kinds, which = np.unique(unit[a : a + BLOCK], return_inverse=True)
            out.append(self.m.merge_units([every[k] for k in kinds.tolist()], which, keys[a : a + BLOCK], self.d.share))
        flat, sizes = zip(*out)
        return np.concatenate(flat), np.concatenate(sizes)

    def encode(self, texts: list[str], keys: np.ndarray) -> list[np.ndarray]:
        if len(self.names) > self.held:
            self._forget()
        flat: list[int] = []
        sizes = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if text:
                found = self.m.unit.findall(" " + text)
                sizes[i] = len(found)
                flat.extend(map(self.names.__getitem__, found))
        if not flat:
            return [np.zeros(0, np.int32) for _ in texts]
        unit = np.array(flat, np.int64)
        ends = np.cumsum(sizes)
        if self.d.share > 0:
            place = np.arange(len(unit)) - np.repeat(ends - sizes, sizes)
            ids, each = self._dropped(unit, mix64(np.repeat(mix64(keys ^ np.uint64(self.d.seed)), sizes) + place.astype(np.uint64) * np.uint64(GOLDEN)))
            total = np.cumsum(each)
        else:
            self._learn(np.unique(unit))
            each = self.length[unit].astype(np.int64)
            total = np.cumsum(each)
            ids = self.pool[np.repeat(self.place[unit] - (total - each), each) + np.arange(total[-1])]
        stops = np.concatenate([[0], total])[np.concatenate([[0], ends])]
        return [ids[a:b] for a, b in zip(stops, stops[1:])]


def encoded(docs: DataFrame, model: PieceModel | None = None, dropout: Dropout | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of docs less the text, with pieces (array of int) and lossless (decoding them gives the text's bytes again).

    Columns with these names are replaced. Null texts have null pieces and are lossless; empty ones have none. Rows with
    equal key and text have equal pieces; null keys draw as 0 does. Texts go whole, however long: a batch of them is held with its pieces.
    """
    model, dropout = model or PieceModel(), dropout or Dropout()
    rest = [c for c in docs.columns if c not in (text, "pieces", "lossless")]

    def run(batches):
        encoder = Encoder(model, dropout)
        for batch in batches:
            for part in slices(batch, "__text", 1 << 20):
                raw = part.column("__text")
                texts = filled(raw).to_pylist()
                missing = raw.is_null().to_numpy(zero_copy_only=False)
                keys = part.column("__key").fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)
                found = encoder.encode(texts, keys)
                whole = [not ids.size and not t or model.decode(ids.tolist()) == t.encode() for ids, t in zip(found, texts)]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32(), mask=np.append(missing, False)) if missing.any() else pa.array(offsets), pa.array(np.concatenate(found) if found else np.zeros(0, np.int32), pa.int32()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), lists, pa.array(whole)], [*rest, "pieces", "lossless"])

    chosen = docs.select(*(F.col(f"`{c}`") for c in rest), F.col(f"`{text}`").alias("__text"), F.xxhash64(F.coalesce(F.col(f"`{key}`"), F.lit(0))).alias("__key"))
    kept = [f for f in chosen.schema.fields if f.name in rest]
    return chosen.mapInArrow(run, T.StructType([*kept, T.StructField("pieces", T.ArrayType(T.IntegerType())), T.StructField("lossless", T.BooleanType())]))


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encoded(docs).select("doc_id", F.size("pieces").cast("long").alias("n_pieces"), "lossless", "pieces")
