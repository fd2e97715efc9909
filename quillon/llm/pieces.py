"""Encoding and decoding with a BPE model of the sentencepiece library, by vectorised merge rounds.

The library merges, over and over, the pair of neighbouring symbols whose joined piece has the best score, the leftmost on a tie. No
piece of a model that this module takes crosses from another character into a space mark, nor holds a line end beside another
character; so a text falls into words (space marks and what follows up to the next, or one line end) that are merged on their
own. All new words of a batch lie in one flat array of symbols. A round looks up the rank of every pair of neighbours, takes each
word's minimum, merges its leftmost occurrences at once and compacts the array; words without a pair leave. Merging at once is
what merging one by one gives unless a merge makes a pair of the same or a better rank; a word where that happens merges its
leftmost only in that round. Words over ``LONG`` symbols, which would take a round for nearly every rank, are merged one by one
from a heap, with the same result.

Null text counts as empty, which gives the begin and end ids alone. Every row is encoded by itself, so repeated rows give repeated
results and null doc_ids stay. Columns other than doc_id and text are not read. Texts are processed whole, a stretch at a time.
"""

from __future__ import annotations

import codecs
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import small_batches

MARK = "▁"  # what the model has for a space
LONG = 512
#: Characters that are no piece of their own are symbols from here on.
BASE = 1 << 21
NEVER = np.iinfo(np.int64).max
WORDS = re.compile("\n| *[^ \n]+| +")
STRETCH = 1 << 20

_loaded: dict[str, "PieceModel"] = {}


def default_piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def piece_model(path: str) -> "PieceModel":
    """The worker's model of a file, loaded once a process."""
    if path not in _loaded:
        _loaded[path] = PieceModel(path)
    return _loaded[path]


def _one_each(error: UnicodeError) -> tuple[str, int]:
    """The library writes one replacement character for each byte that fits nowhere."""
    if not isinstance(error, UnicodeDecodeError):
        raise error
    return "�", error.start + 1


codecs.register_error("quillon-one-each", _one_each)


def words(text: str) -> Iterator[list[str]]:
    """The words of a text with its leading space, in lists that cover a stretch each."""
    text, at = " " + text.replace(MARK, " "), 0
    while at < len(text):
        end = at + STRETCH
        while 0 <= (end := text.find(" ", end)) and text[end - 1] == " ":  # a word begins at the first of several spaces
            end += 1
        end = end if end > 0 else len(text)
        yield WORDS.findall(text, at, end)
        at = end


class PieceModel:
    """The pieces of a model file, the table of pairs that merge, and the words met so far.

    most: words kept before they become the older ones, which are kept as long again. Words over 64 characters are not kept.
    """

    def __init__(self, path: str, most: int = 300_000):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if model.normalize(" Ａ\t  a") != f"{MARK * 2}Ａ\t{MARK * 2}a":
            raise ValueError("only models that leave the text as it is, behind a leading space mark, are supported")
        kinds = [(model.is_control(i), model.is_unknown(i), model.is_byte(i)) for i in range(model.get_piece_size())]
        names = [model.id_to_piece(i) for i in range(len(kinds))]
        if any(model.is_unused(i) for i in range(len(kinds))) or sum(byte for *_, byte in kinds) != 256:
            raise ValueError("only models with the 256 byte pieces and without unused pieces are supported")
        own = {name: i for i, name in enumerate(names) if not any(kinds[i])}
        if any(re.search(f"[^{MARK}]{MARK}|\n.|.\n", name, re.DOTALL) for name in own):
            raise ValueError("a piece of the model runs across words")
        self.begin, self.end, self.most = model.bos_id(), model.eos_id(), most
        self.bytes = [i for i, (*_, byte) in sorted(((i, k) for i, k in enumerate(kinds) if k[2]), key=lambda x: int(names[x[0]][3:5], 16))]
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.points = np.arange(0x110000, dtype=np.int64) + BASE
        for name, i in own.items():
            if len(name) == 1:
                self.points[ord(name)] = i
        scores = np.array([model.get_score(i) for i in range(len(kinds))])
        self.rank = np.unique(-scores, return_inverse=True)[1].astype(np.int64)
        symbol = lambda part: own.get(part, BASE + ord(part) if len(part) == 1 else None)
        pairs = [(left << 22 | right, i) for name, i in own.items() for k in range(1, len(name)) if (left := symbol(name[:k])) is not None and (right := symbol(name[k:])) is not None]
        self.keys, self.products = (np.array(x, np.int64) for x in zip(*sorted(pairs), strict=True)) if pairs else (np.array([-1]), np.array([0]))
        self.table = dict(pairs)
        self.surfaces = [b"" if control else b" \xe2\x81\x87 " if unknown else b"" if byte else name.replace(MARK, " ").encode() for name, (control, unknown, byte) in zip(names, kinds, strict=True)]
        for value, i in enumerate(self.bytes):
            self.surfaces[i] = bytes([value])
        self.silent, self.other = np.array([k[0] for k in kinds]), {i for i, k in enumerate(kinds) if k[1] or k[2]}

    # -- encoding

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, with the begin and end ids, as little-endian unsigned 32-bit numbers."""
        begin, end = (np.array([i], "<u4").tobytes() for i in (self.begin, self.end))
        parts: list[list[bytes]] = [[begin] for _ in texts]
        held: list[tuple[int, list[str]]] = []
        size = 0
        for k, text in enumerate(texts):
            for found in words(text) if text else ():
                held.append((k, found))
                size += len(found)
                if size >= self.most // 2:
                    self._add(held, parts)
                    held, size = [], 0
        self._add(held, parts)
        return [b"".join([*p, end]) for p in parts]

    def _add(self, held: list[tuple[int, list[str]]], parts: list[list[bytes]]) -> None:
        """Ids of lists of words to the texts they are of; the new words of all lists are merged together."""
        if len(self.known) > self.most:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        missing = set().union(*[found for _, found in held]).difference(known)
        if old := [w for w in missing if w in older]:
            known.update({w: older[w] for w in old})
        new = list(missing.difference(old))
        known.update(zip(new, self.merge(new), strict=True))
        for k, found in held:
            parts[k].append(b"".join(map(known.__getitem__, found)))
        for w in [w for w in new if len(w) > 64]:
            del known[w]

    def merge(self, found: list[str]) -> list[bytes]:
        """The ids of each word: short ones in rounds, all at once; long ones from a heap."""
        points = lambda text: self.points[np.frombuffer(text.replace(" ", MARK).encode("utf-32-le"), "<u4")]
        short = [w for w in found if len(w) <= LONG]
        flat, ends = self.merge_rounds(points("".join(short)), np.array([len(w) for w in short], np.int64))
        rounds = iter(self._cut(flat, ends))
        return [next(rounds) if len(w) <= LONG else self._cut(done := self.merge_by_heap(points(w)), np.array([len(done)]))[0] for w in found]

    def _cut(self, flat: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """Ids of the words that end at ``ends``; characters without a piece go by their bytes."""
        if (odd := np.flatnonzero(flat >= BASE)).size:
            spelled = [[self.bytes[b] for b in chr(c - BASE).encode()] for c in flat[odd].tolist()]
            times = np.ones(len(flat), np.int64)
            times[odd] = [len(x) for x in spelled]
            ends = np.r_[0, np.cumsum(times)][ends]
            flat = np.repeat(flat, times)
            flat[flat >= BASE] = [i for x in spelled for i in x]
        ids, bounds = flat.astype("<u4").tobytes(), [0, *(4 * ends).tolist()]
        return [ids[i:j] for i, j in zip(bounds, bounds[1:], strict=False)]

    def _products(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The piece that each pair joins to, and its rank; NEVER where there is none."""
        key = left << 22 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        product = self.products[at]
        return product, np.where(self.keys[at] == key, self.rank[product], NEVER)

    def merge_rounds(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words back to back, of so many symbols each, after their last merges: the symbols that are left, and where each word ends."""
        if not len(symbols):
            return symbols, sizes
        word = np.repeat(np.arange(len(sizes)), sizes)
        product, rank = self._products(symbols, np.r_[symbols[1:], 0])
        rank[np.cumsum(sizes) - 1] = NEVER  # a word's last symbol has no right neighbour
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            change = np.r_[True, word[1:] != word[:-1]]
            best = np.minimum.reduceat(rank, np.flatnonzero(change))
            own = best[np.cumsum(change) - 1]
            if (over := own == NEVER).any():
                done.append((word[over], symbols[over]))
                symbols, word, product, rank, own = (x[~over] for x in (symbols, word, product, rank, own))
                if not len(symbols):
                    break
            hits = np.flatnonzero(rank == own)
            first = np.r_[True, hits[1:] != hits[:-1] + 1]
            run = np.maximum.accumulate(np.where(first, np.arange(len(hits)), 0))
            hits = hits[(np.arange(len(hits)) - run) % 2 == 0]  # of pairs that overlap, the first, the third and so on
            hits = hits[~self._waits(symbols, word, product, rank, hits)]
            symbols[hits] = product[hits]
            keep = np.ones(len(symbols), bool)
            keep[hits + 1] = False
            symbols, word, product, rank = symbols[keep], word[keep], product[keep], rank[keep]
            hits -= np.arange(len(hits))  # where they stand now; only pairs with a merged symbol are new
            near = np.concatenate([hits, hits[hits > 0] - 1])
            after = np.minimum(near + 1, len(symbols) - 1)
            product[near], rank[near] = self._products(symbols[near], symbols[after])
            rank[near[(word[near] != word[after]) | (near == after)]] = NEVER
        of, flat = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(of, kind="stable")
        return flat[order], np.cumsum(np.bincount(of, minlength=len(sizes)))

    def _waits(self, symbols: np.ndarray, word: np.ndarray, product: np.ndarray, rank: np.ndarray, hits: np.ndarray) -> np.ndarray:
        """Merges to leave for a later round: all but the leftmost of a word in which a merge makes a pair that comes before or beside the rest."""
        later = np.r_[False, word[hits[1:]] == word[hits[:-1]]]
        if not later.any():
            return later
        several = later | np.r_[later[1:], False]
        some = hits[several]
        joined = product[some]
        # the left neighbour is as the merges before have left it, the right one as it stands
        merged = np.zeros(len(symbols), bool)
        merged[hits] = True
        near = merged[some - 2] & (some >= 2)
        left = np.where(near, product[some - 2], symbols[some - 1])
        far = np.minimum(some + 2, len(symbols) - 1)
        early = (self._products(left, joined)[1] <= rank[some]) & (some >= 1) & (word[some - 1] == word[some])
        early |= (self._products(joined, symbols[far])[1] <= rank[some]) & (some + 2 < len(symbols)) & (word[far] == word[some])
        held = np.zeros(int(word[-1]) + 1, bool)
        held[word[some[early]]] = True
        return later & held[word[hits]]

    def merge_by_heap(self, symbols: np.ndarray) -> np.ndarray:
        """One word's symbols after its last merge, merged one by one."""
        at = symbols.tolist()
        left, right = list(range(-1, len(at) - 1)), [*range(1, len(at)), -1]
        product, rank = self._products(symbols[:-1], symbols[1:])
        heap = [(int(rank[i]), int(i), at[i], at[i + 1], int(product[i])) for i in np.flatnonzero(rank != NEVER)]
        heapq.heapify(heap)

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (new := self.table.get(at[i] << 22 | at[j])) is not None:
                heapq.heappush(heap, (int(self.rank[new]), i, at[i], at[j], new))

        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = right[i]
            if at[i] != a or j < 0 or at[j] != b:  # one of the two has been merged meanwhile
                continue
            at[i], at[j], right[i] = new, -1, right[j]
            if right[i] >= 0:
                left[right[i]] = i
            offer(left[i], i)
            offer(i, right[i])
        return np.array([s for s in at if s >= 0], np.int64)

    # -- decoding

    def decode(self, ids: bytes) -> str:
        """The text of ids: space marks become spaces, the one that begins the text goes, byte pieces are joined as UTF-8."""
        numbers = np.frombuffer(ids, "<u4")
        runs = [r.tolist() for r in np.split(numbers, np.flatnonzero(self.silent[numbers]))]  # a control piece ends a run of byte pieces
        text = "".join([b"".join(map(self.surfaces.__getitem__, run)).decode("utf-8", "quillon-one-each") for run in runs])
        first = next((i for run in runs for i in run if not self.silent[i]), None)
        return text[1:] if first is not None and first not in self.other and self.surfaces[first][:1] == b" " else text


def encode(docs: DataFrame, model_path: str, decoded: bool = False) -> DataFrame:
    """doc_id and ids (binary: little-endian unsigned 32-bit, begin and end ids included) of each row; with ``decoded`` also the text that the ids give."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(model_path)
        for batch in batches:
            ids = model.encode(batch.column(1).to_pylist())
            columns = [batch.column(0), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([model.decode(x) for x in ids], pa.string())] if decoded else columns, names=["doc_id", "ids", "decoded"][: 2 + decoded])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary" + ", decoded string" * decoded)


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id and text of rows with doc_id and ids as ``encode`` returns them; null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(model_path)
        for batch in batches:
            texts = [None if x is None else model.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    small_batches(encoded.sparkSession)
    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
