"""SentencePiece BPE encoding and decoding by a table of distinct chunks (operator 12).

Under a vocabulary no piece of which has a whitespace marker behind another character, merges never cross the place where
a marker follows a character that is none. The same holds for a line feed and for a full stop or comma behind a letter, if
no piece has them. So a text falls apart there into chunks (a marked word each), each distinct chunk is segmented once, and
the ids are joined back by the chunks' positions. Known chunks stay in a table bounded by bytes, which is dropped with the
task. A vocabulary with a piece that crosses the chunks is refused.

Segmentation merges, among the adjacent pairs whose concatenation is a piece, the leftmost one of the best score, until
none is left; symbols outside the vocabulary become their UTF-8 bytes' pieces. Many chunks are merged at once, one merge
each a round; a chunk longer than `WIDEST` symbols takes its pairs from a heap, so its time stays in proportion to it.

Defined results: a null or empty text has no ids and decodes to the empty text; a marker inside a text is the space that it
stands for, as in the library; texts are never cut; repeated rows each give a row. Columns other than doc_id and text are
never read.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.llm._common import slices, table

MARK = "▁"
LETTERS, POINTS = "A-Za-zÀ-ɏ", ",.;:!?"
#: A marked word ends before a point, a marker or a line feed; what follows a point stays with it.
CHUNK = re.compile(f"{MARK}*(?:[{LETTERS}]++(?=[{POINTS}])|[^{MARK}\n]+)|\n+|{MARK}+")
#: Where no piece may cross for these chunks to be exact.
CROSSING = re.compile(f"[^{MARK}]{MARK}|\n|[{LETTERS}][{POINTS}]")
BYTE = re.compile("<0x([0-9A-F]{2})>")
#: Symbols of the longest chunk that is merged together with others.
WIDEST = 32
#: Symbols that one pass takes at most.
PASS_SYMBOLS = 1 << 18
#: What stands for a control piece until bytes are put together, which it parts.
CONTROL = "\ud800"
#: Bytes of the table of chunks, and what an entry takes besides its characters.
MOST_BYTES, ENTRY_BYTES = 64 << 20, 200
#: The rank of a pair that is no piece.
NONE = 1 << 30
SUMMARY = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """The vocabulary as arrays: symbols are piece ids, characters outside it numbers from `size` on."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(self.size)]
        plain = [not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)) for i in range(self.size)]
        crossing = [x for x, p in zip(names, plain, strict=True) if p and CROSSING.search(x)]
        if crossing:
            raise ValueError(f"pieces cross the chunks: {crossing[:3]}")
        self.names, self.unknown = names, model.unk_id()
        self.ids = {x: i for i, (x, p) in enumerate(zip(names, plain, strict=True)) if p}
        self.bytes = {int(BYTE.fullmatch(x)[1], 16): i for i, x in enumerate(names) if model.is_byte(i)}
        self.is_control = [model.is_control(i) for i in range(self.size)]
        #: Equal scores share a rank, the best is 0.
        scores = -np.array([model.get_score(i) for i in range(self.size)])
        self.rank_of = np.unique(scores, return_inverse=True)[1].astype(np.int64)
        pairs = [(self.ids[x[:k]], self.ids[x[k:]], i) for x, i in self.ids.items() for k in range(1, len(x)) if x[:k] in self.ids and x[k:] in self.ids]
        joined = np.array(pairs, np.int64).reshape(-1, 3)
        keys = joined[:, 0] << 32 | joined[:, 1]
        order = np.argsort(keys)
        self.keys, self.joined = keys[order], joined[order, 2]
        self.pairs = {(a, b): i for a, b, i in pairs}
        #: A piece's text; of a byte's piece its byte as a lone surrogate, which decoding puts together.
        self.texts = [x.replace(MARK, " ") for x in names]
        for b, i in self.bytes.items():
            self.texts[i] = chr(0xDC00 + b)
        self.texts = [CONTROL if c else x for x, c in zip(self.texts, self.is_control, strict=True)]
        self.texts[self.unknown] = " ⁇ "
        if any(len(x) > 1 and any(c not in self.ids for c in x) for x in self.ids):
            raise ValueError("a character of a piece is no piece")

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair makes, -1 where it makes none."""
        wanted = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.joined[at], -1)

    def segment(self, chunks: list[str]) -> list[list[int]]:
        """The ids of each chunk."""
        out: list[list[int]] = [[]] * len(chunks)
        widths: dict[int, list[int]] = {}
        for i, chunk in enumerate(chunks):
            if len(chunk) > WIDEST:
                out[i] = self._ids(chunk, self._merge_long([self.ids.get(c, self.size + ord(c)) for c in chunk]))
            else:
                widths.setdefault(len(chunk), []).append(i)
        for width, members in widths.items():
            step = max(1, PASS_SYMBOLS // width)
            for a in range(0, len(members), step):
                some = members[a : a + step]
                codes = np.frombuffer("".join([chunks[i] for i in some]).encode("utf-32-le"), np.uint32).reshape(-1, width)
                for i, symbols in zip(some, self._merge_rows(codes), strict=True):
                    out[i] = self._ids(chunks[i], symbols)
        return out

    def _merge_rows(self, codes: np.ndarray) -> list[list[int]]:
        """Symbols of chunks of one width after all merges: every round merges the best leftmost pair of each row."""
        letters, inverse = np.unique(codes, return_inverse=True)
        known = np.array([self.ids.get(chr(c), self.size + int(c)) for c in letters], np.int64)
        symbols = known[inverse.reshape(codes.shape)]
        width = symbols.shape[1]
        pairs = self.merged(symbols[:, :-1], symbols[:, 1:])
        ranks = np.where(pairs >= 0, self.rank_of[pairs], NONE)
        done: list[list[int]] = [[]] * len(symbols)
        rows = np.arange(len(symbols))
        while len(rows):
            best = ranks.argmin(axis=1) if width > 1 else np.zeros(len(rows), np.int64)
            going = ranks[np.arange(len(rows)), best] < NONE if width > 1 else np.zeros(len(rows), bool)
            for r, row in zip(rows[~going].tolist(), symbols[~going].tolist(), strict=True):
                done[r] = row
            if not going.all():
                rows, symbols, pairs, ranks, best = rows[going], symbols[going], pairs[going], ranks[going], best[going]
            if not len(rows):
                break
            each, width = np.arange(len(rows)), width - 1
            symbols[each, best] = pairs[each, best]
            behind = np.arange(width)
            symbols = symbols[each[:, None], behind + (behind > best[:, None])]
            # The merged pair goes; the ones on either side of it are other pairs now.
            behind = behind[:-1]
            at = behind + (behind >= best[:, None])
            pairs, ranks = pairs[each[:, None], at], ranks[each[:, None], at]
            for side, held in ((best - 1, best > 0), (best, best < width - 1)):
                r, i = each[held], side[held]
                new = self.merged(symbols[r, i], symbols[r, i + 1])
                pairs[r, i], ranks[r, i] = new, np.where(new >= 0, self.rank_of[new], NONE)
        return done

    def _merge_long(self, symbols: list[int]) -> list[int]:
        """The same for one long chunk: pairs wait in a heap by (rank, place); one that has changed meanwhile is skipped."""
        after, before = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            piece = self.pairs.get((symbols[i], symbols[j]))
            if piece is not None:
                heap.append((int(self.rank_of[piece]), i, symbols[i], symbols[j]))

        for i in range(len(symbols) - 1):
            offer(i, i + 1)
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != left or j >= len(symbols) or symbols[j] != right:
                continue
            symbols[i], symbols[j] = self.pairs[left, right], -1
            after[i] = after[j]
            if after[i] < len(symbols):
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < len(symbols):
                    n = len(heap)
                    offer(a, b)
                    if len(heap) > n:
                        heapq.heappush(heap, heap.pop())
        return [x for x in symbols if x >= 0]

    def _ids(self, chunk: str, symbols: list[int]) -> list[int]:
        """Ids of symbols; a character outside the vocabulary is its bytes' pieces, or unknown where there are none."""
        if max(symbols) < self.size:
            return symbols
        out: list[int] = []
        for x in symbols:
            out += [x] if x < self.size else [self.bytes.get(b, self.unknown) for b in chr(x - self.size).encode()]
        return out

    def text_of(self, ids: list[int]) -> str:
        """The text of ids, the first marker kept. Bytes that make no character are each the replacement character."""
        parts = "".join(map(self.texts.__getitem__, ids))
        if parts.isascii():
            return parts
        return re.sub("[\udc00-\udcff]+", lambda m: _characters(bytes(ord(c) - 0xDC00 for c in m[0])), parts).replace(CONTROL, "")


def _characters(raw: bytes) -> str:
    """UTF-8 with one replacement character for each byte that belongs to no character."""
    out, at = [], 0
    while at < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + n].decode())
                break
            except UnicodeDecodeError:
                pass
        else:
            out.append("�")
            n = 1
        at += n
    return "".join(out)


class Encoder:
    """Whole texts by way of the table of distinct chunks."""

    def __init__(self, path: str, most: int = MOST_BYTES):
        self.pieces, self.most = Pieces(path), most
        self.clear()

    def clear(self) -> None:
        #: A chunk's decimal ids; and its decoded text, where that isn't the chunk with spaces for markers.
        self.known: dict[str, str] = {}
        self.odd: dict[str, str] = {}
        self.held = 0

    @staticmethod
    def chunks(text: str) -> list[str]:
        """The marked words of a text in order: a marker stands before the text and for each space."""
        return CHUNK.findall(MARK + text.replace(" ", MARK)) if text else []

    def encode(self, text: str) -> list[int]:
        return [i for ids in self.pieces.segment(self.chunks(text)) for i in ids]

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the marker that encoding puts before a text goes."""
        text = self.pieces.text_of(ids)
        first = next((i for i in ids if not self.pieces.is_control[i]), None)
        return text[1:] if first is not None and self.pieces.names[first].startswith(MARK) else text

    def _learn(self, chunks: list[str]) -> None:
        for chunk, ids in zip(chunks, self.pieces.segment(chunks), strict=True):
            decimal, decoded = ",".join(map(str, ids)), self.pieces.text_of(ids)
            self.known[chunk] = decimal
            if decoded != chunk.replace(MARK, " "):
                self.odd[chunk] = decoded
            self.held += ENTRY_BYTES + len(chunk) + len(decimal)

    def summaries(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """The number of ids, the decimal ids and the decoded text of each text: each chunk's values at its position."""
        if self.held > self.most:
            self.clear()
        lists = [self.chunks(x) for x in texts]
        get = self.known.get
        found = [list(map(get, chunks)) for chunks in lists]
        lacking = [i for i, x in enumerate(found) if None in x]
        if lacking:
            self._learn(list({c for i in lacking for c, x in zip(lists[i], found[i], strict=True) if x is None}))
            for i in lacking:
                found[i] = list(map(self.known.__getitem__, lists[i]))
        for chunks, parts in zip(lists, found, strict=True):
            ids = ",".join(parts)
            if self.odd and not self.odd.keys().isdisjoint(chunks):
                decoded = "".join([self.odd.get(c, c) for c in chunks]).replace(MARK, " ")
            else:
                decoded = "".join(chunks).replace(MARK, " ")
            yield ids.count(",") + 1 if ids else 0, ids, decoded[1:]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each Python worker."""
    return Encoder(path)


def piece_ids(text: Column, path: str | None = None) -> Column:
    """The ids of each text as array<int>."""
    path = path or vocabulary()

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        return pa.array([encoder(path).encode(x or "") for x in texts.to_pylist()], pa.list_(pa.int32()))

    return ids(text)


def piece_text(ids: Column, path: str | None = None) -> Column:
    """The decoded text of each id list; null of a null list."""
    path = path or vocabulary()

    @F.arrow_udf("string")
    def text(lists: pa.Array) -> pa.Array:
        return pa.array([None if x is None else encoder(path).decode(x) for x in lists.to_pylist()], pa.string())

    return text(ids)


def piece_summary(text: Column, path: str | None = None) -> Column:
    """Number and digest of each text's ids, and the digest of the text they decode to."""
    path = path or vocabulary()

    @F.arrow_udf(SUMMARY)
    def summary(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = encoder(path)
        for texts in batches:
            parts: list[list] = [[], [], []]
            for _, whole in slices(texts):
                for n, ids, decoded in own.summaries([x or "" for x in whole]):
                    parts[0].append(n)
                    parts[1].append(hashlib.sha256(ids.encode()).hexdigest())
                    parts[2].append(hashlib.sha256(decoded.encode()).hexdigest())
            yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(parts, (pa.int64(), pa.string(), pa.string()), strict=True)], names=["n_tokens", "ids_sha256", "decoded_sha256"])
        own.clear()

    return summary(text)


def op12_piece_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", piece_summary(F.col("text")).alias("r"))
    return docs.select("doc_id", "r.*")
