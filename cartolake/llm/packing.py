"""Packing documents into training sequences of several context sizes."""

from __future__ import annotations

import bisect
import json
import re
import string
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TIERS = (256, 512, 1024, 2048, 4096)
END_ID = 2
# Documents of about so many bytes are packed by one task, independently of all others.
# Equal rows of a stretch of 2^STRETCH_BITS rows of an input partition stay together.
STRETCH_BITS = 9
GROUP_BYTES = 8 << 20
STEP_TOKENS = 1 << 17
# Distinct words a worker remembers the ids of, about.
CACHE_WORDS = 300_000
# Separators to Python's str.split, but not to the tokenizer.
_ODD_SPACE = re.compile("[\x1c-\x1f]")
# Fixed value: how a tokenizer with letters, digits and other characters apart cuts words.
_LETTERS_APART = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# Letters that normalisation leaves single letters.
# The same cuts in lower-case ASCII; what stands between the pieces is white space.
_PIECES = re.compile(r"[a-z]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\t-\r a-z0-9]+")
_LATIN = frozenset(string.ascii_letters) | {chr(c) for c in range(0xC0, 0x100)} - {"×", "÷"}
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
# Byte-level models name a byte by its Latin-1 character, those without a visible one by the characters from 256 on.
_HIDDEN = [b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE)]
_BYTE_LETTERS = {b: 256 + i for i, b in enumerate(_HIDDEN)}

_PIECE = "doc_id long, start long, length long, doc_tokens long, crc long, ids binary, group long"
PACKED = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "tier long, step_id long")


class WordTokenizer(dict):
    """Ids of whole texts, word by word; as a dict, the ids of each word met so far.

    The tokenizer drops white space and never joins across it, so a text's ids
    are those of its words in turn; a corpus repeats its words.  If it also
    lower-cases and parts letters from punctuation, a word has the ids of its
    stem in lower case and of its tail of punctuation, which repeat more often.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        import tokenizers

        super().__init__()
        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        # Words met before never reach the model, so its own cache only costs time.
        if hasattr(self.model, "_resize_cache"):
            self.model._resize_cache(0)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.cache_words = cache_words
        self.special = tuple(t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values())
        # Letters and then punctuation hold no special token, unless one is made so.
        self.plain_tails = not any(re.fullmatch(f"[a-z]*[{re.escape(string.punctuation)}]*", t) for t in self.special)
        shape = json.loads(self.tokenizer.to_str())
        normal = [s["type"] for s in (shape.get("normalizer") or {}).get("normalizers", [])]
        cuts = (shape.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.parts_words = (
            normal == ["NFC", "Replace", "Lowercase"] and [c["type"] for c in cuts] == ["Split", "ByteLevel"]
            and cuts[0]["pattern"].get("Regex") == _LETTERS_APART and not cuts[1]["add_prefix_space"]
            and not cuts[1]["use_regex"])

    def __missing__(self, word: str) -> bytes:
        ids = self._parts(word) if self.parts_words else None
        if ids is None:
            ids = self._bytes(self.tokenizer.encode(word, add_special_tokens=False).ids)
        self[word] = ids
        return ids

    def _bytes(self, ids: list[int]) -> bytes:
        return np.array(ids, self.kind).tobytes()

    def _parts(self, word: str) -> bytes | None:
        """The ids of a word by way of simpler words; None if there are none."""
        ascii_word = word.isascii()
        if word.isalpha() if ascii_word else _LETTERS.fullmatch(word):
            lower = word.lower()
            if lower != word:
                return self[lower]
            # One piece of letters: the model alone tells its ids.
            return self._bytes([t.id for t in self.model.tokenize(
                word if ascii_word else word.encode().decode("latin-1").translate(_BYTE_LETTERS))])
        stem = word.rstrip(string.punctuation)
        if stem != word and stem[-1:] in _LATIN and (
                (self.plain_tails and ascii_word and stem.isalpha()) or not any(s in word.lower() for s in self.special)):
            return self[stem] + self[word[len(stem):]]
        return None

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self) > self.cache_words:
            self.clear()
        ids = self.__getitem__
        return [b"".join(map(ids, self.cut(t))) for t in texts]

    def cut(self, text: str) -> list[str]:
        """Pieces whose ids, one after the other, are those of the text."""
        if _ODD_SPACE.search(text):
            return [text]
        if self.parts_words and text.isascii():
            lower = text.lower()
            if not any(s in lower for s in self.special):
                return _PIECES.findall(lower)
        return text.split()


def words_of(path: str) -> WordTokenizer:
    """The tokenizer of a worker process, which serves many tasks: what it has learnt stays with the library's module."""
    import tokenizers

    shared = vars(tokenizers).setdefault("_words_by_file", {})
    if path not in shared:
        shared[path] = WordTokenizer(path)
    return shared[path]


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


class Item:
    """A run of a document's ids that has no place yet."""

    __slots__ = ("doc_id", "start", "total", "ids")

    def __init__(self, doc_id, start: int, total: int, ids: np.ndarray):
        self.doc_id, self.start, self.total, self.ids = doc_id, start, total, ids

    def cut(self, n: int) -> tuple[Item, Item]:
        return (Item(self.doc_id, self.start, self.total, self.ids[:n]),
                Item(self.doc_id, self.start + n, self.total, self.ids[n:]))


class Shelf:
    """Items by length: the longest that fits, or the shortest of all."""

    def __init__(self, items: list[Item]):
        self.items = sorted(items, key=lambda x: len(x.ids))
        self.sizes = [len(x.ids) for x in self.items]

    def __len__(self) -> int:
        return len(self.items)

    def take(self, at: int) -> Item:
        self.sizes.pop(at)
        return self.items.pop(at)

    def fitting(self, room: int) -> Item | None:
        at = bisect.bisect_right(self.sizes, room) - 1
        return self.take(at) if at >= 0 else None

    def longer(self, room: int, most: int) -> Item | None:
        """The shortest item longer than ``room`` and not longer than ``most``."""
        at = bisect.bisect_right(self.sizes, room)
        return self.take(at) if at < len(self.sizes) and self.sizes[at] <= most else None

    def put(self, item: Item) -> None:
        at = bisect.bisect_left(self.sizes, len(item.ids))
        self.sizes.insert(at, len(item.ids))
        self.items.insert(at, item)


def pack_items(items: list[Item], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, list[Item]]]:
    """(tier, items in order) of every sequence; ``items`` are shorter than the largest tier.

    An item belongs to the smallest tier it fits.  From the largest tier down, each
    item opens a window of its tier; the gap takes the longest fitting items of
    shorter tiers, then a cut of one that does not fit.  What finds no filling is
    laid end to end and cut into whole windows, the last of which may stay short.
    """
    shelf, full, short = Shelf(items), [], []
    for tier, below in zip(reversed(tiers), [*reversed(tiers[:-1]), 0]):
        while shelf and shelf.sizes[-1] > below:
            window, room = [shelf.take(len(shelf) - 1)], tier
            room -= len(window[0].ids)
            while room:
                filler = shelf.fitting(room)
                if filler is None and (longer := shelf.longer(room, below or tier)):
                    filler, rest = longer.cut(room)
                    shelf.put(rest)
                if filler is None:
                    break
                window.append(filler)
                room -= len(filler.ids)
            if room:
                short += window
            else:
                full.append((tier, window))
    # The unfilled windows, end to end.
    queue = short[::-1]
    left = sum(len(x.ids) for x in queue)
    for tier in reversed(tiers):
        while left >= tier or (tier == tiers[0] and left):
            window, room = [], min(tier, left)
            left -= room
            size = tier if room == tier else tiers[-1]
            while room:
                item = queue.pop()
                if len(item.ids) > room:
                    item, rest = item.cut(room)
                    queue.append(rest)
                window.append(item)
                room -= len(item.ids)
            full.append((size, window))
    return full


def step_groups(windows: list[tuple[int, list[int]]], step_tokens: int = STEP_TOKENS) -> list[int]:
    """The training step of each (tier, piece lengths): steps hold one tier and like amounts of attention work.

    A tier's windows, the costliest first, are dealt to its steps to and fro.
    """
    steps = [0] * len(windows)
    first = 0
    for tier in sorted({t for t, _ in windows}):
        mine = sorted((i for i, (t, _) in enumerate(windows) if t == tier),
                      key=lambda i: (-sum(n * n for n in windows[i][1]), i))
        count = max(1, -(-len(mine) * tier // step_tokens))
        for k, i in enumerate(mine):
            turn, at = divmod(k, count)
            steps[i] = first + (count - 1 - at if turn % 2 else at)
        first += count
    return steps


def pack(docs: DataFrame, tokenizer_path: str, *, tiers: tuple[int, ...] = TIERS, end_id: int = END_ID,
         group_bytes: int = GROUP_BYTES, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_id.

    A document's ids are the tokenizer's and ``end_id``.  Whole windows of the
    largest tier are cut off where the text is read and travel as a length and a
    checksum; only the remainder, shorter than a window, carries ids.  Documents
    are dealt to groups by a hash of id, text and stretch of the input, so equal rows
    meet only if they lie near each other, which is where their copies compress; the same
    input files are dealt alike.  A group is packed by itself and has at most one sequence that is not full.  ``tier`` is the context size of a
    sequence and ``step_id`` its training step, unique over all groups.

    A null text counts as empty: its one id is ``end_id``.  A null id stays null;
    repeated rows are packed each.  An empty table gives no rows, and other
    columns are ignored.
    """
    window = max(tiers)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-size // group_bytes))
    dealt = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"),
        F.pmod(F.xxhash64("doc_id", "text", F.shiftright(F.monotonically_increasing_id(), STRETCH_BITS)), F.lit(groups)).alias("group"))

    def tokenized(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(tokenizer_path)
        end = np.array([end_id], words.kind).tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for doc_id, text, group in zip(part["doc_id"].to_pylist(), words.encode(part["text"].to_pylist()),
                                               part["group"].to_pylist()):
                    ids = np.frombuffer(text + end, words.kind)
                    whole = len(ids) // window * window
                    rows += [(doc_id, i, window, len(ids), crc(ids[i : i + window]), None, group)
                             for i in range(0, whole, window)]
                    if whole < len(ids):
                        rows.append((doc_id, whole, len(ids) - whole, len(ids), None, ids[whole:].tobytes(), group))
                kinds = [pa.int64()] * 5 + [pa.binary(), pa.int64()]
                names = ["doc_id", "start", "length", "doc_tokens", "crc", "ids", "group"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    kind = words_of(tokenizer_path).kind

    def packed(table: pa.Table) -> pa.Table:
        group = table["group"][0].as_py()
        out, open_items, windows = [], [], []
        # Rows of a group come in any order; sorting them makes reruns agree.
        order = [(c, "ascending") for c in ("doc_id", "start", "doc_tokens", "crc", "ids")]
        for row in table.sort_by(order).to_pylist():
            if row["ids"] is None:
                windows.append((window, [window]))
                out.append([(row["doc_id"], row["start"], window, row["crc"], row["doc_tokens"])])
            else:
                open_items.append(Item(row["doc_id"], row["start"], row["doc_tokens"], np.frombuffer(row["ids"], kind)))
        for tier, items in pack_items(open_items, tiers):
            windows.append((tier, [len(x.ids) for x in items]))
            out.append([(x.doc_id, x.start, len(x.ids), crc(x.ids), x.total) for x in items])
        rows = []
        for n, (pieces, (tier, _), step) in enumerate(zip(out, windows, step_groups(windows, step_tokens))):
            offset = 0
            for doc_id, start, length, check, total in pieces:
                rows.append((doc_id, start, length, check, total, (group << 32) + n, offset, tier, (group << 32) + step))
                offset += length
        names = [c.split()[0] for c in PACKED.split(", ")]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, zip(*rows))})

    return dealt.mapInArrow(tokenized, _PIECE).groupBy("group").applyInArrow(packed, PACKED)
